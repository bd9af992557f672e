"""Registries, configurations of any text, and what a store does with late, repeated and broken input."""

import sys

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import scalar
from sketchloom.operators import records, series
from sketchloom.sources import config, graphite, registry
from sketchloom.streaming import ingest


def test_a_configuration_resolves(tmp_path, monkeypatch):
    found = registry.resolve(config.loads(config.DEFAULT))
    assert found.kind.name == "tdigest" and found.path == "data" and [e for _, e in found.listeners] == [{"address": ":1111"}]
    text = config.DEFAULT.replace("plugins = []", 'plugins = ["own_plugin"]').replace("listeners.graphite", "listeners.own").replace("database.files", "database.mine")
    with pytest.raises(ModuleNotFoundError):
        registry.resolve(config.loads(text))
    (tmp_path / "own_plugin.py").write_text("from sketchloom.sources import registry\nregistry.register_listener('own', lambda spark, e: e)\nregistry.register_store('mine', registry.Store(lambda e: 'there'))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    found = registry.resolve(config.loads(text))
    assert found.path == "there" and found.listeners[0][0](None, 5) == 5
    sys.modules.pop("own_plugin")
    for wrong in (text.replace("own]", "unknown]"), text.replace(".mine", ".unknown"), text.replace("dist.tdigest", "dist.unknown")):
        with pytest.raises(KeyError, match="unknown"):
            registry.resolve(config.loads(wrong))


def test_any_text_goes_through_a_configuration():
    odd = 'a\\b"c\n\t\x7f\x01é😀 # ='
    c = config.Config(5, ("files", {"directory": odd, odd: 3}), ("kll", {}), [(odd, {"x": [odd, "y"], "on": True})], [odd], {"origin": odd})
    assert config.loads(config.dumps(c)) == c


def test_ids_of_any_type(spark):
    rows = [("m", 5, 2.0, "b"), ("m", 3, 2.0, "x"), ("m", 3, 2.0, "c"), ("m", 4, -0.0, "z"), ("m", 4, 1.0, None)]
    df = spark.createDataFrame(rows, "metric string, us long, value double, id string")
    for kind in ("string", "binary"):
        own = df.withColumn("id", F.col("id").cast(kind))
        r = records.observe(own, 10**9, None).first()
        assert (bytes(r.max_id).decode() if kind == "binary" else r.max_id) == "c" and r.max == 2.0 and (r.min, str(r.min)) == (0.0, "-0.0")
        again = records.merge(records.observe(own, 10**9, None), "metric").first()
        assert (again.min_id, again.max_id) == (r.min_id, r.max_id)


def test_numbers_of_lines(spark):
    lines = ["m 1 0", "m 1d 0", "m 1.5f 0", "m 1e3 0", "m .5 0", "m 1. 0", "m inf 0", "m NaN 0", "m 0x1 0", "m  1 0", "m +2 0", "m . 0", "m 1\t 0"]
    found = graphite.parse(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, k long")).orderBy("k").collect()
    assert [r.bad for r in found] == [False, True, True, False, False, False, False, False, True, True, False, True, True]


def test_crc32c(spark):
    assert scalar.crc32c_of(b"123456789") == 0xE3069283 and scalar.crc32c_of(b"") == 0
    df = spark.createDataFrame([(b"123456789",), (None,), (b"\0" * 32,)], "x binary").select(scalar.crc32c(F.col("x")).alias("c"))
    assert [r.c for r in df.collect()] == [0xE3069283, None, 0x8A9136AA]


def batch(spark, *rows):
    return spark.createDataFrame(rows, "metric string, start_ns long, end_ns long, observations long")


def test_a_store_refuses_late_and_repeated_records_and_skips_broken_files(spark, tmp_path):
    path, told = str(tmp_path / "store"), []
    first = batch(spark, ("a", 0, 10, 1), ("a", 10, 20, 1), ("b", 0, 10, 1))
    ingest.append_batch(first, path, told.append)
    ingest.append_batch(first, path, told.append)
    ingest.append_batch(batch(spark, ("a", 5, 15, 9), ("b", 10, 20, 1), ("c", 0, 5, 1)), path, told.append)  # the first is late
    assert [(t["metric_writes"], t["metric_skips"], t["metric_errors"]) for t in told] == [(3, 0, 0), (0, 3, 0), (2, 1, 0)]
    ingest.append_batch(first.limit(0), path, told.append)
    (tmp_path / "store" / "broken.parquet").write_bytes(b"PAR1 and no more")
    assert ingest.stored(spark, path, first.schema).count() == 5
    with pytest.raises(Exception):  # noqa: B017
        ingest.append_batch(first.withColumn("end_ns", F.raise_error(F.lit("x")).cast("long")), path, told.append)
    assert told[-1]["metric_errors"] >= 1


def test_a_hot_metric_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("hot").alias("metric"), F.col("id").alias("start_ns"), (F.col("id") + 1).alias("end_ns"), F.lit(1).cast("long").alias("observations"))
    conf = ("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set(*conf)
    try:
        series.write(rows, str(tmp_path / "s"))
    finally:
        spark.conf.unset(conf[0])
    assert len(list((tmp_path / "s").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "s")).count() == 40_000
