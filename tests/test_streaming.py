"""A stream and its final flush give the records of a batch."""

from pyspark.sql import functions as F

from sketchloom.streaming import ingest

FIELDS = ["metric", "start_ns", "end_ns", "observations", "min", "max", "min_id", "max_id"]


def observations(spark):
    rows = spark.range(3_000).select(F.concat(F.lit("m."), (F.col("id") % 3).cast("string")).alias("metric"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") * 37 % 101).cast("double").alias("value"), "id")
    return rows.withColumn("value", F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("value")))


def test_stream_and_flush_equal_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    observations(spark).write.parquet(source)
    stream = spark.readStream.schema("metric string, ts timestamp, value double, id long").parquet(source)
    measures = []
    ingest.store(ingest.windowed(stream), out, str(tmp_path / "check"), told=measures.append).awaitTermination(120)
    assert sum(m["metric_writes"] for m in measures) == ingest.stored(spark, out).count() and all(m["metric_skips"] == 0 for m in measures)
    before = ingest.stored(spark, out).count()
    ingest.flush(spark.read.parquet(source), out)
    whole = ingest.windowed(spark.read.parquet(source))
    key = lambda r: tuple(r)
    assert sorted(map(key, ingest.stored(spark, out).select(FIELDS).collect())) == sorted(map(key, whole.select(FIELDS).collect()))
    assert 0 < before < whole.count()  # the last windows stay open until the flush
    ingest.flush(spark.read.parquet(source), out)  # once more adds nothing
    assert ingest.stored(spark, out).count() == whole.count()


def test_peek_shows_open_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    observations(spark).write.parquet(source)
    stream = spark.readStream.schema("metric string, ts timestamp, value double, id long").parquet(source)
    ingest.peek(ingest.windowed(stream, kind_name=None), "open_windows", str(tmp_path / "check")).awaitTermination(120)
    assert spark.table("open_windows").agg(F.sum("observations")).first()[0] == 3_000 - 60
