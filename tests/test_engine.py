"""Golden cases and properties of the distribution engine."""

import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchloom import api
from sketchloom.functions import driver, scalar, search
from sketchloom.operators import columns, heatmap, kinds, layout, records, series, tdigest
from sketchloom.sources import config, demo, graphite, paths

OBS = "metric string, us long, value double, id long"
REC = "metric string, start_ns long, end_ns long, observations long, min double, max double, min_id long, max_id long, merged long, kind string, distribution array<double>"
PATHS = [("foo.bar", "foo/bar"), ("foo..bar", "foo/%2ebar"), ("foo....bar", "foo/%2e%2e%2ebar"), ("fo/o.bar", "fo%2fo/bar"), ("fo%o.bar", "fo%25o/bar"), ("foo.bar.baz", "foo/bar/baz"), ("foo.bar.", "foo/bar/%2e"), ("foo.bar..", "foo/bar/%2e%2e"), ("", ""), (".", "%2e"), ("...", "%2e%2e%2e"), (".foo.bar", "%2e/foo/bar"), ("...foo.bar", "%2e%2e%2e/foo/bar")]


def rec(metric, start, end, n=1, merged=1, values=(1.0,), kind="exact"):
    return (metric, start, end, n, min(values), max(values), 1, 1, merged, kind, sorted(values))


def test_record_has_extremes_with_the_first_ids(spark):
    values = list(range(10))
    random.Random(1).shuffle(values)
    rows = [("m", 1_000 + k, float(v), v) for k, v in enumerate(values)] + [("m", 2_000, 9.0, 77), ("m", 2_000, 0.0, 78)]
    r = records.observe(spark.createDataFrame(rows, OBS), 60_000_000_000).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.min, r.min_id, r.max, r.max_id, r.observations, r.merged) == (0.0, 0, 9.0, 9, 12, 1)
    assert r.end_ns - r.start_ns == 60_000_000_000 and len(r.distribution) == 12


def test_only_finite_values_count(spark):
    rows = [("m", 1, v, k) for k, v in enumerate([float("nan"), float("inf"), float("-inf"), None, 1.0])]
    assert [r.observations for r in records.observe(spark.createDataFrame(rows, OBS), 1_000_000).collect()] == [1]
    assert records.observe(spark.createDataFrame([], OBS), 1_000_000).count() == 0


@pytest.mark.parametrize("name", ["exact", "kll", "tdigest"])
def test_merged_distributions_answer_for_all_values(spark, name):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 10, 2_000)
    rows = [("m", int(k), float(v), k) for k, v in enumerate(x)]
    found = records.observe(spark.createDataFrame(rows, OBS), 100_000, name)
    assert found.count() == 20
    one = records.sampled(records.merge(found, "metric", kind_name=name), name, 10).collect()[0]
    assert one.observations == 2_000 and one.merged == 20
    ranks = [(x <= v).mean() for v in one.data]
    slack = 1e-3 if name == "exact" else 0.03
    assert all(abs(r - k / 10) <= slack for k, r in enumerate(ranks))
    assert abs(records.merge(found, "metric", kind_name=name).select(kinds.kind(name).cdf(F.col("distribution"), 50.0)).first()[0] - (x <= 50).mean()) < slack


def test_a_merge_of_another_kind_is_an_error(spark):
    df = spark.createDataFrame([rec("m", 0, 1), rec("m", 1, 2, kind="other")], REC)
    with pytest.raises(Exception, match="can't merge a distribution of kind other"):
        records.merge(df, "metric", kind_name="exact").collect()
    with pytest.raises(KeyError, match="no registration for"):
        kinds.kind("none")


def test_merge_counts_zero_as_one_and_rates_skip_empty_spans(spark):
    df = spark.createDataFrame([rec("m", 0, 10**9, n=6, merged=0), rec("m", 10**9, 3 * 10**9, n=8, merged=2), rec("m", 5, 5)], REC)
    assert records.merge(df, "metric").select("merged", "observations", "start_ns", "end_ns").collect()[0] == (4, 15, 0, 3 * 10**9)
    assert records.observations_per_second(df, "metric").collect()[0].obs_sec == pytest.approx((6 + 2) / 2)


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(1, 6))
def test_tdigest_keeps_count_and_extremes(values, parts):
    x = np.array(values)
    merged = tdigest.merge([tdigest.build(p) for p in np.array_split(x, parts)])
    assert tdigest.count(merged) == len(x)
    low, high = tdigest.quantiles(merged, [0.0, 1.0])
    assert low == x.min() and high == x.max()


def test_writes_must_end_later(spark):
    writes = [(10, 20), (0, 10), (100, 200), (150, 200), (0, 201)]
    df = spark.createDataFrame([("m", k, s, e) for k, (s, e) in enumerate(writes)], "metric string, seq long, start_ns long, end_ns long")
    assert sorted(r.seq for r in series.accepted(df).collect()) == [0, 2, 4]
    stored = spark.createDataFrame([("m", 200)], "metric string, end_ns long")
    assert sorted(r.seq for r in series.accepted(df, stored).collect()) == [4]


def test_retention_keeps_a_ring_of_files(spark):
    df = spark.createDataFrame([("m", 50 * i, 50 * i + 20) for i in range(1000)], "metric string, start_ns long, end_ns long")
    kept = series.retained(df, cap=10, files=10)
    assert kept.count() == 110
    assert series.before(kept, "m", 50 * 890).count() == 0
    assert series.before(kept, "m", 50 * 1050).first().end_ns == 49970
    assert all(r.end_ns < 50 * 900 for r in series.before(kept, "m", 50 * 900).collect())
    assert series.latest(kept).first().end_ns == 49970
    assert series.retained(df, 10, 0).count() == 1000


def test_long_series_are_cut_without_a_difference(spark):
    rng = random.Random(4)
    rows = [(f"m{rng.randint(0, 2)}", k, rng.randint(0, 400) + k) for k in range(400)]
    df = spark.createDataFrame(rows, "metric string, seq long, end_ns long")
    assert sorted(series.accepted(df, width=30).collect()) == sorted(series.accepted(df).collect())
    ends = df.dropDuplicates(["metric", "end_ns"]).cache()
    assert sorted(series.retained(ends, 7, 3, width=25).collect()) == sorted(series.retained(ends, 7, 3).collect())
    assert series.accepted(df.limit(0)).count() == series.retained(df.limit(0), 7, 3).count() == 0


def test_lookback_has_one_record_more(spark):
    df = spark.createDataFrame([("m", e - 5, e) for e in (10, 20, 30, 40, 50)] + [("old", 0, 3)], "metric string, start_ns long, end_ns long")
    assert sorted(r.end_ns for r in series.lookback(df, 50, 20).collect()) == [3, 20, 30, 40]
    assert sorted(r.end_ns for r in series.lookback(df, 50, 20, extra=False).collect()) == [30, 40]


def test_segments_of_known_pixels(spark):
    # a span of 10 ns on 10 pixels: pixel = 10 - (now - t)
    df = spark.createDataFrame([rec("m", 91, 93), rec("m", 93, 95), rec("m", 98, 99)], REC)
    found = columns.segments(df, 100, 10, 10).orderBy("x").collect()
    assert [(r.x, r.w, r.ends) for r in found] == [(1, 2, [93]), (3, 1, [93, 95]), (4, 2, [95]), (8, 2, [99])]


@pytest.mark.parametrize("seed", range(5))
def test_columns_cover_what_records_do(spark, seed):
    rng = random.Random(seed)
    ends = sorted(rng.sample(range(1_000, 2_000), 12))
    rows = [rec("m", e - rng.randint(1, 200), e, values=(float(k),)) for k, e in enumerate(ends)]
    df = spark.createDataFrame(rows, REC)
    now, span, width = 2_000, 1_000, 50
    size = span // width
    px = lambda t: max(0, width - (now - t + size - 1) // size)
    want = {}
    for _, s, e, *_ in rows:
        for p in range(px(s), min(px(e), width - 1) + 1):
            want.setdefault(p, set()).add(e)
    found = columns.segments(df, now, span, width).collect()
    got = {p: set(r.ends) for r in found for p in range(r.x, r.x + r.w)}
    assert got == want and sum(r.w for r in found) == len(got)
    edges = {r.x: set(r.ends) for r in found}
    assert all(want.get(x - 1) != own for x, own in edges.items())


def test_bad_grids_are_refused():
    for span, width in ((10, 0), (10, 11)):
        with pytest.raises(ValueError):
            columns.pixel_size(span, width)


@pytest.mark.parametrize(("term", "metric", "found"), [("foo.bar.baz", "a.foo.bar.baz.b", True), ("foo.bar.baz", "a.fool.barl.bazl.b", True), ("foo.bar.baz", "a.foe.barl.bazl.b", False), ("foo.bar.baz", "a.foo.baz.bazl.b", False), ("foo.bar.baz", "a.foo.bar.baf.b", False), ("a*p*m*", "ActionsPerMinute", True), ("_re", "success_times_recent", True), ("recent", "success_times_recent", True), ("abc*", "abc", False), ("", "x", True), (".", "a.b", True), (".", "a", False), (".", "a.", False)])
def test_search_terms(spark, term, metric, found):
    df = spark.createDataFrame([(metric,)], "metric string")
    assert (search.search(df, term).count() == 1) is found


@pytest.mark.parametrize(("glob", "name", "found"), [("abc*", "abcdefg", True), ("abc", "abcdefg", True), ("a*bc", "afffbcdefg", True), ("abc", "aabc", False), ("abcd", "abc", False), ("abc", "ABC", True), ("abc*", "abc", False)])
def test_bare_globs(glob, name, found):
    assert bool(re.search(search.glob_regex(glob), name.lower())) is found


def test_search_orders_and_caps(spark):
    df = spark.createDataFrame([(f"m.{c}",) for c in "zyxwvutsrqpo"], "metric string")
    assert [r.metric for r in search.search(df, "", 2).collect()] == ["m.o", "m.p"]
    assert search.search(df, "", 0).count() == 0
    with pytest.raises(ValueError):
        search.search(df, "", -1)


def test_paths_both_ways(spark):
    df = spark.createDataFrame(PATHS, "metric string, path string")
    for r in df.select("*", paths.path_column(F.col("metric")).alias("p"), paths.metric_column(F.col("path")).alias("m")).collect():
        assert (r.p, r.m) == (r.path, r.metric)
        assert paths.to_path(r.metric) == r.path and paths.to_metric(r.path) == r.metric
    with pytest.raises(ValueError):
        paths.to_metric("a%2x")


@given(st.text("ab./%", max_size=12))
def test_paths_come_back(metric):
    assert paths.to_metric(paths.to_path(metric)) == metric


def test_graphite_lines(spark):
    lines = ["test.foo.bar 123 0", "test.foo.baz 123 0", "a 1", "a 1 2 3", "a  1 0", "a x 0", ""]
    found = graphite.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.metric for r in found if not r.bad] == ["test.foo.bar", "test.foo.baz"] and sum(r.bad for r in found) == 5


def test_graphite_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("m 1.5 0\nbad\n")
    found = graphite.read_files(spark, str(tmp_path))
    assert [(r.metric, r.value, r.id) for r in found.collect()] == [("m", 1.5, None)] and found.first().us > 10**15
    assert records.observe(found, 10**9, None).first().observations == 1


def test_half_precision_is_numpys(spark):
    x = [0.1, 1 / 3, 2047.5, 65503.0, -3.14159, 1e-3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(scalar.half(F.col("v"))).collect()]
    assert got == [float(np.float16(v)) for v in x]


def test_durations_and_axis():
    assert driver.duration_ns("10m") == 600 * 10**9 and driver.duration_ns("1h30m") == 5_400 * 10**9 and driver.duration_ns("-1.5s") == -(15 * 10**8)
    for bad in ("", "10", "m", "1x"):
        with pytest.raises(ValueError):
            driver.duration_ns(bad)
    assert driver.axis_unit_ns(24 * driver.HOUR, 1000) == 2 * driver.HOUR
    with pytest.raises(ValueError):
        driver.axis_unit_ns(1, 99)
    assert len(driver.axis_labels_ns(24 * driver.HOUR, 24 * driver.HOUR, 1000)) == 12


def test_generator_is_the_published_one():
    g = driver.Pcg(42, 54)
    assert [g.next() for _ in range(6)] == [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293, 0xBFA4784B, 0xCBED606E]


def test_default_configuration():
    c = config.loads(config.DEFAULT)
    assert c.duration_ns == 600 * 10**9 and c.listeners == [("graphite", {"address": ":1111"})]
    assert c.database == ("files", {"directory": "data", "size": 256, "cap": 400, "files": 2}) and c.distribution == ("tdigest", {"compression": 5.0})
    assert config.loads(config.dumps(c)) == c
    with pytest.raises(ValueError):
        config.loads("[database.a]\n[database.b]\n[dist.x]")
    with pytest.raises(TypeError):
        config.loads("main = 3")


def test_demo_has_six_series(spark):
    rows = demo.observations(spark, 10**15, records=4, least=20).groupBy("metric").count().collect()
    assert len(rows) == 6 and all(80 <= r["count"] < 160 for r in rows)


def test_rendering(spark):
    now = 10**15
    df = records.observe(demo.observations(spark, now // 1000, records=10, least=30), demo.DAY_US * 100)
    request = api.Request.of({"metric": "normal.stable", "now": str(now), "duration": "24h", "width": "200", "height": "80", "samples": "x"})
    assert (request.samples, request.padding) == (30, 0)
    told = json.loads(api.render_json(df, request))
    assert told["columns"] and [c["X"] for c in told["columns"]] == sorted((c["X"] for c in told["columns"]), reverse=True)
    assert all(len(c["Data"]) == 31 and c["Data"] == sorted(c["Data"]) for c in told["columns"])
    image = api.render_png(df, request)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (200, 80)
    at = image.index(b"IDAT") + 4
    assert len(zlib.decompress(image[at : at + struct.unpack(">I", image[at - 8 : at - 4])[0]])) == 80 * (1 + 3 * 200)
    graph, place = api.render_graph(df, request)
    assert struct.unpack(">II", graph[16:24]) == (200, 80) and place.heatmap_width == 200 - (13 + 24 + 15 + layout.axis_width(place.right))
    assert api.query(df, {"query": "exp.", "results": "2"}) == ["exp.decreasing", "exp.increasing"]
    with pytest.raises(ValueError):
        api.Request.of({})


def test_sketch_scales_give_cells_too(spark):
    df = records.observe(demo.observations(spark, 10**12, records=5, least=30), demo.DAY_US * 200, "kll")
    cols = columns.columns(df.where("metric = 'exp.stable'"), 10**15, demo.DAY_US * 1000, 100, 8, "kll")
    cells = heatmap.cells(cols, heatmap.scale_of(series.latest(df), "kll"), 9, 16).collect()
    assert cells and all(0 <= c.color <= 15 for c in cells) and len({c.y for c in cells}) == 9


def test_layout_of_labels():
    place = layout.layout(1000, 350, 48 * driver.HOUR, 24 * driver.HOUR, lambda q: 100 * q)
    assert [x.text for x in place.left][:2] == ["1.00", "0.90"] and place.left[-1].text == "0.00"
    assert place.right[0].text == "100." and place.right[-1].text == "0.00"
    assert place.bottom[0].text == "1/2 @ 02:00" and place.bottom[-1].position == 1.0 and len(place.bottom) == 12
    with pytest.raises(ValueError, match="too small"):
        layout.layout(50, 350, 48 * driver.HOUR, 24 * driver.HOUR, float)


def test_saturation_and_fast_mod(spark):
    r = spark.range(1).select(scalar.saturation(F.lit(0.0), F.lit(0.0)), scalar.saturation(F.lit(5.0), F.lit(5.0)), scalar.fast_mod(F.lit(2**32 - 1), 10), scalar.head_of(F.lit("a.b.c")), scalar.tail_of(F.lit("a.b.c")), scalar.tail_of(F.lit("a"))).first()
    assert tuple(r) == (255, 0, 9, "a", "b.c", "")
    assert math.isnan(tdigest.cdf(b"", 1.0))
