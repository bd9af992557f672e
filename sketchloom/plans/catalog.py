"""Queries of the distribution engine by name, and the DuckDB SQL of each.

Doubles are rounded so that both engines' sums agree. SQL is left out where a result depends on
sketches, chance or Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.functions import scalar, search
from sketchloom.functions.driver import axis_labels_ns
from sketchloom.operators import columns, heatmap, kinds, records, series
from sketchloom.sources import demo, graphite, paths, tables
from sketchloom.streaming import ingest

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
SIX_HOURS = 6 * HOUR
#: 2024-02-01 00:00 UTC, just after the last event.
NOW = 1_706_745_600_000_000_000
WEEK, WIDTH = 7 * DAY, 100
#: A time in the middle of the events, and the width of a range of writes.
MIDDLE, RANGE = NOW - 15 * DAY, 1_000_000
QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def six_hourly(spark: SparkSession, sf_dir: str, kind: str | None = "exact") -> DataFrame:
    return records.observe(tables.events(spark, sf_dir), SIX_HOURS, kind)


def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value in seven is made NaN, one infinite, one null."""
    rows = tables.events(spark, sf_dir)
    odd = F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 7 == 1, float("inf")).when(F.col("id") % 7 == 2, float("-inf")).when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.col("value"))
    return rows.withColumn("value", odd).where(records.finite(F.col("value"))).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def window_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six_hourly(spark, sf_dir, None).select("metric", "start_ns", "end_ns", "observations", "min", "max", "merged")


def window_minmax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.observe(tables.events(spark, sf_dir), DAY, None).select("metric", "start_ns", "min", "min_id", "max", "max_id")


def window_minmax_ids_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as text."""
    rows = tables.events(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), F.col("id").cast("string")))
    return records.observe(rows, DAY, None).select("metric", "start_ns", "min", "min_id", "max", "max_id")


def graphite_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to records; of one event in seven the number has a letter after it, which makes the line bad."""
    rows = tables.events(spark, sf_dir)
    number = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, "d").otherwise(""))
    parsed = graphite.parse(rows.select(F.concat_ws(" ", "metric", number, F.lit("0")).alias("line"), "us", "id"), "line")
    return records.observe(parsed.where(~F.col("bad")), DAY, None).select("metric", "start_ns", "observations", "min", "max", "min_id", "max_id")


def window_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.observe(tables.events(spark, sf_dir), DAY).withColumn("qs", kinds.kind("exact").quantiles(F.col("distribution"), QS))
    return found.select("metric", "start_ns", F.posexplode("qs").alias("k", "v")).select("metric", "start_ns", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.observe(tables.orders(spark, sf_dir), 30 * DAY, None).select("metric", "start_ns", "observations", "min", "max", "min_id", "max_id")


def lineitem_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem(spark, sf_dir).where(records.finite(F.col("value")))
    found = rows.groupBy("metric").agg(F.percentile("value", F.array(*(F.lit(q) for q in QS))).alias("qs"))
    return found.select("metric", F.posexplode("qs").alias("k", "v")).select("metric", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = records.observe(tables.events(spark, sf_dir), HOUR, None)
    day = F.call_function("div", F.col("start_ns"), F.lit(DAY).cast("long")).alias("day")
    return records.merge(hourly, "metric", day).select("metric", "day", "start_ns", "end_ns", "observations", "min", "max", "min_id", "max_id", "merged")


def merge_quantiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = records.observe(tables.events(spark, sf_dir), HOUR)
    day = F.call_function("div", F.col("start_ns"), F.lit(DAY).cast("long")).alias("day")
    found = records.sampled(records.merge(hourly, "metric", day, kind_name="exact"), "exact", 4)
    return found.select("metric", "day", F.posexplode("data").alias("k", "v")).select("metric", "day", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


def cdf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.observe(tables.events(spark, sf_dir), DAY)
    return found.select("metric", "start_ns", F.round(kinds.kind("exact").cdf(F.col("distribution"), 25.0), 9).alias("rank"))


def obs_per_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = records.observe(tables.events(spark, sf_dir), HOUR, None)
    return records.observations_per_second(hourly, "metric").select("metric", F.round("obs_sec", 9).alias("obs_sec"))


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest(six_hourly(spark, sf_dir, None)).select("metric", "start_ns", "end_ns", "observations", "min", "max")


def series_scan_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.before(six_hourly(spark, sf_dir, None), "events.click", NOW - WEEK).select("metric", "start_ns", "end_ns", "observations")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes that end when they happened and come nearly in that order."""
    return tables.events(spark, sf_dir).select("metric", (F.col("id") * 100 + F.col("id") * 7919 % 1000).alias("seq"), (F.col("us") * 1000).alias("end_ns"))


def monotonic_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.accepted(_writes(spark, sf_dir), width=RANGE)


def monotonic_accept_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ended before MIDDLE is stored; all else is written."""
    writes, old = _writes(spark, sf_dir), F.col("end_ns") < F.lit(MIDDLE).cast("long")
    return series.accepted(writes.where(~old), writes.where(old), width=RANGE)


def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.retained(six_hourly(spark, sf_dir, None), cap=7, files=3).select("metric", "end_ns")


def _user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_events(spark, sf_dir)


def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.names(_user_names(spark, sf_dir))


def name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.union_of_names(tables.events(spark, sf_dir), tables.orders(spark, sf_dir), tables.lineitem(spark, sf_dir))


def metric_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_user_names(spark, sf_dir), "URCH", 1000)


def metric_search_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_user_names(spark, sf_dir), "c*k.u1?", 1000)


def metric_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_user_names(spark, sf_dir), "Events.sign u12", 10)


def metric_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_user_names(spark, sf_dir), "  ")


def lookback_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lookback(six_hourly(spark, sf_dir, None), NOW, WEEK).select("metric", "start_ns", "end_ns")


def _seen(spark: SparkSession, sf_dir: str, kind: str | None = "exact") -> DataFrame:
    return series.lookback(six_hourly(spark, sf_dir, kind), NOW, WEEK)


def pixel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: columns.pixel_of(F.col(c), NOW, WEEK, WIDTH)
    return six_hourly(spark, sf_dir, None).select("metric", "start_ns", place("start_ns").alias("start_px"), place("end_ns").alias("end_px"))


def pixel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.covered(_seen(spark, sf_dir, None), NOW, WEEK, WIDTH)
    return found.groupBy("metric", "px").agg(F.count(F.lit(1)).alias("n"))


def columns_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.segments(_seen(spark, sf_dir, None), NOW, WEEK, WIDTH)
    return found.select("metric", "x", "w", F.size("ends").cast("long").alias("n"), F.element_at("ends", 1).alias("first_end"))


def _columns(spark: SparkSession, sf_dir: str, samples: int = 4) -> DataFrame:
    return columns.columns(_seen(spark, sf_dir), NOW, WEEK, WIDTH, samples)


def columns_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _columns(spark, sf_dir).select("metric", "x", "w", F.round("obs_sec", 9).alias("obs_sec"), F.posexplode("data").alias("k", "v"))
    return found.select("metric", "x", "w", "obs_sec", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


def busiest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _columns(spark, sf_dir).withColumn("obs_sec", F.round("obs_sec", 9))
    return columns.busiest(rounded).select("metric", "x", "obs_sec")


def strip_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.observe(tables.events(spark, sf_dir), SIX_HOURS, None)
    most = F.max("observations").over(Window.partitionBy("metric"))
    return rows.select("metric", "start_ns", scalar.saturation(F.col("observations"), most).alias("grey"))


def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = records.observe(tables.events(spark, sf_dir), DAY)
    data = kinds.kind("exact").quantiles(F.col("distribution"), [k / 4 for k in range(5)])
    cols = daily.select("metric", F.call_function("div", F.col("start_ns"), F.lit(DAY).cast("long")).alias("x"), F.lit(1).alias("w"), data.alias("data"))
    return heatmap.cells(cols, heatmap.scale_of(series.latest(daily)), 5, 256).select("metric", "x", "y", "color")


def graphite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines; one in five has a field too few, too many or a word for a number."""
    rows = tables.events(spark, sf_dir)
    good = F.concat_ws(" ", "metric", F.col("id").cast("string"), F.lit("0"))
    line = F.when(F.col("id") % 5 != 0, good).when(F.col("id") % 15 == 0, F.concat(good, F.lit(" 1"))).when(F.col("id") % 15 == 5, F.concat_ws(" ", "metric", F.lit("x1"), F.lit("0"))).otherwise(F.concat_ws(" ", "metric", F.col("id").cast("string")))
    parsed = graphite.parse(rows.select(line.alias("value")))
    return parsed.groupBy(F.coalesce("metric", F.lit("-")).alias("metric"), "bad").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))


def path_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.user_events(spark, sf_dir).select("metric").distinct()
    path = paths.path_column(F.col("metric"))
    return names.select("metric", path.alias("path"), paths.metric_column(path).alias("back"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.user_events(spark, sf_dir).select("metric").distinct()
    return names.select("metric", scalar.head_of(F.col("metric")).alias("head"), scalar.tail_of(F.col("metric")).alias("tail"))


def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels over a day and 1,000 pixels, and how many hourly records end at each."""
    labels = spark.createDataFrame([(t,) for t in axis_labels_ns(NOW - DAY, DAY, 1000)], "end_ns long")
    hourly = records.observe(tables.events(spark, sf_dir), HOUR, None)
    found = labels.join(hourly, "end_ns", "left").groupBy("end_ns").agg(F.count("metric").alias("n"))
    return found.select("end_ns", F.date_format(F.expr("timestampadd(MICROSECOND, end_ns div 1000, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "M/d @ HH:mm").alias("label"), "n")


def fast_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.events(spark, sf_dir)
    bucket = scalar.fast_mod((F.col("id") * 2654435761) % 4294967296, 10)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).select("id", scalar.half(F.col("value")).alias("half"))


def kll_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.sampled(records.merge(records.observe(tables.events(spark, sf_dir), HOUR, "kll"), "metric", kind_name="kll"), "kll", 4)
    return found.select("metric", "observations", "data")


def tdigest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.sampled(records.merge(records.observe(tables.events(spark, sf_dir), DAY, "tdigest"), "metric", kind_name="tdigest"), "tdigest", 4)
    return found.select("metric", "observations", "data")


def windowed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan over a batch: ten-minute windows, without distributions."""
    rows = tables.events(spark, sf_dir).select("metric", F.timestamp_micros("us").alias("ts"), "value", "id")
    return ingest.windowed(rows, kind_name=None).select("metric", "start_ns", "end_ns", "observations", "min", "max", "min_id", "max_id")


def demo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = demo.DAY_US // 100 * 1000
    return records.observe(demo.observations(spark, NOW // 1000), step, "kll").select("metric", "start_ns", "observations", "min", "max")


QUERIES = {f.__name__: f for f in (finite_filter, window_records, window_minmax_ids, window_minmax_ids_text, graphite_records, window_quantiles, order_records, lineitem_quantiles, merge_records, merge_quantiles_exact, cdf_exact, obs_per_sec, latest_record, series_scan_before, monotonic_accept, monotonic_accept_stored, retention_topn, metric_names, name_union, metric_search_substring, metric_search_glob, metric_search_terms, metric_search_all, lookback_plus_one, pixel_map, pixel_coverage, columns_segmented, columns_quantiles, busiest_column, strip_saturation, heatmap_cells, graphite_parse, path_codec, split_names, axis_labels, fast_mod, half_precision, kll_quantiles, tdigest_quantiles, windowed_records, demo_records)}


_OBS = "obs AS (SELECT 'events.' || event_type AS metric, epoch_us(ts) AS us, value, event_id AS id FROM events WHERE value IS NOT NULL AND isfinite(value))"
_USERS = "names AS (SELECT DISTINCT 'events.' || event_type || '.u' || user_id AS metric FROM events)"


def _records(period: int, name: str = "rec") -> str:
    us = period // 1000
    return f"""{name} AS (SELECT metric, (us // {us}) * {period} AS start_ns, (us // {us} + 1) * {period} AS end_ns, count(*) AS observations, min(value) AS mn, max(value) AS mx,
    arg_min(id, struct_pack(v := value, t := us, i := id)) AS min_id, arg_max(id, struct_pack(v := value, t := -us, i := -id)) AS max_id FROM obs GROUP BY metric, us // {us})"""


_PX = f"greatest(0, {WIDTH} - (({NOW} - {{}} + {WEEK // WIDTH} - 1) // {WEEK // WIDTH}))"
_SEEN = f"seen AS (SELECT * EXCLUDE nxt FROM (SELECT *, lead(end_ns) OVER (PARTITION BY metric ORDER BY end_ns) AS nxt FROM rec WHERE end_ns < {NOW}) WHERE coalesce(nxt, {NOW - WEEK}) >= {NOW - WEEK})"
_SEGMENTS = f"""cov AS (SELECT metric, end_ns, unnest(range({_PX.format('start_ns')}, least({_PX.format('end_ns')}, {WIDTH - 1}) + 1)) AS px FROM seen),
pix AS (SELECT metric, px, list(end_ns ORDER BY end_ns) AS ends FROM cov GROUP BY metric, px),
brk AS (SELECT *, CASE WHEN lag(px) OVER w IS NULL OR lag(px) OVER w <> px - 1 OR lag(ends) OVER w <> ends THEN 1 ELSE 0 END AS new FROM pix WINDOW w AS (PARTITION BY metric ORDER BY px)),
run AS (SELECT *, sum(new) OVER (PARTITION BY metric ORDER BY px) AS run FROM brk),
seg AS (SELECT metric, min(px) AS x, count(*) AS w, any_value(ends) AS ends FROM run GROUP BY metric, run)"""
_COLUMNS = f"""WITH {_OBS}, {_records(SIX_HOURS)}, {_SEEN}, {_SEGMENTS},
own AS (SELECT metric, x, w, unnest(ends) AS end_ns FROM seg),
rates AS (SELECT o.metric, o.x, o.w, avg(r.observations / ((r.end_ns - r.start_ns) / 1e9)) AS obs_sec FROM own o JOIN rec r ON r.metric = o.metric AND r.end_ns = o.end_ns GROUP BY ALL)"""
_NAMED = "SELECT metric FROM names WHERE {} ORDER BY metric LIMIT {}"
_Q = "[{}]".format(", ".join(map(str, QS)))
_WRITES = "w AS (SELECT 'events.' || event_type AS metric, event_id * 100 + event_id * 7919 % 1000 AS seq, epoch_us(ts) * 1000 AS end_ns FROM events)"

ORACLE_SQL: dict[str, str] = {
    "finite_filter": "SELECT 'events.' || event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 7 > 3 AND value IS NOT NULL GROUP BY ALL",
    "window_records": f"WITH {_OBS}, {_records(SIX_HOURS)} SELECT metric, start_ns, end_ns, observations, mn AS min, mx AS max, CAST(1 AS BIGINT) AS merged FROM rec",
    "window_minmax_ids": f"WITH {_OBS}, {_records(DAY)} SELECT metric, start_ns, mn AS min, min_id, mx AS max, max_id FROM rec",
    "window_minmax_ids_text": f"""WITH obs AS (SELECT 'events.' || event_type AS metric, epoch_us(ts) AS us, value, 'e' || event_id AS id FROM events WHERE value IS NOT NULL AND isfinite(value))
SELECT metric, (us // {DAY // 1000}) * {DAY} AS start_ns, min(value) AS min, arg_min(id, struct_pack(v := value, t := us, i := id)) AS min_id, max(value) AS max, arg_min(id, struct_pack(v := -value, t := us, i := id)) AS max_id
FROM obs GROUP BY metric, us // {DAY // 1000}""",
    "graphite_records": f"""WITH obs AS (SELECT 'events.' || event_type AS metric, epoch_us(ts) AS us, event_id::DOUBLE AS value, event_id AS id FROM events WHERE event_id % 7 <> 0), {_records(DAY)}
SELECT metric, start_ns, observations, mn AS min, mx AS max, min_id, max_id FROM rec""",
    "window_quantiles": f"WITH {_OBS}, q AS (SELECT metric, (us // {DAY // 1000}) * {DAY} AS start_ns, quantile_cont(value, {_Q}) AS qs FROM obs GROUP BY ALL) SELECT metric, start_ns, k, round(qs[k + 1], 6) AS v FROM q, range({len(QS)}) t(k)",
    "order_records": f"""WITH obs AS (SELECT 'orders.' || o_orderstatus || '.' || o_orderpriority AS metric, epoch_us(o_orderdate) AS us, o_totalprice AS value, o_orderkey AS id FROM orders), {_records(30 * DAY)}
SELECT metric, start_ns, observations, mn AS min, mx AS max, min_id, max_id FROM rec""",
    "lineitem_quantiles": f"WITH q AS (SELECT 'lineitem.' || l_returnflag || '.' || l_linestatus AS metric, quantile_cont(l_extendedprice, {_Q}) AS qs FROM lineitem GROUP BY ALL) SELECT metric, k, round(qs[k + 1], 6) AS v FROM q, range({len(QS)}) t(k)",
    "merge_records": f"""WITH {_OBS}, {_records(HOUR)} SELECT metric, start_ns // {DAY} AS day, min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(sum(observations) AS BIGINT) AS observations, min(mn) AS min, max(mx) AS max,
arg_min(min_id, struct_pack(v := mn, t := start_ns, i := min_id)) AS min_id, arg_max(max_id, struct_pack(v := mx, t := -start_ns, i := -max_id)) AS max_id, count(*) AS merged FROM rec GROUP BY metric, start_ns // {DAY}""",
    "merge_quantiles_exact": f"WITH {_OBS}, q AS (SELECT metric, us // {DAY // 1000} AS day, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qs FROM obs GROUP BY ALL) SELECT metric, day, k, round(qs[k + 1], 6) AS v FROM q, range(5) t(k)",
    "cdf_exact": f"WITH {_OBS} SELECT metric, (us // {DAY // 1000}) * {DAY} AS start_ns, round(count(*) FILTER (value <= 25.0) / count(*), 9) AS rank FROM obs GROUP BY ALL",
    "obs_per_sec": f"WITH {_OBS}, {_records(HOUR)} SELECT metric, round(avg(observations / 3600.0::DOUBLE), 9) AS obs_sec FROM rec GROUP BY metric",
    "latest_record": f"WITH {_OBS}, {_records(SIX_HOURS)} SELECT metric, start_ns, end_ns, observations, mn AS min, mx AS max FROM rec QUALIFY row_number() OVER (PARTITION BY metric ORDER BY end_ns DESC) = 1",
    "series_scan_before": f"WITH {_OBS}, {_records(SIX_HOURS)} SELECT metric, start_ns, end_ns, observations FROM rec WHERE metric = 'events.click' AND end_ns < {NOW - WEEK} ORDER BY end_ns DESC",
    "monotonic_accept": f"WITH {_WRITES} SELECT metric, seq, end_ns FROM (SELECT *, max(end_ns) OVER (PARTITION BY metric ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w) WHERE before IS NULL OR end_ns > before",
    "monotonic_accept_stored": f"""WITH {_WRITES}, s AS (SELECT metric, max(end_ns) AS last FROM w WHERE end_ns < {MIDDLE} GROUP BY metric)
SELECT metric, seq, end_ns FROM (SELECT w.*, s.last, max(end_ns) OVER (PARTITION BY w.metric ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w LEFT JOIN s ON s.metric = w.metric WHERE end_ns >= {MIDDLE})
WHERE (before IS NULL OR end_ns > before) AND (last IS NULL OR end_ns > last)""",
    "retention_topn": f"WITH {_OBS}, {_records(SIX_HOURS)}, b AS (SELECT metric, end_ns, (row_number() OVER (PARTITION BY metric ORDER BY end_ns) - 1) // 7 AS block FROM rec) SELECT metric, end_ns FROM b QUALIFY block >= max(block) OVER (PARTITION BY metric) - 3",
    "metric_names": f"WITH {_USERS} SELECT metric FROM names ORDER BY metric",
    "name_union": "SELECT 'events.' || event_type AS metric FROM events UNION SELECT 'orders.' || o_orderstatus || '.' || o_orderpriority FROM orders UNION SELECT 'lineitem.' || l_returnflag || '.' || l_linestatus FROM lineitem ORDER BY 1",
    "metric_search_substring": f"WITH {_USERS} {_NAMED.format("metric LIKE '%urch%'", 1000)}",
    "metric_search_glob": f"WITH {_USERS} {_NAMED.format("regexp_matches(metric, '[.]click[.]u1[0-9]')", 1000)}",
    "metric_search_terms": f"WITH {_USERS} {_NAMED.format("metric LIKE 'events.sign%' AND metric LIKE '%.u12%'", 10)}",
    "metric_search_all": f"WITH {_USERS} {_NAMED.format('true', 10)}",
    "lookback_plus_one": f"WITH {_OBS}, {_records(SIX_HOURS)}, {_SEEN} SELECT metric, start_ns, end_ns FROM seen",
    "pixel_map": f"WITH {_OBS}, {_records(SIX_HOURS)} SELECT metric, start_ns, {_PX.format('start_ns')} AS start_px, {_PX.format('end_ns')} AS end_px FROM rec",
    "pixel_coverage": f"WITH {_OBS}, {_records(SIX_HOURS)}, {_SEEN}, {_SEGMENTS} SELECT metric, px, count(*) AS n FROM cov GROUP BY ALL",
    "columns_segmented": f"WITH {_OBS}, {_records(SIX_HOURS)}, {_SEEN}, {_SEGMENTS} SELECT metric, x, w, len(ends) AS n, ends[1] AS first_end FROM seg",
    "columns_quantiles": f"""{_COLUMNS}, q AS (SELECT o.metric, o.x, o.w, quantile_cont(b.value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qs FROM own o JOIN obs b ON b.metric = o.metric AND (b.us // {SIX_HOURS // 1000} + 1) * {SIX_HOURS} = o.end_ns GROUP BY ALL)
SELECT q.metric, q.x, q.w, round(r.obs_sec, 9) AS obs_sec, k, round(qs[k + 1], 6) AS v FROM q JOIN rates r ON r.metric = q.metric AND r.x = q.x, range(5) t(k)""",
    "busiest_column": f"{_COLUMNS} SELECT metric, x, round(obs_sec, 9) AS obs_sec FROM rates WHERE round(obs_sec, 9) > 0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(obs_sec, 9) DESC, x DESC) = 1",
    "strip_saturation": f"WITH {_OBS}, {_records(SIX_HOURS)} SELECT metric, start_ns, CAST(255 - floor(observations / max(observations) OVER (PARTITION BY metric) * 255) AS INTEGER) AS grey FROM rec",
    "heatmap_cells": f"""WITH {_OBS}, day AS (SELECT metric, us // {DAY // 1000} AS x, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qs FROM obs GROUP BY ALL),
last AS (SELECT metric, max(x) AS x FROM day GROUP BY metric), scale AS (SELECT o.metric, list(o.value) AS vs FROM obs o JOIN last l ON l.metric = o.metric AND o.us // {DAY // 1000} = l.x GROUP BY o.metric)
SELECT d.metric, d.x, CAST(y AS INTEGER) AS y, CAST(floor(len(list_filter(s.vs, lambda v: v <= d.qs[y + 1] + 1e-9)) / len(s.vs) * 255) AS INTEGER) AS color FROM day d JOIN scale s ON s.metric = d.metric, range(5) t(y)""",
    "graphite_parse": "SELECT CASE WHEN event_id % 5 <> 0 THEN 'events.' || event_type ELSE '-' END AS metric, event_id % 5 = 0 AS bad, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "path_codec": f"WITH {_USERS} SELECT metric, replace(metric, '.', '/') AS path, metric AS back FROM names",
    "split_names": f"WITH {_USERS} SELECT metric, split_part(metric, '.', 1) AS head, substring(metric, strpos(metric, '.') + 1) AS tail FROM names",
    "axis_labels": f"""WITH {_OBS}, {_records(HOUR)}, t AS (SELECT unnest(range(({NOW - 2 * DAY} // {2 * HOUR} + 1) * {2 * HOUR}, {NOW - DAY} + 1, {2 * HOUR})) AS end_ns)
SELECT t.end_ns, strftime(make_timestamp(t.end_ns // 1000), '%-m/%-d @ %H:%M') AS label, count(r.metric) AS n FROM t LEFT JOIN rec r ON r.end_ns = t.end_ns GROUP BY ALL""",
    "fast_mod": "SELECT (((event_id * 2654435761) % 4294967296) * 10) >> 32 AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "half_precision": "SELECT event_id AS id, CASE WHEN abs(value) >= 0.00006103515625 AND abs(value) < 65520 THEN round_even(value / pow(2, floor(log2(abs(value))) - 10), 0) * pow(2, floor(log2(abs(value))) - 10) ELSE value END AS half FROM events WHERE value IS NOT NULL",
    "windowed_records": f"WITH {_OBS}, {_records(HOUR // 6)} SELECT metric, start_ns, end_ns, observations, mn AS min, mx AS max, min_id, max_id FROM rec",
}
