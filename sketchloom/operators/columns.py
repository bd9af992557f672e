"""Records onto a grid of pixels, and pixels into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.scalar import per_second
from sketchloom.operators.kinds import kind


def pixel_size(span_ns: int, width: int) -> int:
    if width < 1 or span_ns < width:
        raise ValueError("a width of at least one pixel, and a nanosecond for each")
    return span_ns // width


def pixel_of(time_ns: Column, now_ns: int, span_ns: int, width: int) -> Column:
    """The pixel of a time: `now` is at `width`, what is older than the span at 0."""
    size = pixel_size(span_ns, width)
    back = F.call_function("div", F.lit(now_ns + size - 1).cast("long") - time_ns, F.lit(size).cast("long"))
    return F.greatest(F.lit(0).cast("long"), F.lit(width).cast("long") - back)


def covered(records: DataFrame, now_ns: int, span_ns: int, width: int) -> DataFrame:
    """A row for each pixel that a record covers, from its start's to its end's; at most `width` a record."""
    place = lambda c: pixel_of(F.col(c), now_ns, span_ns, width)
    rows = records.withColumns({"start_px": place("start_ns"), "end_px": F.least(place("end_ns"), F.lit(width - 1).cast("long"))})
    return rows.where("start_px <= end_px").withColumn("px", F.explode(F.sequence("start_px", "end_px")))


def segments(records: DataFrame, now_ns: int, span_ns: int, width: int) -> DataFrame:
    """Columns: runs of adjacent pixels that the same records cover: metric, x, w and `ends` (the records' ends, which tell them apart)."""
    pixels = covered(records.select("metric", "start_ns", "end_ns"), now_ns, span_ns, width).groupBy("metric", "px").agg(F.sort_array(F.collect_set("end_ns")).alias("ends"))
    by = Window.partitionBy("metric").orderBy("px")
    new = (F.lag("px").over(by).isNull() | (F.lag("px").over(by) != F.col("px") - 1) | (F.lag("ends").over(by) != F.col("ends"))).cast("long")
    runs = pixels.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("metric", "run").agg(F.min("px").alias("x"), F.count(F.lit(1)).alias("w"), F.first("ends").alias("ends"))
    return found.select("metric", "x", "w", "ends")


def columns(records: DataFrame, now_ns: int, span_ns: int, width: int, samples: int = 30, kind_name: str = "exact") -> DataFrame:
    """Each column's quantiles (`data`, samples + 1 of them) and mean observations a second."""
    runs = segments(records, now_ns, span_ns, width).select("metric", "x", "w", F.explode("ends").alias("end_ns"))
    own = runs.join(records, ["metric", "end_ns"])
    rate = F.avg(per_second(F.col("observations"), F.col("merged"), F.col("start_ns"), F.col("end_ns"))).alias("obs_sec")
    merged = kind(kind_name).merge(F.col("distribution")).alias("distribution")
    if kind_name == "tdigest":
        keys = ["metric", "x", "w"]
        found = own.groupBy(keys).agg(rate).join(own.groupBy(keys).agg(merged), keys)
    else:
        found = own.groupBy("metric", "x", "w").agg(rate, merged)
    data = kind(kind_name).quantiles(F.col("distribution"), [k / samples for k in range(samples + 1)])
    return found.select("metric", "x", "w", data.alias("data"), "obs_sec")


def busiest(cols: DataFrame) -> DataFrame:
    """Each metric's column of most observations a second, the last of equals."""
    top = F.max(F.struct("obs_sec", "x")).alias("top")
    return cols.where(F.col("obs_sec") > 0).groupBy("metric").agg(top).select("metric", F.col("top.x").alias("x"), F.col("top.obs_sec").alias("obs_sec"))
