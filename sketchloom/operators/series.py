"""The store of records: which are accepted and kept, and how a series is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Nanoseconds of a range of a series: a day.
RANGE_NS = 86_400_000_000_000


def _range(order: str, width: int) -> Column:
    return F.call_function("div", F.col(order).cast("long"), F.lit(width).cast("long"))


def accepted(writes: DataFrame, stored: DataFrame | None = None, order: str = "seq", width: int = RANGE_NS) -> DataFrame:
    """The writes, in order of `order` (a long) by metric, that end after all before them and after what is stored.

    A refused write ends no later than one before, so that the running maximum of all ends is
    that of the accepted ones. A series is cut into ranges of `width` of its order, a window
    each; one starts from the maximum of those before it.
    """
    keys = ["metric", "__range"]
    rows = writes.withColumn("__range", _range(order, width))
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.max("end_ns").over(so_far))
    earlier = Window.partitionBy("metric").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = writes.groupBy("metric", _range(order, width).alias("__range")).agg(F.max("end_ns").alias("__top")).select(*keys, F.max("__top").over(earlier).alias("__earlier"))
    rows = rows.join(tops, keys).withColumn("__before", F.greatest("__before", "__earlier"))
    if stored is not None:
        last = stored.groupBy("metric").agg(F.max("end_ns").alias("__last"))
        rows = rows.join(last, "metric", "left").withColumn("__before", F.greatest("__before", "__last"))  # greatest skips nulls
    return rows.where(F.col("__before").isNull() | (F.col("end_ns") > F.col("__before"))).select(writes.columns)


def retained(records: DataFrame, cap: int, files: int, order: str = "end_ns", width: int = RANGE_NS) -> DataFrame:
    """What a ring of files of `cap` records keeps of each metric: the newest file and up to `files` full ones before; files 0 keeps all.

    Places are counted in ranges of `width` of the order, a window each.
    """
    if files == 0:
        return records
    keys = ["metric", "__range"]
    rows = records.withColumn("__range", _range(order, width)).withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    counts = records.groupBy("metric", _range(order, width).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy("metric")
    counts = counts.select(*keys, (F.sum("__n").over(every.orderBy("__range")) - F.col("__n")).alias("__base"), F.sum("__n").over(every).alias("__whole"))
    rows = rows.join(counts, keys).withColumn("__at", F.col("__at") + F.col("__base"))
    block = lambda at: F.floor(at / cap)
    return rows.where(block(F.col("__at")) >= block(F.col("__whole") - 1) - files).select(records.columns)


def before(records: DataFrame, metric: str, end_ns: int) -> DataFrame:
    """A metric's records that end before a time, newest first."""
    return records.where((F.col("metric") == metric) & (F.col("end_ns") < F.lit(end_ns).cast("long"))).orderBy(F.col("end_ns").desc())


def latest(records: DataFrame) -> DataFrame:
    """Each metric's record that ends last."""
    newest = records.groupBy("metric").agg(F.max_by(F.struct(*(c for c in records.columns if c != "metric")), "end_ns").alias("r"))
    return newest.select("metric", *(F.col(f"r.{c}").alias(c) for c in records.columns if c != "metric"))


def names(records: DataFrame) -> DataFrame:
    """Every metric once, in byte order."""
    return records.select("metric").distinct().orderBy("metric")


def union_of_names(*tables: DataFrame) -> DataFrame:
    """The metrics of all tables, once each, in byte order."""
    found = tables[0].select("metric")
    for t in tables[1:]:
        found = found.union(t.select("metric"))
    return found.distinct().orderBy("metric")


def lookback(records: DataFrame, now_ns: int, span_ns: int, extra: bool = True) -> DataFrame:
    """Records that end in [now - span, now) and, unless extra is false, each metric's last one before."""
    now, stop = F.lit(now_ns).cast("long"), F.lit(now_ns - span_ns).cast("long")
    rows = records.where(F.col("end_ns") < now)
    if not extra:
        return rows.where(F.col("end_ns") >= stop)
    last = rows.where(F.col("end_ns") < stop).groupBy("metric").agg(F.max("end_ns").alias("__last"))
    return rows.join(last, "metric", "left").where((F.col("end_ns") >= stop) | (F.col("end_ns") == F.col("__last"))).select(records.columns)


def write(records: DataFrame, path: str) -> None:
    """Appends records as Parquet, dealt by ranges of metric and end, so that no metric is one task's, and sorted so that a series and a time are found by row-group statistics."""
    records.repartitionByRange("metric", "end_ns").sortWithinPartitions("metric", "end_ns").write.mode("append").parquet(path)
