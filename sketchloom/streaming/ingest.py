"""Streams of observations into windowed records, and records into the store.

Event time replaces time of arrival: a watermark closes windows, and what comes later is
dropped. The sink is a micro-batch that applies the monotonic rule before it appends, so that a
repeated batch writes nothing twice. A stream's last windows stay open when it ends; flush()
makes records of them from the observations that are left.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sketchloom.operators import series
from sketchloom.operators.kinds import kind
from sketchloom.operators.records import finite


def windowed(observations: DataFrame, period: str = "10 minutes", late: str = "10 minutes", kind_name: str | None = "kll") -> DataFrame:
    """Records of a stream with metric, ts (timestamp), value and id; also of a batch, without a watermark."""
    rows = observations.where(finite(F.col("value")))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    us = F.unix_micros("ts")
    told = [F.count(F.lit(1)).alias("observations"), F.min(F.struct("value", us.alias("us"), "id")).alias("least"), F.min(F.struct((-F.col("value")).alias("value"), us.alias("us"), "id")).alias("most")]
    distribution = kind(kind_name).build(F.col("value")) if kind_name else F.max(F.lit(None).cast("binary"))
    found = rows.groupBy("metric", F.window("ts", period)).agg(*told, distribution.alias("distribution"))
    return found.select("metric", (F.unix_micros("window.start") * 1000).alias("start_ns"), (F.unix_micros("window.end") * 1000).alias("end_ns"), "observations", F.col("least.value").alias("min"), (-F.col("most.value")).alias("max"), F.col("least.id").alias("min_id"), F.col("most.id").alias("max_id"), F.lit(1).cast("long").alias("merged"), F.lit(kind_name).alias("kind"), "distribution")


def append_batch(records: DataFrame, path: str, told: Callable[[dict[str, float]], None] | None = None) -> None:
    """Appends what the monotonic rule accepts against what the store at `path` has.

    What ended before all of the batch can refuse none of it, so that of the store only what
    ends later is read: Parquet's statistics leave out the files and row groups before. The
    batch is computed once. `told` gets its measures: metric_dump_duration (seconds),
    metric_writes, metric_skips and metric_errors; an error ends the batch, which the stream
    repeats.
    """
    spark, began = records.sparkSession, time.monotonic()
    batch, fresh, n, wrote = records.persist(), None, 0, 0
    try:
        first = batch.agg(F.count(F.lit(1)).alias("n"), F.min("end_ns").alias("end_ns")).first()
        n = first.n
        if n:
            fresh = series.accepted(batch, _ends(spark, records, path, first.end_ns), order="end_ns").persist()
            wrote = fresh.count()
            series.write(fresh, path)
    except Exception:
        if told:
            told({"metric_dump_duration": time.monotonic() - began, "metric_writes": 0, "metric_skips": 0, "metric_errors": max(1, n)})
        raise
    finally:
        for cached in (x for x in (fresh, batch) if x is not None):
            cached.unpersist()
    if told:
        told({"metric_dump_duration": time.monotonic() - began, "metric_writes": wrote, "metric_skips": n - wrote, "metric_errors": 0})


def _ends(spark: SparkSession, records: DataFrame, path: str, first: int) -> DataFrame | None:
    """(metric, end_ns) of the store's records that end at `first` or later; None without a store."""
    try:
        return stored(spark, path, records.schema).select("metric", "end_ns").where(F.col("end_ns") >= F.lit(first).cast("long"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def store(records: DataFrame, path: str, checkpoint: str, period: str | None = None, told: Callable[[dict[str, float]], None] | None = None) -> StreamingQuery:
    """Starts a query that appends closed windows to the store: on every `period`, or once over what is there."""
    writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_batch(batch, path, told))
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def peek(records: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that keeps the open windows' current state in the table `name`, for looking at without closing them."""
    writer = records.writeStream.outputMode("update").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def flush(observations: DataFrame, path: str, period: str = "10 minutes", kind_name: str | None = "kll") -> None:
    """Appends records of the windows that a stream over these (batch) observations left open: those that end after the metric's last stored record."""
    append_batch(windowed(observations, period, kind_name=kind_name), path)


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The store's records; files that can't be read are skipped, with a line in the log."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(path)
