"""Observations into records, and records into fewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.scalar import per_second
from sketchloom.operators.kinds import kind
from sketchloom.schema import RECORD_FIELDS


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def observe(observations: DataFrame, period_ns: int, kind_name: str | None = "exact") -> DataFrame:
    """One record for each metric and each period (aligned to 1970) with a finite value.

    min_id and max_id are those of the first observation, by time and id, that has the extreme;
    ids are of any type with an order, text and binary too.
    With kind_name None no distribution is kept. One shuffle, after partial aggregation.
    """
    if period_ns % 1000 or period_ns <= 0:
        raise ValueError("a period of whole microseconds")
    page = F.floor(F.col("us") / F.lit(period_ns // 1000)).cast("long")
    rows = observations.where(finite(F.col("value"))).withColumn("page", page)
    first = F.min(F.struct("value", "us", "id"))
    last = F.min(F.struct((-F.col("value")).alias("value"), "us", "id"))
    told = [F.count(F.lit(1)).alias("observations"), first.alias("least"), last.alias("most")]
    if kind_name:
        told.append(kind(kind_name).build(F.col("value")).alias("distribution"))
        if kind_name == "tdigest":  # a Python aggregate stands apart from native ones
            sketches = rows.groupBy("metric", "page").agg(told.pop())
            found = rows.groupBy("metric", "page").agg(*told).join(sketches, ["metric", "page"])
        else:
            found = rows.groupBy("metric", "page").agg(*told)
    else:
        found = rows.groupBy("metric", "page").agg(*told).withColumn("distribution", F.lit(None).cast("binary"))
    start = F.col("page") * F.lit(period_ns).cast("long")
    return found.select("metric", start.alias("start_ns"), (start + F.lit(period_ns).cast("long")).alias("end_ns"), "observations", F.col("least.value").alias("min"), (-F.col("most.value")).alias("max"), F.col("least.id").alias("min_id"), F.col("most.id").alias("max_id"), F.lit(1).cast("long").alias("merged"), F.lit(kind_name).alias("kind"), "distribution")


def merge(records: DataFrame, *by: str | Column, kind_name: str | None = None) -> DataFrame:
    """Records of each group as one: from the first start to the last end, everything summed or merged.

    A `merged` of 0 counts as 1. Records of more than one kind in a group, or of another kind
    than `kind_name`, raise an error. Without kind_name the distributions are left out.
    """
    base = F.when(F.col("merged") == 0, 1).otherwise(F.col("merged"))
    told = [F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("observations").alias("observations"), F.min(F.struct("min", "start_ns", "min_id")).alias("least"), F.min(F.struct((-F.col("max")).alias("max"), "start_ns", "max_id")).alias("most"), F.sum(base).alias("merged")]
    if kind_name:
        right = F.col("kind") == kind_name
        told.append(F.max(F.when(right, kind_name).otherwise(F.raise_error(F.concat(F.lit("can't merge a distribution of kind "), F.coalesce("kind", F.lit("null")))))).alias("kind"))
    found = records.groupBy(*by).agg(*told)
    if kind_name:
        names = [c for c in found.columns if c not in {"start_ns", "end_ns", "observations", "least", "most", "merged", "kind"}]
        if kind_name == "tdigest":
            found = found.join(records.groupBy(*by).agg(kind(kind_name).merge(F.col("distribution")).alias("distribution")), names)
        else:
            found = records.groupBy(*by).agg(*told, kind(kind_name).merge(F.col("distribution")).alias("distribution"))
    else:
        found = found.withColumns({"kind": F.lit(None).cast("string"), "distribution": F.lit(None).cast("binary")})
    names = [c for c in found.columns if c not in {*RECORD_FIELDS, "least", "most"} or c == "metric"]
    return found.select(*names, "start_ns", "end_ns", "observations", F.col("least.min").alias("min"), (-F.col("most.max")).alias("max"), F.col("least.min_id").alias("min_id"), F.col("most.max_id").alias("max_id"), "merged", "kind", "distribution")


def sampled(records: DataFrame, kind_name: str, samples: int) -> DataFrame:
    """records with `data`: their quantiles at 0, 1/samples, ... 1."""
    return records.withColumn("data", kind(kind_name).quantiles(F.col("distribution"), [k / samples for k in range(samples + 1)]))


def observations_per_second(records: DataFrame, *by: str | Column) -> DataFrame:
    """The mean over each group's records of their observations a second; records of no length are left out."""
    rate = per_second(F.col("observations"), F.col("merged"), F.col("start_ns"), F.col("end_ns"))
    return records.groupBy(*by).agg(F.avg(rate).alias("obs_sec"))
