"""Six demonstration series: two shapes of distribution, each with three drifts of its mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES, DRIFTS = ("normal", "exp"), {"increasing": 1, "stable": 0, "decreasing": -1}
DAY_US = 86_400_000_000


def observations(spark: SparkSession, now_us: int, records: int = 100, least: int = 300, seed: int = 42) -> DataFrame:
    """Observations of one day before `now_us`: `records` steps, each of `least` to 2 * least - 1 values; the mean starts at 1 and drifts by a step."""
    series = spark.createDataFrame([(f"{s}.{d}", s, drift) for s in SHAPES for d, drift in DRIFTS.items()], "metric string, shape string, drift int")
    rows = series.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(records - 1))))
    many = least + F.floor(F.rand(seed) * least).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), many)))
    mean = 1.0 + F.col("drift") * F.col("step")
    value = F.when(F.col("shape") == "normal", F.randn(seed + 1) * 50 + mean).otherwise(-F.log(1 - F.rand(seed + 2)) * mean)
    us = F.lit(now_us - DAY_US).cast("long") + F.floor((F.col("step") + F.col("k") / 1000.0) * (DAY_US // max(1, records))).cast("long")
    return rows.select("metric", us.alias("us"), value.alias("value"), (F.col("step") * 1000 + F.col("k")).cast("long").alias("id"))
