"""The driver's tables as observations: metric, us (since 1970), value, id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.scalar import epoch_us


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("events."), "event_type").alias("metric"), epoch_us(F.col("ts"), dict(rows.dtypes)["ts"]).alias("us"), "value", F.col("event_id").alias("id"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric for each type and user."""
    rows = _read(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("events."), "event_type", F.lit(".u"), F.col("user_id").cast("string")).alias("metric"), epoch_us(F.col("ts"), dict(rows.dtypes)["ts"]).alias("us"), "value", F.col("event_id").alias("id"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return rows.select(F.concat_ws(".", F.lit("orders"), "o_orderstatus", "o_orderpriority").alias("metric"), epoch_us(F.col("o_orderdate"), dict(rows.dtypes)["o_orderdate"]).alias("us"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.concat_ws(".", F.lit("lineitem"), "l_returnflag", "l_linestatus").alias("metric"), epoch_us(F.col("l_shipdate"), dict(rows.dtypes)["l_shipdate"]).alias("us"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
