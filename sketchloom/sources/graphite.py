"""Graphite lines: metric, value and a time, parted by single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers as the protocol has them; Spark's casts would take 1d and 1.5f too.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _fields(line: str) -> tuple[Column, Column]:
    """The metric and the number of a line; null of a bad one."""
    parts = F.split(F.col(line), " ")
    second = F.get(parts, F.lit(1))
    number = F.when((F.size(parts) == 3) & second.rlike(NUMBER), second.try_cast("double"))
    return F.when(number.isNotNull(), F.get(parts, F.lit(0))), number


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """metric, value, `bad` and the other columns of each line: three fields, of which the second is a number, else bad. The third is not read."""
    metric, number = _fields(line)
    others = [c for c in lines.columns if c not in {line, "metric", "value", "bad"}]
    return lines.select(metric.alias("metric"), number.alias("value"), number.isNull().alias("bad"), *others)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Observations (metric, us, value, id) of text files; `us` is the files' time of modification, as lines bear no time of arrival, and there are no ids."""
    lines = spark.read.text(path).select("value", F.unix_micros(F.col("_metadata.file_modification_time")).alias("us"))
    return parse(lines).where(~F.col("bad")).select("metric", "us", "value", F.lit(None).cast("long").alias("id"))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of observations from a text socket, for development; ts is the time of arrival."""
    lines = spark.readStream.format("socket").options(host=host, port=port, includeTimestamp=True).load()
    return parse(lines).where(~F.col("bad")).select("metric", F.col("timestamp").alias("ts"), "value", F.lit(None).cast("long").alias("id"))
