"""Column functions: the parts of names, half precision, times."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Castagnoli polynomial, its bits reversed: fixed value.
CRC32C = 0x82F63B78
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def head_of(metric: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(metric, ".", 1)


def tail_of(metric: Column) -> Column:
    """What stands after the first dot; empty without one."""
    at = F.instr(metric, ".")
    return F.when(at > 0, F.substring(metric, at + 1, F.length(metric))).otherwise(F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def epoch_us(ts: Column, kind: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is taken for UTC, whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)
    return F.unix_micros(ts)


def half(value: Column) -> Column:
    """value rounded to half precision (11 significant bits, ties to even) where its exponent is that of a normal half, else as it is."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    step = F.pow(F.lit(2.0), exponent - 10)
    return F.when((size >= 2.0**-14) & (size < 65520.0), F.rint(value / step) * step).otherwise(value)


def per_second(observations: Column, merged: Column, start_ns: Column, end_ns: Column) -> Column:
    """Observations a second of one base record; null for a record of no length. `merged` 0 counts as 1."""
    base = F.when(merged == 0, 1).otherwise(merged)
    return F.try_divide(observations.cast("double"), base * (end_ns - start_ns) / F.lit(1e9))


def fast_mod(n: Column, m: int) -> Column:
    """n scaled from 32 bits to 0 .. m - 1: the upper half of a product."""
    return F.shiftright(n.cast("long") * F.lit(m).cast("long"), 32)


def saturation(obs_sec: Column, most: Column) -> Column:
    """Grey of an observation strip: 255 without any, 0 at the most."""
    return F.when(most > 0, 255 - F.floor(obs_sec / most * 255)).otherwise(F.lit(255)).cast("int")


def crc32c_of(data: bytes) -> int:
    """CRC-32C of bytes."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for x in data:
        crc = crc >> 8 ^ table[(crc ^ x) & 0xFF]
    return crc ^ 0xFFFFFFFF


@functools.cache
def _crc_table() -> list[int]:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(CRC32C), table >> 1)
    return table.tolist()


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column as a long; null of null. Spark has no such function of its own."""

    @F.pandas_udf("long")
    def checked(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else crc32c_of(bytes(x))).astype("Int64")

    return checked(data)
