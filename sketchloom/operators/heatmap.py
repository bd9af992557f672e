"""Columns into heatmap cells, and cells into a picture."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.operators.kinds import kind, sorted_cdf

#: Points of a sketch's quantile table.
TABLE = 257


def scale_of(latest: DataFrame, kind_name: str = "exact") -> DataFrame:
    """(metric, values): the sorted values that give a metric's colour scale, from its latest record.

    Of a sketch, TABLE of its quantiles; so that a rank can be asked of each cell.
    """
    values = F.col("distribution") if kind_name == "exact" else kind(kind_name).quantiles(F.col("distribution"), [k / (TABLE - 1) for k in range(TABLE)])
    return latest.select("metric", values.alias("values"))


def cells(cols: DataFrame, scale: DataFrame, height: int, colors: int, slack: float = 1e-9) -> DataFrame:
    """(metric, x, w, y, color): y from 0 at the lowest quantile; the color is the rank, in the scale, of the column's quantile at y.

    The scale has one row a metric; it joins by metric, and each of a column's quantiles is
    ranked once. Values up to `slack` above a quantile count as equal to it: quantiles between
    neighbours are sums that may end a last place off.
    """
    if height < 2 or colors < 1:
        raise ValueError("a height of 2 and a color at least")
    color = lambda v: F.floor(sorted_cdf(F.col("values"), v + F.lit(slack)) * (colors - 1)).cast("int")
    rows = cols.join(scale, "metric").select("metric", "x", "w", F.transform("data", color).alias("colors"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    at = F.floor(F.col("y") * (F.size("colors") - 1) / F.lit(float(height - 1))).cast("int")
    return rows.select("metric", "x", "w", "y", F.element_at("colors", at + 1).alias("color"))


def palette(colors: int = 256) -> np.ndarray:
    """Dark violet over blue and green to yellow: colors x RGB, straight between a few fixed points."""
    points = np.array([[68, 1, 84], [59, 82, 139], [33, 145, 140], [94, 201, 98], [253, 231, 37]])
    at = np.linspace(0, len(points) - 1, max(colors, 1))
    return np.stack([np.interp(at, np.arange(len(points)), points[:, k]) for k in range(3)], axis=1).round().astype(np.uint8)


def raster(rows: list, width: int, height: int, colors: int) -> np.ndarray:
    """height x width x RGB of one metric's cells, y upwards; white where no column is."""
    image = np.full((height, width, 3), 255, np.uint8)
    ramp = palette(colors)
    for r in rows:
        image[height - 1 - r["y"], r["x"] : r["x"] + r["w"]] = ramp[r["color"]]
    return image


def png(image: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    height, width, _ = image.shape

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = b"".join(b"\0" + image[y].tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
