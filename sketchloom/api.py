"""What a caller asks for: a rendered metric or a search, with the defaults of the web routes."""

from __future__ import annotations

import base64
import json
import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions import search
from sketchloom.functions.driver import duration_ns
from sketchloom.operators import columns, heatmap, layout, series
from sketchloom.operators.kinds import kind


def number(text: str | None, default: int | float) -> int | float:
    """A parameter as a number of the default's type; what can't be read is the default."""
    try:
        return type(default)(text)
    except (TypeError, ValueError):
        return default


def duration(text: str | None, default: str) -> int:
    try:
        return duration_ns(text)
    except (TypeError, ValueError):
        return duration_ns(default)


@dataclass
class Request:
    """Parameters of a rendering; times in nanoseconds."""

    metric: str
    now_ns: int
    span_ns: int
    width: int = 1000
    height: int = 350
    padding: int = 0
    samples: int = 30

    @classmethod
    def of(cls, params: dict[str, str]) -> Request:
        if not params.get("metric"):
            raise ValueError("metric required")
        now = number(params.get("now"), time.time_ns())
        return cls(params["metric"], now, duration(params.get("duration"), "24h"), *(number(params.get(k), d) for k, d in (("width", 1000), ("height", 350), ("padding", 0), ("samples", 30))))


def render_columns(records: DataFrame, request: Request, kind_name: str = "exact") -> DataFrame:
    """The metric's columns over the span before now, the rightmost first; the width is that of the heatmap."""
    own = series.lookback(records.where(F.col("metric") == request.metric), request.now_ns, request.span_ns)
    return columns.columns(own, request.now_ns, request.span_ns, request.width, request.samples, kind_name).orderBy(F.col("x").desc())


def render_json(records: DataFrame, request: Request, kind_name: str = "exact") -> str:
    """The rendering as JSON: at most `width` columns."""
    rows = render_columns(records, request, kind_name).collect()
    newest = series.latest(records.where((F.col("metric") == request.metric) & (F.col("end_ns") < request.now_ns))).collect()
    last = newest[0].distribution if newest else None
    image = np.array(last, "<f8").tobytes() if isinstance(last, list) else bytes(last or b"")
    found = [{"X": r.x, "W": r.w, "Data": list(r.data), "ObsSec": r.obs_sec} for r in rows]
    return json.dumps({"metric": request.metric, "columns": found, "earliest": base64.b64encode(image).decode(), "now": request.now_ns, "duration": request.span_ns, "width": request.width, "height": request.height, "padding": request.padding})


def render_png(records: DataFrame, request: Request, colors: int = 256, kind_name: str = "exact") -> bytes:
    """The heatmap as a PNG file; white where there is no record."""
    own = records.where((F.col("metric") == request.metric) & (F.col("end_ns") < request.now_ns))
    cells = heatmap.cells(render_columns(records, request, kind_name), heatmap.scale_of(series.latest(own), kind_name), request.height, colors)
    rows = [r.asDict() for r in cells.collect()]  # at most width x height
    return heatmap.png(heatmap.raster(rows, request.width, request.height, colors))


def render_graph(records: DataFrame, request: Request, colors: int = 256, kind_name: str = "exact") -> tuple[bytes, layout.Layout]:
    """The whole graph as a PNG file, and its layout with the labels' texts. The width asked for is the picture's; a metric without records raises an error."""
    own = records.where((F.col("metric") == request.metric) & (F.col("end_ns") < request.now_ns))
    ranks = [k / 100 for k in range(101)]
    newest = series.latest(own).select(kind(kind_name).quantiles(F.col("distribution"), ranks).alias("q")).collect()
    if not newest:
        raise ValueError("no records")
    place = layout.layout(request.width, request.height, request.now_ns, request.span_ns, lambda q: float(np.interp(q, ranks, newest[0].q)), request.padding)
    inner = replace(request, width=place.heatmap_width, height=place.heatmap_height)
    cols = render_columns(records, inner, kind_name)
    cells = heatmap.cells(cols, heatmap.scale_of(series.latest(own), kind_name), inner.height, colors).collect()  # at most width x height
    return heatmap.png(layout.picture(place, [r.asDict() for r in cells], [r.asDict() for r in cols.select("x", "w", "obs_sec").collect()], colors)), place


def query(records: DataFrame, params: dict[str, str]) -> list[str]:
    """Names that match `query`, `results` (10) at most."""
    found = search.search(records, params.get("query", ""), number(params.get("results"), 10))
    return [r.metric for r in found.collect()]
