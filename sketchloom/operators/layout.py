"""How a graph is laid out around its heatmap: axes, key and observation strip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from sketchloom.functions.driver import axis_labels_ns
from sketchloom.operators.heatmap import palette, raster

#: Fixed values, in pixels: between vertical labels, the key and the space before it, the strip, an axis before its text, a character.
LABEL_GAP, KEY_WIDTH, KEY_PADDING, STRIP, TEXT_OFFSET, ADVANCE = 30, 10, 5, 5, 13, 6


@dataclass(frozen=True)
class Label:
    position: float  # from 0 to 1 along the axis
    text: str


def _levels(height: int) -> list[float]:
    return [y / height for y in range(0, height - LABEL_GAP + 1, LABEL_GAP)] + [1.0]


def left_labels(height: int) -> list[Label]:
    """Ranks, from 1 at the top to 0."""
    return [Label(p, f"{1 - p:.2f}") for p in _levels(height)]


def right_labels(height: int, quantile: Callable[[float], float]) -> list[Label]:
    """The quantiles of the ranks at the left, to three digits."""
    return [Label(p, f"{quantile(1 - p):#.3g}") for p in _levels(height)]


def bottom_labels(now_ns: int, span_ns: int, width: int) -> list[Label]:
    """Times, as month/day @ hour:minute in UTC."""
    def text(t: int) -> str:
        at = np.datetime64(t // 1_000_000_000, "s").item()
        return f"{at.month}/{at.day} @ {at:%H:%M}"

    return [Label(1 - (now_ns - t) / span_ns, text(t)) for t in axis_labels_ns(now_ns, span_ns, width)]


def axis_width(labels: list[Label]) -> int:
    return TEXT_OFFSET + max((ADVANCE * len(x.text) for x in labels), default=0)


@dataclass(frozen=True)
class Layout:
    """Where the heatmap lies in a picture of width x height, and the axes' labels."""

    width: int
    height: int
    x: int
    y: int
    heatmap_width: int
    heatmap_height: int
    left: list[Label]
    right: list[Label]
    bottom: list[Label]


def layout(width: int, height: int, now_ns: int, span_ns: int, quantile: Callable[[float], float], padding: int = 0, bottom_height: int = 30) -> Layout:
    """The layout of a graph; too small a picture raises an error. `bottom_height`: of the lower axis with its text."""
    room = height - bottom_height - STRIP
    if room < 1:
        raise ValueError("too small")
    left, right = left_labels(room), right_labels(room, quantile)
    inner = width - (axis_width(left) + KEY_PADDING + KEY_WIDTH + axis_width(right))
    if inner < 1:
        raise ValueError("too small")
    return Layout(width + 2 * padding, height + 2 * padding, padding + axis_width(left), padding + STRIP, inner, room, left, right, bottom_labels(now_ns, span_ns, width))


def picture(place: Layout, cells: list[dict], cols: list[dict], colors: int) -> np.ndarray:
    """The heatmap with the observation strip above it, the key beside it and the axes' lines and ticks; labels are given, not drawn."""
    image = np.full((place.height, place.width, 3), 255, np.uint8)
    bottom, right = place.y + place.heatmap_height, place.x + place.heatmap_width
    image[place.y : bottom, place.x : right] = raster(cells, place.heatmap_width, place.heatmap_height, colors)
    most = max((c["obs_sec"] or 0.0 for c in cols), default=0.0)
    for c in cols:
        grey = 255 - int((c["obs_sec"] or 0.0) / most * 255) if most else 255
        image[place.y - STRIP : place.y, place.x + c["x"] : place.x + c["x"] + c["w"]] = grey
    ramp = palette(colors)
    key = right + KEY_PADDING
    for y in range(place.heatmap_height):
        image[place.y + y, key : key + KEY_WIDTH] = ramp[int((place.heatmap_height - 1 - y) * (colors - 1) / max(1, place.heatmap_height - 1))]
    image[place.y : bottom, place.x - 1] = 0
    image[bottom : bottom + 1, place.x : right] = 0
    for label in place.left:
        image[place.y + int((place.heatmap_height - 1) * label.position), place.x - 10 : place.x] = 0
    for label in place.bottom:
        image[bottom : bottom + 10, place.x + int((place.heatmap_width - 1) * label.position)] = 0
    return image
