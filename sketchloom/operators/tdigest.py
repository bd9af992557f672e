"""A merging t-digest: centroids sized by the arcsine scale function, in numpy."""

from __future__ import annotations

import numpy as np

COMPRESSION = 100.0


def _compressed(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours joined while they stay within one unit of the scale function."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    q = np.clip((np.cumsum(weights) - weights / 2) / total, 0, 1)
    unit = np.floor(compression * (np.arcsin(2 * q - 1) / np.pi + 0.5))
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    w = np.add.reduceat(weights, starts)
    return np.add.reduceat(means * weights, starts) / w, w


def _image(low: float, high: float, means: np.ndarray, weights: np.ndarray) -> bytes:
    return np.concatenate([[low, high], means, weights]).astype("<f8").tobytes()


def _parts(sketch: bytes) -> tuple[float, float, np.ndarray, np.ndarray]:
    x = np.frombuffer(sketch, "<f8")
    means, weights = x[2:].reshape(2, -1)
    return x[0], x[1], means, weights


def build(values: np.ndarray, compression: float = COMPRESSION) -> bytes:
    """The sketch of finite values; others are left out."""
    values = values[np.isfinite(values)]
    if not len(values):
        return b""
    return _image(values.min(), values.max(), *_compressed(values, np.ones(len(values)), compression))


def merge(sketches: list[bytes | None], compression: float = COMPRESSION) -> bytes:
    parts = [_parts(s) for s in sketches if s]
    if not parts:
        return b""
    means, weights = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    return _image(min(p[0] for p in parts), max(p[1] for p in parts), *_compressed(means, weights, compression))


def _curve(sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (shares) and values that quantiles lie between: extremes and centroids' middles."""
    low, high, means, weights = _parts(sketch)
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    return np.concatenate([[0.0], middle, [1.0]]), np.concatenate([[low], means, [high]])


def quantiles(sketch: bytes, qs: list[float]) -> np.ndarray:
    if not sketch:
        return np.full(len(qs), np.nan)
    return np.interp(qs, *_curve(sketch))


def cdf(sketch: bytes, x: float) -> float:
    if not sketch:
        return float("nan")
    ranks, values = _curve(sketch)
    if x < values[0]:
        return 0.0
    if x >= values[-1]:
        return 1.0
    at = int(np.searchsorted(values, x, "right")) - 1
    step = values[at + 1] - values[at]
    return float(ranks[at] + (ranks[at + 1] - ranks[at]) * ((x - values[at]) / step if step else 1.0))


def count(sketch: bytes) -> int:
    return int(round(_parts(sketch)[3].sum())) if sketch else 0
