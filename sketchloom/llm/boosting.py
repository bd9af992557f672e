"""Gradient-boosted trees for a binary label, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: node k has children 2k+1 and 2k+2; `value` holds for its leaves."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.split[node])
        return self.value[node]


def _grown(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    inner = (1 << depth) - 1
    feature, split, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(grad), np.int64)
    for level in range(depth):
        first, nodes = (1 << level) - 1, 1 << level
        gain = np.zeros(nodes)
        at = node - first
        for j, edge in enumerate(edges):
            width = len(edge) + 1
            key = at * width + bins[:, j]
            g = np.bincount(key, grad, nodes * width).reshape(nodes, width)
            h = np.bincount(key, hess, nodes * width).reshape(nodes, width)
            gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
            gs, hs = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
            won = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            won = np.where((hl >= least) & (hs - hl >= least), won, 0)
            if not won.shape[1]:
                continue
            best = won.argmax(1)
            found = won[np.arange(nodes), best]
            for k in np.flatnonzero(found > gain + 1e-12):
                gain[k], feature[first + k], split[first + k] = found[k], j, edge[best[k]]
        cut = np.array([len(e) for e in edges])
        chosen = feature[node]
        threshold = np.array([np.searchsorted(edges[f], s) if np.isfinite(s) else cut[f] for f, s in zip(feature, split, strict=True)])
        node = 2 * node + 1 + (bins[np.arange(len(bins)), chosen] > threshold[node])
    leaves = 1 << depth
    g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
    return Tree(feature, split, np.concatenate([np.zeros(inner), g / (h + ridge)]), depth)


@dataclass
class Boosted:
    """Log odds of label 1."""

    base: float
    trees: list[Tree]
    rate: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t(x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)  # x <= edge: bin at most its index
    p = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(p / (1 - p))), [], rate)
    odds = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        tree = _grown(binned, edges, weight * (y - p), weight * p * (1 - p), depth, least * weight.mean() * 0.05, ridge)
        model.trees.append(tree)
        odds += rate * tree(x)
    return model


@dataclass
class Isotonic:
    """A rising function through block means, straight between them."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal x are pooled first."""
    xs, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    m = np.bincount(at, weight * y) / w
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for value, mean, size in zip(xs, m, w, strict=True):
        blocks.append([mean, size, value, value])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, size, _, last = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + mean * size) / (b[1] + size)
            b[1] += size
            b[3] = last
    return Isotonic(np.array([v for b in blocks for v in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]), np.array([b[0] for b in blocks for _ in range(1 + (b[2] < b[3]))]))
