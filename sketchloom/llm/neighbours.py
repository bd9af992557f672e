"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Vectors are projected on random directions; each projection is a sorted array. A query's
window on an array is centred on its own projection. Windows start narrow and widen by a
factor each round (virtual rehashing): each round counts only what the windows newly take in.
A vector in at least `threshold` of the windows is a candidate and is verified by its exact
distance. A query ends when its k-th distance d is so small against the windows' half-width t
that a vector at distance d would have met the threshold with probability `recall`: its
projections lie within t each with probability 2 Phi(t / d) - 1, independently. Otherwise the
windows widen until they hold everything, so that every query gets its k neighbours.

Scale: vectors are dealt to blocks of about `block_rows` by a hash of their id and queries to
blocks of `query_rows`; a task has one of each, indexes the vectors and answers the queries,
and only k rows a query and block are merged. A query set is stated, and meets each block of
vectors once; nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Projections, the share of them that a candidate must collide in, and how fast windows widen.
PROJECTIONS = 48
SHARE = 0.5
WIDEN = 1.3


def width_for(recall: float, m: int, threshold: int) -> float:
    """t / d for which a vector at distance d is within t in at least `threshold` of m projections with probability `recall`."""
    low, high = 0.0, 8.0
    for _ in range(50):
        mid = (low + high) / 2
        p = erf(mid / sqrt(2))
        reached = sum(comb(m, j) * p**j * (1 - p) ** (m - j) for j in range(threshold, m + 1))
        low, high = (mid, high) if reached < recall else (low, mid)
    return high


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS, seed: int = 17) -> None:
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        projected = vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1).copy()
        # a first half-width at which a window holds a few dozen of the block
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0]))
        self.first = max(spread * 16 / max(16, len(ids)), 1e-12)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-widths by round, and where the queries' windows begin and end: (2, queries, rounds, projections)."""
        at = queries @ self.directions
        reach = float(np.maximum(np.abs(at - self.sorted[:, 0]), np.abs(at - self.sorted[:, -1])).max())
        rounds = 2 + max(0, int(np.ceil(np.log(max(reach, self.first) / self.first) / np.log(WIDEN))))
        halves = self.first * WIDEN ** np.arange(rounds)
        bounds = np.empty((2, len(queries), rounds, at.shape[1]), np.int32)
        for j, column in enumerate(self.sorted):
            bounds[0, :, :, j] = np.searchsorted(column, at[:, j, None] - halves, "left")
            bounds[1, :, :, j] = np.searchsorted(column, at[:, j, None] + halves, "right")
        return halves, bounds

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, threshold: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the row numbers and distances of the k nearest found, nearest first, ties to the smaller id; and how many were verified.

        The last round's windows hold all rows, so that there are k, or all but the query's own.
        """
        for at in range(0, len(queries), 256):
            halves, bounds = self.windows(queries[at : at + 256])
            for q, me in enumerate(own[at : at + 256]):
                yield self._found(queries[at + q], me, halves, bounds[0, q].tolist(), bounds[1, q].tolist(), k, threshold, ratio)

    def _found(self, query: np.ndarray, own: int, halves: np.ndarray, begins: list, ends: list, k: int, threshold: int, ratio: float) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(self.ids)
        counts = np.zeros(n, np.int64)
        checked = self.ids == own
        need = min(k, n - int(checked.sum()))
        rows, distances = np.zeros(0, np.int64), np.zeros(0)
        left = right = None
        for half, a, b in zip(halves if need else (), begins, ends, strict=False):
            if left is None:
                new = [o[i:j] for o, i, j in zip(self.order, a, b, strict=True)]
            else:
                new = [o[i:j] for o, i, j in zip(self.order, a, left, strict=True)] + [o[i:j] for o, i, j in zip(self.order, right, b, strict=True)]
            left, right = a, b
            counts += np.bincount(np.concatenate(new), minlength=n)
            found = np.flatnonzero((counts >= threshold) & ~checked)
            if len(found):
                checked[found] = True
                rows, distances = self._nearest(query, np.concatenate([rows, found]), k)
            if len(rows) >= need and distances.max() * ratio <= half:
                break
        return rows, distances, int(checked.sum())

    def _nearest(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of `rows` and their distances, ties to the smaller id: by products first, and exactly for those that may be among them."""
        if len(rows) > 4 * k:
            size = self.squares[rows] + query @ query
            rough = size - 2 * (self.vectors[rows] @ query)
            rows = rows[rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * size.max()]
        apart = self.vectors[rows] - query
        distances = np.sqrt((apart * apart).sum(axis=1))
        best = np.lexsort((self.ids[rows], distances))[:k]
        return rows[best], distances[best]


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", recall: float = 0.95, block_rows: int = 4096, query_rows: int = 2048, projections: int = PROJECTIONS) -> DataFrame:
    """The k nearest rows of df, by Euclidean distance, to each row of `queries`, but those with the query's own id.

    Returns query_id, rank (from 1), the id, score (the distance in double precision). Equal
    distances go to the smaller id; if df has fewer rows, all of them. Vectors that are null,
    zero, or have null or non-finite components, and rows with a null id, take no part; vectors
    of other lengths than the query's don't either. An id that repeats counts once, with the
    first of its vectors in order. Empty tables give no rows.
    """
    def clean(t: DataFrame) -> DataFrame:
        t = t.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return t.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v"))

    blocks = max(1, -(-df.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = clean(df).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("of", every(query_blocks)).withColumn("asks", F.lit(False))
    asked = clean(queries).withColumn("of", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("block", every(blocks)).withColumn("asks", F.lit(True))
    threshold = max(1, round(SHARE * projections))
    ratio = width_for(recall, projections, threshold)

    def answered(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        firsts = []
        for role in (False, True):
            own = np.flatnonzero(asks == role)
            order = own[np.lexsort((*values[own].T[::-1], ids[own]))]
            firsts.append(order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order)
        have, want = firsts
        out = [], [], []
        if len(have) and len(want):
            index = Index(ids[have], values[have], projections)
            for q, (rows, distances, _) in zip(want, index.search(values[want], ids[want], k, threshold, ratio), strict=True):
                out[0].append(np.full(len(rows), ids[q]))
                out[1].append(index.ids[rows])
                out[2].append(distances)
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float), strict=True)]
        return pa.table({"query_id": pa.array(joined[0]), "id": pa.array(joined[1]), "score": pa.array(joined[2])})

    columns = ["of", "block", "size", "id", "v", "asks"]
    found = vectors.select(columns).unionByName(asked.select(columns)).groupBy("of", "block", "size").applyInArrow(answered, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")
