"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Only lengths decide a packing, and there are at most `capacity` of them. So the plan is made
on the driver from a histogram of at most `capacity` rows: lengths in descending order, each
document to the tightest open bin with room, found through a segment tree over remaining
capacities. Documents of one length that go to bins of one remaining capacity are placed
together, as runs, which gives the placements that one document at a time would. Each
document then looks its place up by its rank among those of its length; ranks are counted in
salted groups, so that a common length is no burden on one task.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.common import written
from sketchloom.llm.tokens import encoder

#: Rows of one length that are ranked together.
RANKED = 1_000


class CapacityTree:
    """A segment tree of how many open bins have each remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` that an open bin has."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass
class Plan:
    """Runs of placements, by length and rank: from rank `rank` on, `each` documents to each bin from `bin` on, the first at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of documents by length and rank (from 0)."""
        key = lambda a, b: a.astype(np.int64) << 44 | b
        at = np.searchsorted(key(self.length, self.rank), key(length, rank), "right") - 1
        k, where = np.divmod(rank - self.rank[at], self.each[at])
        return self.bin[at] + k, self.offset[at] + where * length


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing for counts[length] documents of each length from 1 to capacity."""
    tree, open_bins = CapacityTree(capacity), {r: deque() for r in range(capacity + 1)}
    runs, bins = [], 0

    def fill(length: int, rank: int, first: int, n: int, each: int, remaining: int) -> None:
        runs.append((length, rank, first, each, capacity - remaining))
        if left := remaining - each * length:
            open_bins[left].append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            fresh = remaining is None
            if fresh:
                remaining = capacity
            each = remaining // length
            if fresh:
                first, n = bins, max(1, left // each)
            else:
                first, n = open_bins[remaining].popleft()
            use = min(n, max(1, left // each))
            each = min(each, left)
            if fresh:
                bins += use
            else:
                tree.add(remaining, -use)
                if use < n:
                    open_bins[remaining].appendleft((first + use, n - use))
            fill(length, rank, first, use, each, remaining)
            rank += use * each
            left -= use * each
    runs.sort()
    return Plan(*(np.array([r[k] for r in runs], dtype=np.int64) for k in range(5)), bins)


def pieces(df: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The token ids of each row's text, then `end`, in pieces of at most `capacity`.

    Columns: the id, piece (from 0), start (ids of the document before it), length, ids_crc32 and,
    with keep_ids, ids (binary: little-endian unsigned 32-bit). A null text is empty: one piece, of `end` alone.
    """
    names = [id_column, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = f"`{id_column}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = ["" if x is None else x for x in some.column(1).to_pylist()]
                rows: tuple[list, ...] = tuple([] for _ in names)
                for key, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    ids += last
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        for column, x in zip(rows, (key, k, start // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=False):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names=names)

    return df.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")).mapInArrow(cut, schema)


def with_salts(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """cut (with `__row`) with `__salt`: a group of about RANKED rows of a length."""
    salts = cut.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()] or [(1, 1)], "length long, __salts long")
    return cut.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64("__row"), "__salts")).drop("__salts")  # a row for each length


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """`cut` (rows with length from 1 to capacity) with sequence_id and offset.

    Rows that repeat are placed each on its own: a row is told by its place in the written table, which also salts the ranks.
    """
    spark, names = cut.sparkSession, cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    cut = written(cut.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    made = spark.sparkContext.broadcast(plan(counts, capacity))
    salted = with_salts(cut, counts)
    before = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__row")) - 1)
    ranked = ranked.join(before, ["length", "__salt"]).select(*names, (F.col("__rank") + F.col("__before")).alias("__rank"))
    at, by = len(names), names.index("length")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = made.value.place(batch.column(by).to_numpy(), batch.column(at).to_numpy()) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(looked_up, schema)


def pack(df: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Whole documents packed into as few sequences of at most `capacity` tokens as best-fit decreasing makes.

    Only documents longer than `capacity` are cut. Returns the columns of pieces() and
    sequence_id and offset; offsets in a sequence run from 0 without gaps. Null ids and
    repeated rows are packed like others; an empty table gives no rows.
    """
    return place(pieces(df, tokenizer, end, capacity, id_column, text, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pack(keep_ids=True): sequence_id, length, ids. A sequence has at most `capacity` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
