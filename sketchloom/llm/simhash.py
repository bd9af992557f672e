"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in over half the hashes of a text's word shingles.
Texts whose fingerprints differ in at most `radius` bits are linked; links make groups.

Search: the 64 bits are dealt into parts, correlated bits together, and each part i gets a
threshold t_i with sum(t_i) = radius - parts + 1 (-1: the part is not probed). Of two
fingerprints within the radius, some part differs in at most t_i bits. A dynamic programme
picks the thresholds whose estimated candidates and keys cost least; the estimates come from
counts over all fingerprints. A part with threshold t is probed by masks: its bits less any t
of them; fingerprints that agree under a mask share a bucket and are verified.

Scale: only distinct fingerprints are searched, so copies cost nothing. A bucket above
`bucket_rows` is dealt anew by masks that add a part of its other bits (again the pigeonhole,
so no pair is lost) until it is small or has so few free bits that it can't be large. In a
task a bucket is searched by pairs if it is small, else through shared neighbours one bit
away, in space linear in the bucket; only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import LOWER_BYTES, join_spread, plain_names, words, written
from sketchloom.llm.components import connected_components

BITS = 64
#: Hashes summed at once: bounds the memory of a very long text.
CHUNK = 1 << 15
#: A bucket with so few free bits has at most 2 ** FREE distinct fingerprints.
FREE = 14
#: Up to so many fingerprints a bucket is searched by pairs.
PAIRWISE = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles, A-Z lower-cased; fewer words: of all; none, or null: 0."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found).translate(LOWER_BYTES)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    last = ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), last.tolist(), strict=True)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in islice(pairs, CHUNK)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """df without its texts, and their fingerprints as signed longs."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` bigint"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(len(keep))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*(f.name for f in keep), out])

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`")).mapInArrow(hashed, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set (64 x 64)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), CHUNK):
                both += bits[at : at + CHUNK].T @ bits[at : at + CHUNK]
            n += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(counted, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, count in rows:
        if i < 0:
            n = count
        else:
            both[i, j] = count
    return n, both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size, each grown greedily by the largest mean correlation with its members."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (related[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks_of_part(bits: list[int], threshold: int) -> list[int]:
    """Masks under one of which any two values agree that differ in at most `threshold` of the bits."""
    if threshold < 0:
        return []
    return [mask_of(bits) & ~mask_of(list(out)) for out in combinations(bits, min(threshold, len(bits)))]


def allocated(costs: list[dict[int, float]], total: int) -> list[int]:
    """A threshold for each part, `total` in sum, of least cost: dynamic programming over parts and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (spent, chosen) in best.items():
            for t, c in cost.items():
                if so_far + t not in step or spent + c < step[so_far + t][0]:
                    step[so_far + t] = (spent + c, [*chosen, t])
        best = step
    return best[total][1]


def probe_masks(fps: DataFrame, radius: int, parts: int, key_cost: float = 4.0) -> list[int]:
    """The masks to probe `fps` (distinct) by.

    A part's candidates at threshold 0 are the pairs that agree in it, counted over all
    fingerprints; each bit that may differ multiplies them by how often a pair differs there
    against how often it agrees.
    """
    n, both = bit_statistics(fps)
    groups = grouped_bits(n, both, parts)
    agree = [F.col("fp").bitwiseAND(F.lit(signed(mask_of(g)))) for g in groups]
    pairs = []
    for k, value in enumerate(agree):
        c = F.col("c").cast("double")
        pairs.append(fps.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(c * (c - 1) / 2).alias("pairs")).select(F.lit(k).alias("k"), "pairs"))
    counted = pairs[0]
    for more in pairs[1:]:
        counted = counted.unionByName(more)
    at_zero = {r.k: float(r.pairs or 0) for r in counted.collect()}
    p = np.clip(np.diag(both) / max(n, 1), 1e-6, 1 - 1e-6)
    odds = 2 * p * (1 - p) / (p * p + (1 - p) * (1 - p))
    costs = []
    for k, group in enumerate(groups):
        cost = {-1: 0.0}
        for t in range(min(radius, len(group)) + 1):
            wider, elementary = 0.0, np.zeros(t + 1)
            elementary[0] = 1
            for b in group:  # sums of products of t odds
                elementary[1:] += elementary[:-1] * odds[b]
            wider = elementary.sum()
            cost[t] = at_zero[k] * wider + key_cost * n * len(masks_of_part(group, t))
        costs.append(cost)
    thresholds = allocated(costs, radius - parts + 1)
    return [m for g, t in zip(groups, thresholds, strict=True) for m in masks_of_part(g, t)]


def split_masks(mask: int, radius: int) -> list[int]:
    """Masks that add to `mask` one of radius + 1 parts of its free bits each."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(free[k :: radius + 1]) for k in range(radius + 1)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (node, smallest node), by repeated minima."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b, as many as join what all of them join, fewer than twice the nodes: each round takes one out of every component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label, left, taken = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(left := left[label[x[left]] != label[y[left]]]):
        at = np.unique(np.concatenate([label[x[left]], label[y[left]]]), return_index=True)[1] % len(left)
        taken.append(left[np.unique(at)])
        node, top = forest(label[x[taken[-1]]], label[y[taken[-1]]])
        to = np.arange(len(nodes))
        to[node] = top
        label = to[label]
    own = np.concatenate(taken)
    return a[own], b[own]


def linked(key: np.ndarray, fp: np.ndarray, radius: int, free: int, stars: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (sorted; fingerprints distinct within a run) that join all which lie within the radius.

    With `stars` as stars of what is joined, else as links that lie within the radius themselves.

    `free`: the bits in which fingerprints of a run can differ. Large runs are searched through
    the values within half the radius of each fingerprint: for radius 2, those that share a
    value one bit away are within 2 bits of each other, and the other way round.
    """
    n = len(fp)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, int)
    sizes = np.diff(np.append(starts, n))
    large = (sizes > PAIRWISE) & (radius <= 2)
    found_a, found_b = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    small = ~large[run] if n else np.zeros(0, bool)
    k, f, d = run[small], fp[small], 1
    while len(f) > d:
        same = k[d:] == k[:-d]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
        found_a.append(f[:-d][near])
        found_b.append(f[d:][near])
        d += 1
    flips = np.array([1 << b for b in range(BITS) if free >> b & 1], np.uint64)
    for s in np.flatnonzero(large):
        own = fp[starts[s] : starts[s] + sizes[s]]
        for a, b in through_neighbours(own, flips, radius):
            found_a.append(a)
            found_b.append(b)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return (forest if stars else spanning)(np.concatenate(found_a), np.concatenate(found_b))


def through_neighbours(own: np.ndarray, flips: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a large run for radius up to 2, in space linear in it: chains of those that share a value."""
    if radius < 1:
        return
    if radius == 1:
        ordered = np.sort(own)
        for flip in flips:
            at = np.searchsorted(ordered, own ^ flip)
            hit = (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == own ^ flip)
            yield own[hit], own[hit] ^ flip
        return
    values = np.concatenate([own, *(own ^ flip for flip in flips)])
    owner = np.tile(np.arange(len(own)), len(flips) + 1)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    a, b = owner[order][:-1][same], owner[order][1:][same]
    yield own[a], own[b]


def near_links(fps: DataFrame, radius: int = 2, parts: int = 3, bucket_rows: int = 20_000, stars: bool = True) -> DataFrame:
    """Links (a, b: long) that join just those distinct fingerprints `fp` which chains of at most `radius` differing bits join.

    They are stars of what each task has joined, so there are no more than fingerprints by mask;
    without `stars`, fewer than twice as many, each within the radius itself.
    """
    if not 0 <= radius <= 2:
        raise ValueError("a radius from 0 to 2")
    spark = fps.sparkSession
    if not fps.limit(1).count():
        return spark.createDataFrame([], "a long, b long")
    masks = probe_masks(fps, radius, parts)
    settled, rows = [], fps.select("fp")
    dealt = rows.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    while True:
        value = F.col("fp").bitwiseAND(F.col("mask"))
        room = F.lit(BITS) - F.bit_count("mask")
        heavy = written(dealt.where(room > FREE).groupBy("mask", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("mask", "value"))
        met = [r.mask for r in heavy.select("mask").distinct().collect()]  # masks: a few dozen a round
        if not met:
            settled.append(dealt)
            break
        keyed = dealt.withColumn("value", value)
        settled.append(keyed.join(heavy, ["mask", "value"], "left_anti").select("fp", "mask"))
        finer = F.lit(None).cast("array<long>")
        for m in met:
            finer = F.when(F.col("mask") == m, F.array(*(F.lit(signed(x)) for x in split_masks(m & (1 << 64) - 1, radius)))).otherwise(finer)
        dealt = written(keyed.join(heavy, ["mask", "value"], "left_semi").select("fp", F.explode(finer).alias("mask")).distinct())
    dealt = settled[0]
    for more in settled[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            for m in np.unique(cols[1]):
                own = cols[:, cols[1] == m]
                a, b = linked(own[2], np.ascontiguousarray(own[0]).view(np.uint64), radius, ~int(m) & (1 << 64) - 1, stars)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            if not cols.shape[1]:
                continue
            held.append(cols)
            if sum(x.shape[1] for x in held) < 200_000:
                continue
            cols = np.concatenate(held, axis=1)
            more = (cols[1] != cols[1, -1]) | (cols[2] != cols[2, -1])
            cut = int(np.flatnonzero(more)[-1]) + 1 if more.any() else 0  # the last bucket may go on
            if cut:
                yield from out(cols[:, :cut])
            held = [cols[:, cut:]]
        if held:
            yield from out(np.concatenate(held, axis=1))

    return dealt.select("fp", "mask", "value").mapInArrow(searched, "a long, b long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, parts: int = 3, bucket_rows: int = 20_000) -> DataFrame:
    """Per row of df: its id, `fp` (long), `component_id`, the smallest id that links reach, and `component`, a fingerprint of the component.

    Empty and null texts have fingerprint 0 and are linked like any other. Rows that repeat
    keep one row each. A null id gets a component like any other row; an id is smallest among
    those not null, and null if its whole component has none. An empty table gives no rows.
    Other columns of df are not kept.
    """
    rows = written(fingerprints(df.select(F.col(f"`{id_column}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text", shingle, seed))
    groups = written(rows.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n")))
    links = near_links(groups, radius, parts, bucket_rows)
    members = connected_components(links)  # of fingerprints
    least = written(groups.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(least.join(smallest, "component").select("fp", "component_id", "component", "n"))
    return join_spread(rows, named, "fp").select(F.col("__id").alias(id_column), "fp", "component_id", "component")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """df with one row of each component of near-duplicates: that with the smallest id.

    Ids that are null or repeat don't tell rows apart; then the row is told by its fingerprint
    too, which is computed once more, and the smallest id (nulls last) and fingerprint stay, once.
    """
    plain, at = plain_names(df)
    found = written(near_duplicates(plain, at[id_column], at[text], shingle, radius))
    return first_rows(plain, found, lambda: with_fingerprints(plain, at[text], shingle), at[id_column]).toDF(*df.columns)


def first_rows(df: DataFrame, found: DataFrame, hashed: Callable[[], DataFrame], id_column: str) -> DataFrame:
    """The first row of each component in `found` (a table as of near_duplicates); hashed: df with `__fp`."""
    own = F.col(id_column)
    told = found.agg(F.count(F.lit(1)).alias("n"), F.count(own).alias("ids")).first()
    repeated = found.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if told.n == told.ids and not repeated:
        gone = found.where(own != F.col("component_id")).select(own.alias("__gone"))
        return df.join(gone, F.col(f"`{id_column}`").cast("long") == F.col("__gone"), "left_anti")
    first = found.groupBy("component").agg(F.min(F.struct(own.isNull().alias("null"), own.alias("id"), "fp")).alias("first"))
    first = first.select(F.col("first.id").alias("__first_id"), F.col("first.fp").alias("__first_fp"))
    fields = df.schema.fields
    kept = hashed().join(first, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col("__first_id")) & (F.col("__fp") == F.col("__first_fp")), "left_semi")
    return kept.dropDuplicates([id_column, "__fp"]).select(*(F.col(f"`{f.name}`") for f in fields))


def with_fingerprints(df: DataFrame, text: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """df with all its columns, and `__fp`."""
    fields = df.schema.fields
    at = [f.name for f in fields].index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__fp bigint"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*(f.name for f in fields), "__fp"])

    return df.mapInArrow(hashed, schema)
