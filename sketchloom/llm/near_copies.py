"""Near copies: rows whose sets of word shingles have a Jaccard similarity of at least `least`.

Candidates are found by SimHash fingerprints of the same shingles, searched as simhash.py does,
and each is compared exactly. What fingerprints miss at this similarity is found by prefix
filtering, so that no link is lost: with the shingles of every set in one order, two such sets
share one of their first size - ceil(least * size) + 1. The order is rarest first, by counts of
hashed shingles, so that few sets meet at a shingle; it decides what the search costs, never
what it finds.

Scale: only distinct sets are searched, so copies cost nothing. Sets that meet at a shingle are
all compared if they are at most FEW. Larger crowds are first compared by a window of neighbours
in size and in groups of about TOGETHER, drawn anew at each shingle, which makes pairs in
proportion to a crowd and joins most of what is alike. What no links have joined to a crowd's
largest component then meets the rest of the crowd, each pair at the first shingle it shares. Both
pass by bounds on size and place and by parity bits: each set has BITS bits, the parities of its
hashes that fall to them, and two sets differ in as many elements, at least, as bits. Few others
than sets that are alike pass, and only these pairs are made; their sets are compared, each once.
Pairs found otherwise pass by parity bits too before whole sets are fetched, which are most of
what the search keeps on disk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import LOWER_BYTES, join_spread, plain_names, words, written
from sketchloom.llm.components import connected_components, joined_components
from sketchloom.llm.simhash import fingerprint, first_rows, near_links

#: So many sets that share a shingle are compared by all pairs; in larger crowds each first with so many neighbours, and in groups of so many.
FEW, NEIGHBOURS, TOGETHER = 32, 4, 8
#: log2 of the counters that order shingles, and counters a row.
SLOTS, SLOTS_A_ROW = 18, 4096
#: Parity bits of a set, in longs.
BITS, LONGS = 1024, [f"bits{k}" for k in range(16)]
#: Where bits of a set's name are taken that mark it.
SHIFTS = (0, 16, 32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the text's word shingles, A-Z lower-cased; fewer words: one of all; none: empty."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w.translate(LOWER_BYTES)) for w in found), np.uint64, len(found))
    span = min(shingle, len(h))
    n = len(h) - span + 1
    x = np.full(n, span, np.uint64)
    for k in range(span):
        x = x * MIX + h[k : k + n]
    x = (x ^ (x >> np.uint64(29))) * MIX
    return np.unique(x ^ (x >> np.uint64(32)))


def parities(own: np.ndarray) -> np.ndarray:
    """For each of BITS slots, whether the set's hashes that fall to it are odd in number, as longs."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_of(own: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of it."""
    x = xxhash.xxh64_intdigest(own.tobytes())
    return x - (1 << 64) if x >> 63 else x


def shingle_counts(df: DataFrame, text: str, shingle: int) -> np.ndarray:
    """How many shingles fall to each of 2 ** SLOTS counters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(n, slots(shingle_set(x.as_py(), shingle)), 1)
        rows = range(0, len(n), SLOTS_A_ROW)
        yield pa.RecordBatch.from_arrays([pa.array([a // SLOTS_A_ROW for a in rows], pa.int32()), pa.array([n[a : a + SLOTS_A_ROW].tobytes() for a in rows], pa.binary())], names=["at", "n"])

    def summed(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    found = np.zeros(1 << SLOTS, np.int64)
    for r in df.select(F.col(f"`{text}`")).mapInArrow(counted, "at int, n binary").groupBy("at").applyInArrow(summed, "at int, n binary").collect():  # 2 ** SLOTS counters
        found[r.at * SLOTS_A_ROW : (r.at + 1) * SLOTS_A_ROW] = np.frombuffer(r.n, np.int64)
    return found


def slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SLOTS)).astype(np.int64)


def prefixes(df: DataFrame, text: str, shingle: int, least: float, counts: np.ndarray) -> DataFrame:
    """`__id`, node, size, prefix (the set's first shingles), print (the text's SimHash) and parity bits of each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(counts)  # 2 ** SLOTS counters

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            first = [s[np.lexsort((s, counts[slots(s)]))][: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for s in sets]
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            bits = np.array([parities(s) for s in sets]).reshape(len(sets), len(LONGS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([p.view(np.int64) for p in first], pa.list_(pa.int64())), pa.array(prints), *map(pa.array, bits)], names=["__id", "node", "size", "prefix", "print", *LONGS])

    return df.select("__id", F.col(f"`{text}`")).mapInArrow(found, f"__id long, node long, size int, prefix array<long>, print long, {', '.join(f'{x} long' for x in LONGS)}")


def may_reach(least: float, size_a: Column | np.ndarray, at_a: Column | np.ndarray, size_b: Column | np.ndarray, at_b: Column | np.ndarray, smaller) -> Column | np.ndarray:  # noqa: ANN001
    """Whether sets whose first common shingle is at these places can share enough."""
    return smaller(size_a - at_a, size_b - at_b) * (1 + least) >= (size_a + size_b) * least - 1e-6


def meetings(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets to compare, and the rows (key, a, size, at) of crowds, whose b is null."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sizes, own = batch.column(2).value_lengths().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()
            at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = [own, np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes).astype(np.int32), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "a", "size", "at"])

    dealt = sets.select("node", "size", "prefix").mapInArrow(keys, "key long, a long, size int, at int").repartition("key").sortWithinPartitions("key", "size", "a")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "a", "size", "at", "b"]
        held: list[list[np.ndarray]] = []

        def out(key: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(starts, len(key)))
            crowd = np.repeat(many > FEW, many)
            for d in range(1, FEW):
                if len(key) <= d:
                    break
                i = np.flatnonzero((key[d:] == key[:-d]) & (~crowd[d:] if d > NEIGHBOURS else True))
                if not len(i):
                    break
                i = i[may_reach(least, size[i], at[i], size[i + d], at[i + d], np.minimum)]
                a, b = np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])
                a, b = np.unique(np.stack([a, b]), axis=1) if len(i) else (a, b)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.array(b)], names=names)
            own = [pa.array(x[crowd]) for x in (key, node, size, at)]
            yield pa.RecordBatch.from_arrays([own[0], own[1], own[2], own[3], pa.nulls(len(own[0]), pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy() for k in range(4)])
            if sum(len(x[0]) for x in held) < 200_000:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last crowd may go on
            if cut:
                yield from out(*(c[:cut] for c in cols))
            held = [[c[cut:] for c in cols]]
        if held:
            yield from out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.mapInArrow(met, "key long, a long, size int, at int, b long")


def among(ends: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tells, in tasks, which of some sets' names may be in ends' column `node`: all that are, and about one of 200 others, one of 30 at most."""
    nodes = written(ends.select("node").distinct())
    bits = 1 << max(6, (8 * nodes.count()).bit_length())
    slots = F.array(*(F.shiftrightunsigned("node", k).bitwiseAND(F.lit(bits - 1)) for k in SHIFTS))
    words = nodes.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("word")).toArrow()  # 2 bytes a set
    marks = np.zeros(bits // 64, np.uint64)
    marks[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    shared = ends.sparkSession.sparkContext.broadcast(marks)

    def told(names: np.ndarray) -> np.ndarray:
        marks, own, found = shared.value, names.view(np.uint64), np.ones(len(names), bool)
        for k in SHIFTS:
            slot = own >> np.uint64(k) & np.uint64(bits - 1)
            found &= (marks[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    return told


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def sets_among(rows: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """node and the columns, once for each set in `ends` (node) and few others: nothing else of `rows` is dealt out."""
    told = among(ends)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(told(batch.column(0).to_numpy())))

    every = rows.where("size > 0").select("node", *columns)
    return every.mapInArrow(some, every.schema).dropDuplicates(["node"])


def by_parities(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that may be alike by their sets' sizes and parity bits, so that the whole sets of no others are fetched."""
    own = written(sets_among(rows, ends_of(pairs), "size", *LONGS))
    others = own.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("size", *LONGS)))
    return pairs.join(own.withColumnRenamed("node", "a"), "a").join(others, "b").where(differ_little(least)).select("a", "b")


def alike(df: DataFrame, pairs: DataFrame, text: str, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least `least`, by the sets themselves.

    Sets are dealt out by name once, for both ends; then those of a follow their pairs to b.
    """
    told = among(ends_of(pairs))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [s for x in batch.column(0).slice(at, 1000) if len(s := shingle_set(x.as_py(), shingle))]
                names = np.array([node_of(s) for s in found], np.int64)
                own = told(names)
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array([s.view(np.int64) for s, x in zip(found, own, strict=True) if x], pa.list_(pa.int64()))], names=["node", "own"])

    own = df.select(F.col(f"`{text}`")).mapInArrow(sets, "node long, own array<long>").dropDuplicates(["node"])
    with_a = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    both = with_a.join(own.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b").withColumn("both", F.size(F.array_intersect("own_a", "own_b")))
    return both.where(F.col("both") >= (F.size("own_a") + F.size("own_b") - F.col("both")) * F.lit(least) - 1e-9).select("a", "b")


def by_prints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose texts' fingerprints are the same or near, as many as join what fingerprints join."""
    own = written(rows.where("size > 0").select("node", F.col("print").alias("fp")).distinct())
    first = written(own.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    same = join_spread(own, first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = near_links(first.select("fp"), stars=False)
    for c in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    return same.unionByName(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))).where("a != b")


def differ_little(least: float) -> Column:
    """Whether the parity bits of sets, the second with names in _b, differ in so few that the sets may share enough."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in LONGS[1:]), F.bit_count(F.col(LONGS[0]).bitwiseXOR(F.col(f"{LONGS[0]}_b"))))
    return differ <= (F.col("size") + F.col("size_b")) * F.lit((1 - least) / (1 + least)) + 1e-6


def may_be_alike(least: float) -> Column:
    """Whether sets that meet in a crowd, the second with names in _b, may share enough."""
    return may_reach(least, F.col("size"), F.col("at"), F.col("size_b"), F.col("at_b"), F.least) & differ_little(least)


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def together(crowds: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets of a crowd that may be alike, of those that are dealt to one group; crowds: key, a, size, at, parity bits."""
    groups = crowds.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).alias("groups"))
    dealt = crowds.join(groups, "key").withColumn("group", F.pmod(F.xxhash64("a", "key"), "groups"))
    others = dealt.select("key", "group", *(F.col(c).alias(f"{c}_b") for c in ("a", "size", "at", *LONGS)))
    return dealt.join(others, ["key", "group"]).where((F.col("a") < F.col("a_b")) & may_be_alike(least)).select("a", F.col("a_b").alias("b"))


def strangers(crowds: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets of a crowd that may be alike and aren't of one component; crowds: key, a, size, at, prefix, parity bits.

    Each pair is made once, at the first shingle that both prefixes have. Where that isn't a
    crowd's, the pair has been compared.
    """
    joined = crowds.join(members.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    parts = joined.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    joined = written(joined.join(parts.where("parts > 1").drop("parts"), "key"))
    others = joined.where(F.col("component") != F.col("most")).select("key", *(F.col(c).alias(f"{c}_b") for c in ("a", "size", "at", "component", "prefix", *LONGS)))
    once = (F.col("component") == F.col("most")) | (F.col("a") < F.col("a_b"))
    first = F.array_intersect("prefix", "prefix_b").getItem(0) == F.col("key")
    return joined.join(others, "key").where((F.col("component") != F.col("component_b")) & once & may_be_alike(least) & first).select("a", F.col("a_b").alias("b"))


def near_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Per row of df: its id, `fp` (long; of its set), `component_id`, the smallest id that links reach, and `component`.

    Texts without words are copies of each other. Ids that are null or repeat are as in
    simhash.near_duplicates.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0, 1 at most")
    df = df.select(F.col(f"`{id_column}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    rows = written(prefixes(df, "__text", shingle, least, shingle_counts(df, "__text", shingle)))
    sets = rows.where("size > 0").dropDuplicates(["node"])
    met = written(meetings(sets, least))
    crowds = met.where("b is null").drop("b")
    crowds = written(crowds.join(sets_among(rows, crowds.select(F.col("a").alias("node")), "prefix", *LONGS).withColumnRenamed("node", "a"), "a"))
    found = written(pairs_of(by_prints(rows).unionByName(met.where("b is not null").select("a", "b")).unionByName(together(crowds, least))))
    pairs = written(by_parities(rows, found, least))
    links = written(alike(df, pairs, "__text", shingle, least))
    members = written(connected_components(links))
    if crowds.limit(1).count():
        more = written(pairs_of(strangers(crowds, members, least)).join(pairs, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            members = joined_components(members, written(alike(df, more, "__text", shingle, least)))
    groups = rows.groupBy(F.col("node").alias("fp")).agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = written(groups.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(smallest, "component").select("fp", "component_id", "component", "n"))
    return join_spread(rows.select("__id", F.col("node").alias("fp")), named, "fp").select(F.col("__id").alias(id_column), "fp", "component_id", "component")


def with_nodes(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """df with all its columns, and `__fp`, the name of its set."""
    at = df.columns.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["__fp bigint"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(shingle_set(x.as_py(), shingle)) for x in batch.column(at)], pa.int64())], names=[*batch.schema.names, "__fp"])

    return df.mapInArrow(hashed, schema)


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """df with one row of each component of near copies, as simhash.deduplicate has it."""
    plain, at = plain_names(df)
    found = written(near_copies(plain, at[id_column], at[text], shingle, least))
    return first_rows(plain, found, lambda: with_nodes(plain, at[text], shingle), at[id_column]).toDF(*df.columns)
