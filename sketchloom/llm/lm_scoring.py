"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | before) = P(class | before) * P(part | class, before) * P(leaf | part, before) *
P(token | leaf). The classes part the vocabulary by frequency into shares of nearly equal mass,
the end of a text alone; a word never seen belongs to the last. A class of many words has 16
parts and each part 16 leaves, by bits of the word's hash; one of up to 16 words has parts only,
and one word needs neither. Each of the choices is a softmax over weights of hashed features:
the word before and the two before, and for the class also the words two and three back alone
(skips). A choice within a class starts from the shares that the parts have in the training
tokens. The tokens of a leaf, one or a few but in the class of the rarest, share it by their
smoothed counts.

The weights are learned from all training tokens by gradient steps in every task at once,
averaged over tasks by how often each feature was met. Their number grows as the square root of
the training tokens, as a vocabulary does, up to 2 ** MOST_BITS rows (268 MB): beyond that,
features share rows more. There are twice as many learning tasks as the cluster has cores, so
that what they exchange is so many times the weights.

Words are counted without a row for each. A task codes its documents in blocks: tokens as
places in the block's own vocabulary, a sorted array of 64-bit hashes. Each block sends the
counts of each hash range to that range's bucket, and gets the corpus' counts back in the same
order. The number of buckets grows with the corpus, so that no bucket does. (That two of a
corpus' words share a 64-bit hash is unlikely: 3 in 10 million for four million words.)
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import LOWER_BYTES, id_remainder, removed, shared_folder, written

#: Tokens of a block, at least, but for a task's last.
BLOCK_TOKENS = 1 << 21
#: Documents a bucket, at least, and at most.
BUCKET_DOCUMENTS = (2_000, 250_000)
ALPHA = 0.1
#: Counts are told apart to a 32nd of an octave where classes are cut.
OCTAVE = 32
FEATURES = 4
#: Choices of a node, features within a class, rows of weights by the root of the tokens, and their log2 at least and at most.
WIDE, INNER, ROWS_A_ROOT, LEAST_BITS, MOST_BITS = 16, 2, 24, 12, 22
LEAVES = WIDE * WIDE
#: The rate of steps within a class, as a share of that for classes.
INNER_RATE = 0.5
#: What a row's squared gradients start from: a feature that is met once moves little.
FIRST_SQUARES = 30.0
#: Blocks are written to so many files, so that tasks get equal shares of them; with more blocks a file has several.
BLOCK_FILES = 10_000
ROWS_A_CHUNK = 256
BATCH = 2048
END = xxhash.xxh64_intdigest(b"")


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)



@dataclass
class Block:
    """Documents of one task: ids, whether each is learned from, lengths; tokens as places in the sorted hashes; the hashes' counts in the corpus."""

    ids: list
    train: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray  # of which the low 32 bits are kept
    counts: np.ndarray
    end: int  # the end's place


def bucket_bits(documents: int) -> int:
    """log2 of how many buckets hashes are dealt to."""
    small, large = BUCKET_DOCUMENTS
    return int(max(64, min(4096, documents // small), documents // large) - 1).bit_length()


def code_blocks(df: DataFrame, id_column: str, text: str, fold: int, folds: int, bits: int) -> DataFrame:
    """Rows of two kinds: a block's documents (bucket -1), and its counts of training tokens in a bucket."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        vocabulary: dict[bytes, int] = defaultdict(count(1).__next__, {b"": 0})
        ids, train, lengths, tokens = [], [], [], []
        held = 0

        def finished() -> Iterator[pa.RecordBatch]:
            block = part << 24 | number
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            hashes, places, sizes = hashes[order], rank[np.concatenate(tokens)], np.array(lengths, np.uint32)
            learned = np.repeat(np.array(train, bool), sizes)
            n = np.bincount(places[learned], minlength=len(hashes)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{"block": block, "bucket": -1, "ids": ids, "train": np.array(train, np.uint8).tobytes(), "lengths": sizes.tobytes(), "tokens": _pack(places.tobytes()), "hashes": hashes.astype(np.uint32).tobytes(), "end_place": int(rank[0])}], _CODED)
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                rows.append({"block": block, "bucket": int(bucket[a]), "entries": hashes[a:b].tobytes() + n[a:b].tobytes()})
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[at : at + 256], _CODED)

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = lower_words(x.as_py())
                tokens.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                tokens.append(np.zeros(1, np.int64))
                ids.append(key)
                train.append(id_remainder(key, folds) != fold)
                lengths.append(len(found) + 1)
                held += len(found) + 1
                if held >= BLOCK_TOKENS:
                    yield from finished()
                    vocabulary, number, held = defaultdict(count(1).__next__, {b"": 0}), number + 1, 0
                    ids, train, lengths, tokens = [], [], [], []
        if ids:
            yield from finished()

    return df.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")).mapInArrow(coded, "block long, bucket long, ids array<long>, train binary, lengths binary, tokens binary, hashes binary, end_place long, entries binary")


_CODED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("end_place", pa.int64()), ("entries", pa.binary())])


def lower_words(text: str | None) -> list[bytes]:
    """words() with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def count_buckets(coded: DataFrame) -> DataFrame:
    """(block, bucket, counts of the corpus in the block's order, and once a bucket its sums by count bin and leaf)."""

    def counted(table: pa.Table) -> pa.Table:
        keys, ns, sizes = [], [], []
        for x in table.column("entries"):
            data = x.as_py()
            m = len(data) // 12
            keys.append(np.frombuffer(data, np.uint64, m))
            ns.append(np.frombuffer(data, np.uint32, m, 8 * m))
            sizes.append(m)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(ns)).astype(np.int64)
        ends = np.cumsum(sizes)
        seen = total[(total > 0) & (distinct != np.uint64(END))]
        places = count_bins(seen) * LEAVES + (distinct[(total > 0) & (distinct != np.uint64(END))] % np.uint64(LEAVES)).astype(np.int64)
        found, which = np.unique(places, return_inverse=True)
        sums = np.stack([found, np.bincount(which, minlength=len(found)), np.bincount(which, seen, len(found)).astype(np.int64)]) if len(seen) else np.zeros((3, 0), np.int64)
        end = int(total[distinct == np.uint64(END)].sum())
        sums = np.concatenate([sums, np.array([[-1], [int(end > 0)], [end]])], axis=1)
        counts = [_pack(total[at[e - m : e]].astype(np.int64).tobytes()) for e, m in zip(ends, sizes, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary()), "sums": pa.array([sums.astype(np.int64).tobytes()] + [None] * (len(counts) - 1), pa.binary())})

    return coded.where("bucket >= 0").select("block", "bucket", "entries").groupBy("bucket").applyInArrow(counted, "block long, bucket long, counts binary, sums binary")


def count_bins(counts: np.ndarray) -> np.ndarray:
    return np.floor(OCTAVE * np.log2(np.maximum(counts, 1))).astype(np.int64)


@dataclass
class Classes:
    """Class 0 is the end; the others start at falling count bins; the last also has what was never seen: a word in each leaf."""

    starts: np.ndarray  # the lowest bin of classes 1, 2, ... , falling
    mass: np.ndarray  # (classes, LEAVES): training tokens
    size: np.ndarray  # words

    @classmethod
    def cut(cls, sums: dict[tuple[int, int], tuple[int, int]], classes: int) -> Classes:
        """From (words, tokens) by bin and leaf; bin -1 is the end."""
        by_bin: dict[int, int] = {}
        for (b, _), (_, m) in sums.items():
            if b >= 0:
                by_bin[b] = by_bin.get(b, 0) + m
        whole, starts, m, spent = sum(by_bin.values()), [], 0, 0
        for b in sorted(by_bin, reverse=True)[:-1]:  # the rarest words are in the last class, with those never seen
            m += by_bin[b]
            if m >= (whole - spent) / max(1, classes - 1 - len(starts)) and len(starts) < classes - 2:
                starts.append(b)
                spent, m = spent + m, 0
        found = cls(np.array([*starts, -1]), np.zeros((len(starts) + 2, LEAVES)), np.zeros((len(starts) + 2, LEAVES)))
        for (b, leaf), (n, m) in sums.items():
            own = int(1 + np.searchsorted(-found.starts, -b)) if b >= 0 else 0
            found.mass[own, leaf if own else 0] += m
            found.size[own, leaf if own else 0] += n
        return found

    def told(self) -> Classes:
        """Sums, depths and shares, once mass and size are there."""
        self.tokens, self.kinds = int(self.mass.sum()), int(self.size.sum())
        words = self.size.sum(axis=1)
        words[-1] += LEAVES
        self.depth = np.where(words <= 1, 0, np.where(words <= WIDE, 1, 2))
        self.depth[0] = 0
        room = self.mass + ALPHA * self.size
        room[-1] += ALPHA
        leaves = room.reshape(len(self), WIDE, WIDE)
        parts, whole = leaves.sum(axis=2), room.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = lambda x, of: np.nan_to_num(np.log(x / of), nan=0.0, neginf=-np.inf).astype(np.float32)
            self.parts, self.leaves = share(parts, whole[:, None]), share(leaves, parts[:, :, None]).reshape(-1, WIDE)
        self.room = np.stack([np.repeat(whole[:, None], LEAVES, axis=1), np.repeat(parts, WIDE, axis=1), room])
        return self

    def __len__(self) -> int:
        return len(self.mass)

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The classes of words other than the end."""
        bins = np.where(counts > 0, count_bins(counts), -1)
        return 1 + np.searchsorted(-self.starts, -bins)

    def logp(self, counts: np.ndarray, classes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log probability of a word among those that the choices don't tell from it."""
        return np.where(classes == 0, 0.0, np.log((counts + ALPHA) / self.room[self.depth[classes], classes, leaf]))


def feature_codes(block: Block, start: int, stop: int) -> np.ndarray:
    """The features of tokens start to stop, as 64-bit codes: (n, FEATURES), those within classes first."""
    ends = np.cumsum(block.lengths, dtype=np.int64)
    docs = slice(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right")) + 1)
    begins, to = ends[docs] - block.lengths[docs], np.minimum(ends[docs], stop)
    after = np.arange(start, stop) - np.repeat(begins, to - np.maximum(begins, start))  # tokens of the document before each
    held = min(start, 3)
    h = np.concatenate([np.zeros(3 - held, np.uint64), block.hashes.take(block.tokens[start - held : stop]).astype(np.uint64)])
    back = [np.where(after >= k, h[3 - k : len(h) - k], np.uint64(k)) for k in (1, 2, 3)]
    return np.stack([back[0] * np.uint64(4), (back[0] * MIX + back[1]) * np.uint64(4) + np.uint64(1), back[1] * np.uint64(4) + np.uint64(2), back[2] * np.uint64(4) + np.uint64(3)], axis=1)


MIX = np.uint64(0x9E3779B97F4A7C15)


def weight_rows(codes: np.ndarray, node: np.ndarray | int, bits: int) -> np.ndarray:
    """The rows of weights of features (n, any) at nodes (n), or at one."""
    x = codes + (np.asarray(node, np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(-1, 1)
    x = x * MIX
    return (((x ^ (x >> np.uint64(29))) * MIX) >> np.uint64(64 - bits)).astype(np.int32)


def softmax(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponents of the first `wide` choices, up to a shift, their exponentials, and the sums of these by row; prior: (choices), or (n, choices), where -inf is no choice."""
    z = weights.take(rows[:, 0], 0, mode="clip")
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], 0, mode="clip")
    z = z[:, :wide]
    z = np.add(z, prior, out=z if z.flags.c_contiguous else None)
    z -= z.max()  # one shift for all rows is fast, and will do unless they lie far apart
    e = np.exp(z)
    sums = e @ np.ones(e.shape[1], np.float32)
    if not sums.min() > 1e-30:
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        sums = e.sum(axis=1)
    return z, e, sums


def chosen_logp(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, chosen: np.ndarray, wide: int) -> np.ndarray:
    """Log probability of each row's choice."""
    z, _, sums = softmax(weights, prior, rows, wide)
    return z.ravel().take(np.arange(0, z.size, z.shape[1]) + chosen).astype(np.float64) - np.log(sums)


@dataclass
class Model:
    """Classes, and weights (rows x WIDE) with the classes' bias."""

    classes: Classes
    weights: np.ndarray
    bias: np.ndarray

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1

    def targets(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class and leaf of each entry of the block's vocabulary, and its log probability there."""
        classes = self.classes.of(block.counts)
        classes[block.end] = 0
        leaf = (block.hashes % np.uint32(LEAVES)).astype(np.int64)
        return classes, leaf, self.classes.logp(block.counts, classes, leaf)

    def choices(self, classes: np.ndarray, leaf: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Below the classes, level by level: which tokens choose, rows of weights, priors by node, nodes and what is chosen."""
        for level, shares in ((1, self.classes.parts), (2, self.classes.leaves)):
            own = np.flatnonzero(self.classes.depth[classes] >= level)
            c, x = classes[own], leaf[own]
            node, chosen = (c, x // WIDE) if level == 1 else (c * WIDE + x // WIDE, x % WIDE)
            yield own, weight_rows(codes[own, :INNER], node + 1 + (level - 1) * len(self.classes), self.bits), shares, node, chosen

    def logp(self, classes: np.ndarray, leaf: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Log probability of each token's class, part and leaf after its features."""
        out = chosen_logp(self.weights, self.bias, weight_rows(codes, 0, self.bits), classes, len(self.classes))
        for own, rows, shares, node, chosen in self.choices(classes, leaf, codes):
            if len(own):
                out[own] += chosen_logp(self.weights, shares.take(node, 0), rows, chosen, WIDE)
        return out


def step(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, chosen: np.ndarray, wide: int, squares: np.ndarray, rate: float) -> np.ndarray:
    """A gradient step over a batch; changes weights and squares in place and returns the gradient of each row's choices."""
    shift = rows.size.bit_length()
    keys = rows.ravel().astype(np.int64) << shift
    keys |= np.arange(rows.size)
    keys.sort()
    ordered, at = keys >> shift, keys & ((1 << shift) - 1)
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    begins, to = np.flatnonzero(new), np.cumsum(new) - 1
    own, place = ordered.take(begins), np.empty(len(keys), np.int64)
    place[at] = to
    held = weights.take(own, 0, mode="clip")  # the table of weights is read and written once a row
    _, g, sums = softmax(held, prior, place.reshape(rows.shape), wide)
    g *= (-1 / sums)[:, None]
    g.reshape(-1)[np.arange(0, g.size, wide) + chosen] += 1
    at //= rows.shape[1]
    change = g.take(at.take(begins), 0, mode="clip")
    if len(begins) < len(keys):  # few rows of weights are met more than once
        again = np.flatnonzero(~new)
        to = to.take(again)
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        change[to[starts]] += np.add.reduceat(g.take(at.take(again), 0, mode="clip"), starts, axis=0)
    size = squares.take(own) + (change * change) @ np.ones(wide, np.float32)
    squares[own] = size
    change *= (np.float32(rate) / np.sqrt(size))[:, None]
    if wide < held.shape[1]:
        held[:, :wide] += change
    else:
        held += change
    weights[own] = held
    return g


def learn(model: Model, block: Block, weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """Gradient steps over the block's training tokens; changes weights, bias, seen (how often each row was met) and squares in place."""
    classes, leaf, _ = model.targets(block)
    learned = np.repeat(block.train.astype(bool), block.lengths)
    n, wide = len(block.tokens), len(model.classes)
    for start in range(0, n, 1 << 17):
        stop = min(n, start + (1 << 17))
        use = learned[start:stop]
        codes, own = feature_codes(block, start, stop)[use], block.tokens[start:stop][use]
        rows, target = weight_rows(codes, 0, model.bits), classes[own]
        for a in range(0, len(rows), BATCH):
            g = step(weights, bias, rows[a : a + BATCH], target[a : a + BATCH], wide, squares, rate)
            bias += np.float32(rate / 4 / len(g)) * (np.ones(len(g), np.float32) @ g)
        seen += np.bincount(rows.ravel(), minlength=len(seen))
        for _, rows, shares, node, chosen in model.choices(target, leaf[own], codes):
            for a in range(0, len(rows), BATCH):
                step(weights, shares.take(node[a : a + BATCH], 0), rows[a : a + BATCH], chosen[a : a + BATCH], WIDE, squares, rate * INNER_RATE)
            seen += np.bincount(rows.ravel(), minlength=len(seen))


def block_of(row: dict) -> Block:
    u4 = lambda data: np.frombuffer(data, np.uint32)
    return Block(row["ids"], np.frombuffer(row["train"], np.uint8), u4(row["lengths"]).astype(np.int64), u4(_unpack(row["tokens"])), u4(row["hashes"]), np.frombuffer(row["counts"], np.int64), row["end_place"])


def bits_for(tokens: int) -> int:
    """log2 of the rows of weights for so many training tokens."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(ROWS_A_ROOT * np.sqrt(max(1, tokens)))))))


def fit(coded: DataFrame, classes: Classes, bits: int, rounds: int, rate: float) -> Model:
    """Weights learned from every training token, `rounds` times over."""
    spark, k = coded.sparkSession, WIDE
    coded = coded.coalesce(2 * spark.sparkContext.defaultParallelism)
    mass = classes.mass.sum(axis=1) + 0.5
    model = Model(classes, np.zeros((1 << bits, k), np.float32), np.log(mass / mass.sum()).astype(np.float32))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # 2 ** bits x WIDE weights

        def stepped(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            weights, bias = model.weights.copy(), model.bias.copy()
            seen, squares, tokens = np.zeros(len(weights), np.float32), np.full(len(weights), FIRST_SQUARES, np.float32), 0
            for batch in batches:
                for row in range(batch.num_rows):
                    block = block_of(batch.slice(row, 1).to_pylist()[0])
                    learn(model, block, weights, bias, seen, squares, rate)
                    tokens += int(block.lengths[block.train.astype(bool)].sum())
            if not tokens:
                return
            change = (weights - model.weights) * seen[:, None]
            rows = [{"chunk": c, "change": change[a : a + ROWS_A_CHUNK].tobytes(), "seen": seen[a : a + ROWS_A_CHUNK].tobytes()} for c, a in enumerate(range(0, len(weights), ROWS_A_CHUNK))]
            rows.append({"chunk": -1, "change": ((bias - model.bias) * np.float32(tokens)).astype(np.float32).tobytes(), "seen": np.array([tokens], np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _CHANGE)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for c, x, n in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    x, n = np.frombuffer(x, np.float32).astype(np.float64), np.frombuffer(n, np.float32).astype(np.float64)
                    if c in total:
                        total[c][0] += x
                        total[c][1] += n
                    else:
                        total[c] = [x.copy(), n.copy()]
            rows = [{"chunk": c, "change": x.astype(np.float32).tobytes(), "seen": n.astype(np.float32).tobytes()} for c, (x, n) in total.items()]
            yield pa.RecordBatch.from_pylist(rows, _CHANGE)

        schema = "chunk int, change binary, seen binary"
        changes = coded.mapInArrow(stepped, schema).repartition(32, "chunk").mapInArrow(summed, schema).collect()  # as large as the weights
        weights, bias = model.weights.copy(), model.bias.copy()
        for r in changes:
            x, n = np.frombuffer(r.change, np.float32), np.maximum(np.frombuffer(r.seen, np.float32), 1e-9)
            if r.chunk < 0:
                bias += x / n[0]
            else:
                weights[r.chunk * ROWS_A_CHUNK : (r.chunk + 1) * ROWS_A_CHUNK] += x.reshape(-1, k) / n[:, None]
        shared.unpersist()
        model = Model(classes, weights, bias)
    return model


_CHANGE = pa.schema([("chunk", pa.int32()), ("change", pa.binary()), ("seen", pa.binary())])


def corpus_blocks(df: DataFrame, id_column: str, text: str, fold: int, folds: int) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """Blocks of df's documents with the corpus' counts, as a table, and (words, tokens) by count bin and leaf."""
    bits = bucket_bits(df.count())
    folders = [shared_folder(df.sparkSession) for _ in range(2)]
    coded = written(code_blocks(df, id_column, text, fold, folds, bits), folders[0])
    counted = written(count_buckets(coded), folders[1])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                bins, n, m = np.frombuffer(x.as_py(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n), pa.array(m)], names=["bin", "n", "m"])

    sums = counted.where("sums is not null").select("sums").mapInArrow(explode, "bin long, n long, m long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()  # 32 * LEAVES rows an octave of counts at most

    def merged(body: pa.Table, parts: pa.Table) -> pa.Table:
        ordered = parts.sort_by("bucket")
        counts = b"".join(_unpack(x.as_py()) for x in ordered.column("counts"))
        return pa.table({**{c: body.column(c) for c in body.column_names}, "counts": pa.array([counts], pa.binary())})

    bodies = coded.where("bucket = -1").select("block", "ids", "train", "lengths", "tokens", "hashes", "end_place")
    whole = bodies.groupBy("block").cogroup(counted.select("block", "bucket", "counts").groupBy("block")).applyInArrow(merged, "block long, ids array<long>, train binary, lengths binary, tokens binary, hashes binary, end_place long, counts binary")
    number = coded.where("bucket = -1").count()
    blocks = written(whole, rows_a_file=max(1, number // BLOCK_FILES))
    removed(df.sparkSession, *folders)  # as large as the blocks
    return blocks, {((r.bin // LEAVES, r.bin % LEAVES) if r.bin >= 0 else (-1, 0)): (r.n, r.m) for r in sums}


def score(df: DataFrame, id_column: str = "doc_id", text: str = "text", fold: int = 0, folds: int = 10, classes: int = WIDE, bits: int | None = None, rounds: int = 1, rate: float = 0.7) -> DataFrame:
    """Scores of every whole text, learned from rows whose id's remainder isn't `fold`.

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10). A
    null text has the end alone; a null id counts as empty text for its fold; rows that repeat
    are scored, and counted, each. Without training rows every token scores log10 1 by the
    base. An empty table gives no rows. `classes` are WIDE at most; without `bits` there are as
    many rows of weights as bits_for() has it.
    """
    if not 2 <= classes <= WIDE:
        raise ValueError(f"from 2 to {WIDE} classes")
    blocks, sums = corpus_blocks(df, id_column, text, fold, folds)
    cut = Classes.cut(sums, classes).told()
    model = df.sparkSession.sparkContext.broadcast(fit(blocks, cut, bits or bits_for(cut.tokens), rounds, rate))  # 2 ** MOST_BITS x WIDE weights at most

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        whole, kinds = own.classes.tokens, own.classes.kinds
        for batch in batches:
            for k in range(batch.num_rows):
                block = block_of(batch.slice(k, 1).to_pylist()[0])
                of, leaf, inside = own.targets(block)
                base = np.log10((block.counts + ALPHA) / (whole + ALPHA * (kinds + 1)))
                logp = np.empty(len(block.tokens))
                for start in range(0, len(logp), 1 << 14):
                    stop = min(len(logp), start + (1 << 14))
                    places = block.tokens[start:stop]
                    logp[start:stop] = own.logp(of[places], leaf[places], feature_codes(block, start, stop)) + inside[places]
                starts = np.cumsum(block.lengths) - block.lengths
                columns = [pa.array(block.ids, pa.int64()), pa.array(block.train == 0), pa.array(block.lengths), pa.array(np.add.reduceat((block.counts > 0)[block.tokens].astype(np.int64), starts)), pa.array(np.full(len(starts), whole)), pa.array(np.add.reduceat(base[block.tokens], starts)), pa.array(np.add.reduceat(logp, starts) / np.log(10))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.mapInArrow(scored, f"`{id_column}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
