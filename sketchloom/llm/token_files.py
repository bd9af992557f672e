"""Token ids in binary files, coded with a static range asymmetric numeral system (rANS).

One table of frequencies, counted over the whole corpus, is shared by all files of a folder.
A file holds whole documents in ascending id order: their ids and lengths, then blocks of
tokens. A block is coded on its own by LANES interleaved 64-bit states that write 32-bit
words to one stream; the directory has each block's checkpoint (first token, place, words,
final states) and a checksum of its ids, so that blocks are decoded and verified in parallel
and from any block on. All lanes of all blocks of a file are coded together by numpy.

Writing takes two passes, since the table must be known before anything is coded: documents
are dealt by ranges of their id, tokenised and written as drafts with their counts; then each
draft is coded and replaced. Files are moved into place whole and a repeated task finds its
work done, so a lost executor costs only its own files.

File format, little-endian: FILE magic; u64 shard, u64 number in the shard, u64 table
checksum, u64 documents, u64 tokens, u64 blocks; i64 ids, u8 null flags, u32 lengths of the
documents; for each block u32 tokens, u32 words, u32 checksum; u64 states (blocks x LANES);
u32 words; u32 checksum of all before. Table format: TABLE magic; u64 symbols; u32 symbol, u32
frequency for each; u32 checksum of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.llm import store
from sketchloom.llm.common import shared_folder, written
from sketchloom.llm.tokens import encoder

FILE, TABLE = b"SLTOKEN1", b"SLTABLE1"
#: log2 of the table's total frequency.
PRECISION = 18
LANES = 64
BLOCK = 1 << 16
#: Tokens of a file, at least, but for a shard's last.
FILE_TOKENS = 1 << 22
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Corrupt(ValueError):
    """A file that isn't as it was written."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to counts that add up to 2 ** PRECISION; what occurs has 1 at least."""
    total, whole = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > whole:
        raise ValueError(f"more than {whole} different ids")
    exact = counts.astype(np.float64) * (whole / total)
    freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    left = whole - int(freq.sum())
    if left > 0:
        freq[int(np.argmax(freq))] += left
    while left < 0:
        most = int(np.argmax(freq))
        take = min(-left, max(1, int(freq[most]) // 2))
        freq[most] -= take
        left += take
    return freq


@dataclass
class Table:
    """Frequencies of ids 0 to n - 1, and what coding needs of them."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        f = self.freq.astype(np.uint64)
        self.f, self.start = f, (np.cumsum(f) - f).astype(np.uint64)
        self.whole = np.uint64(1 << PRECISION)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint16 if len(f) <= 1 << 16 else np.uint32), self.freq)
        self.pad = int(np.argmax(self.freq)) if len(f) else 0
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    def image(self) -> bytes:
        at = np.flatnonzero(self.freq)
        body = TABLE + struct.pack("<Q", len(at)) + np.stack([at, self.freq[at]], axis=1).astype("<u4").tobytes() + struct.pack("<Q", len(self.freq))
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def of(cls, image: bytes) -> Table:
        if image[:8] != TABLE or struct.unpack("<I", image[-4:])[0] != zlib.crc32(image[:-4]):
            raise Corrupt("not a whole table")
        pairs = np.frombuffer(image, "<u4", 2 * struct.unpack_from("<Q", image, 8)[0], 16).reshape(-1, 2)
        freq = np.zeros(struct.unpack("<Q", image[-12:-4])[0], np.int64)
        freq[pairs[:, 0]] = pairs[:, 1]
        return cls(freq)


def coded(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states (blocks x LANES) and words of blocks of equal length: tokens is steps x blocks x LANES."""
    steps, blocks, lanes = tokens.shape
    tokens = tokens.reshape(steps, -1)
    x = np.full(tokens.shape[1], LOW, np.uint64)
    f, start, q = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    words = np.empty(tokens.shape, np.uint32)
    wrote = np.empty(tokens.shape, bool)
    shift, room = np.uint64(PRECISION), np.uint64(31 - PRECISION + 32)
    for t in range(steps - 1, -1, -1):
        s = tokens[t]
        np.take(table.f, s, out=f, mode="clip")
        np.take(table.start, s, out=start, mode="clip")
        full = wrote[t]
        np.greater_equal(x >> room, f, out=full)
        words[t] = x  # the low half
        np.right_shift(x, WORD, out=x, where=full)
        np.floor_divide(x, f, out=q)
        # x - q f, the remainder, and q << shift: x + q ((1 << shift) - f) + start
        np.subtract(table.whole, f, out=f)
        np.multiply(f, q, out=f)
        x += f
        x += start
    words, wrote = words.reshape(steps, blocks, lanes), wrote.reshape(steps, blocks, lanes)
    return x.reshape(blocks, lanes), [words[:, b][wrote[:, b]] for b in range(blocks)]


def decoded(states: np.ndarray, words: np.ndarray, first: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """The tokens (steps x blocks x LANES) of blocks that start at words[first]."""
    blocks, lanes = states.shape
    x, at = states.ravel().copy(), first.astype(np.int64)
    out = np.empty((steps, len(x)), table.symbol.dtype)
    f, start = np.empty_like(x), np.empty_like(x)
    slots, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    words = words.astype(np.uint64)
    for t in range(steps):
        slot = x & slots
        s = out[t]
        np.take(table.symbol, slot.view(np.int64), out=s, mode="clip")
        np.take(table.f, s, out=f, mode="clip")
        np.take(table.start, s, out=start, mode="clip")
        x >>= shift
        x *= f
        slot -= start
        x += slot
        need = np.flatnonzero(x < LOW)  # lanes of a block in a row, blocks in turn
        if len(need):
            block = need // lanes
            taken = np.bincount(block, minlength=blocks)
            place = np.arange(len(need)) + np.repeat(at - (np.cumsum(taken) - taken), taken)
            x[need] = x[need] << WORD | words[place]
            at += taken
    return out.reshape(steps, blocks, lanes)


def file_image(shard: int, number: int, keys: list, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """A file of whole documents; every id must be in the table."""
    if len(ids) and (int(ids.max()) >= len(table.freq) or not table.freq[ids].all()):
        raise ValueError("an id that the table lacks")
    sizes = [min(BLOCK, len(ids) - at) for at in range(0, len(ids), BLOCK)]
    whole = len(ids) // BLOCK
    states, words = [np.zeros((0, LANES), np.uint64)], []
    for part, n in ((ids[: whole * BLOCK], whole), (ids[whole * BLOCK :], len(sizes) - whole)):
        if n:
            rows = -(-len(part) // (n * LANES)) * LANES
            part = np.append(part, np.full(n * rows - len(part), table.pad, ids.dtype)).reshape(n, -1, LANES).transpose(1, 0, 2)
            x, w = coded(part, table)
            states.append(x)
            words += w
    sums = [zlib.crc32(ids[at : at + BLOCK].astype("<u4")) for at in range(0, len(ids), BLOCK)]
    body = FILE + struct.pack("<6Q", shard, number, table.crc, len(keys), len(ids), len(sizes))
    body += np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes() + lengths.astype("<u4").tobytes()
    body += np.array([sizes, [len(w) for w in words], sums], "<u4").T.tobytes() + np.concatenate(states).astype("<u8").tobytes()
    body += b"".join(w.astype("<u4").tobytes() for w in words)
    return body + struct.pack("<I", zlib.crc32(body))


def read_image(image: bytes, table: Table, blocks: range | None = None) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """Shard, number, document ids, their lengths and all token ids of a file, or of a range of its blocks."""
    if image[:8] != FILE or struct.unpack("<I", image[-4:])[0] != zlib.crc32(memoryview(image)[:-4]):
        raise Corrupt("not a whole file")
    shard, number, crc, docs, tokens, n = struct.unpack_from("<6Q", image, 8)
    if crc != table.crc:
        raise Corrupt("a file of another table")
    at = 56
    keys = np.frombuffer(image, "<i8", docs, at).tolist()
    null = np.frombuffer(image, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(image, "<u4", docs, at := at + docs)
    sizes, took, sums = np.frombuffer(image, "<u4", 3 * n, at := at + 4 * docs).reshape(-1, 3).T.astype(np.int64)
    states = np.frombuffer(image, "<u8", n * LANES, at := at + 12 * n).reshape(-1, LANES)
    words = np.frombuffer(image, "<u4", (len(image) - 4 - at - 8 * n * LANES) // 4, at + 8 * n * LANES)
    first = np.cumsum(took) - took
    ids = []
    blocks = range(n) if blocks is None else blocks
    for steps in dict.fromkeys((-(-sizes[b] // LANES)) for b in blocks):  # full blocks, then a last one
        own = [b for b in blocks if -(-sizes[b] // LANES) == steps]
        out = decoded(states[own].astype(np.uint64), words, first[own], int(steps), table)
        ids += [out[:, k].ravel()[: sizes[b]] for k, b in enumerate(own)]
    for b, found in zip(blocks, ids, strict=True):
        if zlib.crc32(found.astype("<u4")) != sums[b]:
            raise Corrupt(f"block {b} isn't as it was written")
    return shard, number, [None if x else k for k, x in zip(keys, null, strict=True)], lengths, np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)


def _draft(keys: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's documents before the table is known: as they are, with a checksum; deflating them would cost more than it saves."""
    kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
    body = struct.pack("<QB", len(keys), kind().itemsize) + np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes() + lengths.astype("<u4").tobytes() + ids.astype(kind).tobytes()
    return struct.pack("<I", zlib.crc32(body)) + body


def _of_draft(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    if struct.unpack_from("<I", data)[0] != zlib.crc32(memoryview(data)[4:]):
        raise Corrupt("not a whole draft")
    n, width = struct.unpack_from("<QB", data, 4)
    keys, null = np.frombuffer(data, "<i8", n, 13).tolist(), np.frombuffer(data, np.uint8, n, 13 + 8 * n)
    ids = np.frombuffer(data, {2: np.uint16, 4: np.uint32}[width], -1, 13 + 13 * n)
    return [None if x else k for k, x in zip(keys, null, strict=True)], np.frombuffer(data, "<u4", n, 13 + 9 * n), ids


def write_tokens(df: DataFrame, tokenizer: str, folder: str, end: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of every text, each followed by `end`, to files in `folder`, in ascending order of (id, hash of the text).

    Null ids come first, a null text is empty, rows that repeat are written each. Returns the
    manifest: shard, number, file, documents, tokens, start (the ids of all files before it). An
    empty table gives a table without frequencies and no files.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def drafted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).arrays, TaskContext.get().partitionId()
        files, path = store.opened(folder)
        keys, sizes, parts, held, number = [], [], [], 0, 0

        def wrote() -> pa.RecordBatch:
            lengths, ids = np.concatenate(sizes), np.concatenate(parts)
            name = f"{shard:06d}-{number:06d}"
            store.put(files, f"{path}/{name}.draft", _draft(keys, lengths, ids))
            counts = np.bincount(ids).astype("<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"shard": shard, "number": number, "file": name, "documents": len(keys), "tokens": len(ids), "counts": zstandard.compress(counts)}], _MANIFEST)

        for batch in batches:
            row = 0
            for ids, lengths in encode(batch.column(1)):
                own, row = batch.column(0).slice(row, len(lengths)).to_pylist(), row + len(lengths)
                ids, lengths = np.insert(ids, np.cumsum(lengths), end), lengths + 1
                ends, done = np.append(0, np.cumsum(lengths)), 0
                while done < len(own):  # up to the document that fills a file
                    to = min(len(own), int(np.searchsorted(ends, ends[done] + FILE_TOKENS - held)))
                    keys += own[done:to]
                    sizes.append(lengths[done:to])
                    parts.append(ids[ends[done] : ends[to]])
                    held, done = held + len(parts[-1]), to
                    if held >= FILE_TOKENS:
                        yield wrote()
                        keys, sizes, parts, held, number = [], [], [], 0, number + 1
        if keys:
            yield wrote()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(zstandard.decompress(x.as_py()), "<i8")
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), np.int64))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    drafts = written(docs.mapInArrow(drafted, "shard long, number long, file string, documents long, tokens long, counts binary"))
    counts = drafts.select("counts").mapInArrow(counted, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    n = np.zeros(max((r.symbol for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        n[r.symbol] = r["n"]
    image = Table(scaled(n)).image()
    files, path = store.opened(folder)
    store.put(files, f"{path}/table.ans", image)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store.opened(folder)
        table = Table.of(image)
        for batch in batches:
            for shard, number, name in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if not store.there(files, f"{path}/{name}.tok"):
                    store.put(files, f"{path}/{name}.tok", file_image(shard, number, *_of_draft(store.get(files, f"{path}/{name}.draft")), table))
                if store.there(files, f"{path}/{name}.draft"):
                    files.delete_file(f"{path}/{name}.draft")
            yield batch

    listed = drafts.drop("counts").repartition(max(1, drafts.count()), "shard", "number").mapInArrow(finished, "shard long, number long, file string, documents long, tokens long")
    listed = written(listed)
    shards = listed.groupBy("shard").agg(F.sum("tokens").alias("tokens"), F.first(F.floor(F.col("shard") / 1000)).alias("range"))
    # two levels of sums, so that no window holds every shard
    ranges = shards.groupBy("range").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("range", (F.sum("tokens").over(Window.orderBy("range")) - F.col("tokens")).alias("before_range"))
    shards = shards.select("shard", "range", (F.sum("tokens").over(Window.partitionBy("range").orderBy("shard")) - F.col("tokens")).alias("before_shard")).join(ranges, "range")
    inside = F.sum("tokens").over(Window.partitionBy("shard").orderBy("number")) - F.col("tokens")
    return listed.withColumn("inside", inside).join(shards, "shard").select("shard", "number", "file", "documents", "tokens", (F.col("before_range") + F.col("before_shard") + F.col("inside")).alias("start"))


_MANIFEST = pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("counts", pa.binary())])


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = True, id_column: str = "doc_id") -> DataFrame:
    """The documents of the files in `folder`: id, shard, number, position (in the file), offset (ids before it in the file), n_tokens, ids_crc32 and, with keep_ids, ids (binary: little-endian unsigned 32-bit).

    Every file and block is verified; one that isn't as it was written raises Corrupt.
    """
    files, path = store.opened(folder)
    image = store.get(files, f"{path}/table.ans")
    names = [id_column, "shard", "number", "position", "offset", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    schema = f"`{id_column}` long, shard long, number long, position long, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    if not store.listed(folder, ".tok"):
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(image)
        for batch in batches:
            for content in batch.column(0):
                shard, number, keys, lengths, ids = read_image(content.as_py(), table)
                ends = np.cumsum(lengths, dtype=np.int64)
                data = ids.astype("<u4").tobytes()
                for at in range(0, len(keys), 5000):
                    starts = (ends - lengths)[at : at + 5000]
                    parts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends[at : at + 5000].tolist(), strict=True)]
                    m = len(parts)
                    columns = [pa.array(keys[at : at + 5000], pa.int64()), pa.array(np.full(m, shard, np.int64)), pa.array(np.full(m, number, np.int64)), pa.array(np.arange(at, at + m)), pa.array(starts), pa.array(lengths[at : at + 5000].astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * keep_ids, names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content").mapInArrow(read, schema)


def tokens_round_trip(df: DataFrame, tokenizer: str, end: int = 2, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Writes df's texts by write_tokens() to `folder` (else a new shared one) and reads them back: the columns of read_tokens(), with `start` among all ids."""
    folder = folder or shared_folder(df.sparkSession)
    manifest = write_tokens(df, tokenizer, folder, end, id_column, text).select("shard", "number", F.col("start").alias("file_start"))
    found = read_tokens(df.sparkSession, folder, keep_ids, id_column)
    return found.join(manifest, ["shard", "number"]).withColumn("start", F.col("file_start") + F.col("offset")).drop("file_start")
