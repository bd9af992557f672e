"""Quality rules: word and line statistics, and bands of n-gram perplexity by language.

The model of a language: n-grams of ORDER characters over all its documents, counted by Spark,
with modified Kneser-Ney smoothing (three discounts an order, from counts of counts) and
interpolated lower orders of continuation counts, all of it by joins and aggregates on
(language, n-gram). A character is its own symbol of 16 bits, whatever the script; only white
space (runs count once), digits and characters beyond U+FFFF share symbols. So four symbols are
a 64-bit number, and suffix and context are masks and shifts of it.

The model grows with the corpus and is never collected or broadcast. It is written to the shared
folder as sorted arrays of 64-bit hashes with log probabilities and backoff weights beside them:
a folder for each language, files of at most FILE_ROWS entries named after their hash ranges.
Scoring tasks look the distinct n-grams of many documents up at once, in the files whose ranges
they meet, and keep at most CACHE_BYTES of files.

A document is read by its own language's model. The bands: a language's documents that pass the
base rules have a median log perplexity and a median absolute deviation from it; documents
beyond `below` or `above` deviations are rejected. Perplexities are by word: signs strewn between
words, which a model soon expects, cost their words more. Languages of fewer than `least_documents`
documents, and null ones, are too small to tell a band: they share one model and one band.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import store
from sketchloom.llm.common import plain_names, shared_folder, written

ORDER, SYMBOL_BITS = 4, 16
#: Symbols: 0 pads, 1 is white space, 2 a digit; the code points of surrogates stand for characters beyond U+FFFF.
SPACE, DIGIT, BEYOND, BEYOND_ROOM = 1, 2, 0xD800, 0x800
#: The group of languages without a model of their own.
OTHER = ""
#: Characters folded at once, and about how many are looked up together.
PIECE, TOGETHER = 1 << 20, 1 << 21
#: Entries of a file, and bytes of files that a task keeps.
FILE_ROWS, CACHE_BYTES = 1 << 20, 96 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Deviations below and above a language's median, and documents that a language needs for a band of its own.
BELOW, ABOVE, LEAST_DOCUMENTS = 6.0, 4.5, 30
#: Log perplexities are counted in bins of this width for the bands.
BIN = 0.01


def _folding() -> np.ndarray:
    table = np.arange(1 << SYMBOL_BITS, dtype=np.uint16)
    table[:33] = SPACE
    table[[0x7F, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = SPACE
    table[48:58] = DIGIT
    return table


FOLDING = _folding()


def folded(text: str, last: int = 0) -> np.ndarray:
    """The text's symbols, runs of white space as one; `last` is the symbol before."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = points >> np.uint32(SYMBOL_BITS) != 0
    symbols = FOLDING[np.where(high, 0, points)]
    if high.any():
        symbols[high] = BEYOND + points[high] % BEYOND_ROOM
    blank = symbols == SPACE
    if len(symbols):
        blank[1:] &= symbols[:-1] == SPACE
        blank[0] &= last == SPACE
    return symbols[~blank]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """For pieces of the text, the ORDER symbols that end at each of its symbols, as one number; pads stand before the first."""
    before = np.zeros(ORDER - 1, np.uint16)
    for at in range(0, len(text or ""), PIECE):
        symbols = np.concatenate([before, folded(text[at : at + PIECE], int(before[-1]))])
        before = symbols[-(ORDER - 1) :]
        n = len(symbols) - ORDER + 1
        code = np.zeros(n, np.uint64)
        for k in range(ORDER):
            code = code << np.uint64(SYMBOL_BITS) | symbols[k : k + n]
        yield code


def low_symbols(codes: np.ndarray, k: int) -> np.ndarray:
    return codes & np.uint64((1 << SYMBOL_BITS * k) - 1)


def key_of(kind: int, codes: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits. Kinds 1 to ORDER are n-grams of that length, ORDER + k the contexts of n-grams of length k."""
    x = codes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArrays:
    """The sorted hash arrays of a model's languages, read from its folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.files: dict[str, list[tuple[int, int, str]]] = {}
        self.held: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.bytes = 0

    def _listed(self, own: str) -> list[tuple[int, int, str]]:
        if own not in self.files:
            names = [path for path, _ in store.listed(f"{self.folder}/{place_of(own)}", ".kn")]
            self.files[own] = [(int(n[-36:-20], 16), int(n[-19:-3], 16), n) for n in names]
        return self.files[own]

    def _arrays(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        if path not in self.held:
            data = store.get(store.opened(self.folder)[0], path)
            n = len(data) // 12
            self.held[path] = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float32, n, 8 * n)
            self.bytes += len(data)
            while self.bytes > CACHE_BYTES and len(self.held) > 1:
                self.bytes -= 12 * len(self.held.popitem(last=False)[1][0])
        self.held.move_to_end(path)
        return self.held[path]

    def find(self, own: str, keys: np.ndarray) -> np.ndarray:
        """The value of each key in a language's arrays; NaN where there is none."""
        order = np.argsort(keys)
        wanted, found = keys[order], np.full(len(keys), np.nan)
        for first, last, path in self._listed(own):
            a, b = np.searchsorted(wanted, np.uint64(first), "left"), np.searchsorted(wanted, np.uint64(last), "right")
            if a < b:
                have, values = self._arrays(path)
                at = np.minimum(np.searchsorted(have, wanted[a:b]), len(have) - 1)
                same = have[at] == wanted[a:b]
                found[a:b][same] = values[at][same]
        out = np.empty(len(keys))
        out[order] = found
        return out

    def logp(self, own: str, codes: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the others; backs off while an n-gram is unseen."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            mine, at = np.unique(low_symbols(codes[left], k), return_inverse=True)
            value = self.find(own, key_of(k, mine))[at]
            seen = ~np.isnan(value)
            out[left[seen]] += value[seen]
            left = left[~seen]
            if not len(left):
                return out
            contexts, at = np.unique(low_symbols(codes[left], k) >> np.uint64(SYMBOL_BITS), return_inverse=True)
            weight = self.find(own, key_of(ORDER + k, contexts))[at]
            out[left] += np.where(np.isnan(weight), 0.0, weight)
        out[left] -= math.log(1 << SYMBOL_BITS)
        return out


def place_of(own: str) -> str:
    """A language's folder."""
    return f"l{own.encode('utf-8', 'replace').hex()}"


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: none of any."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    found = data.split()
    n = len(found)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars, symbols = len(text) - int(seen[list(SPACES)].sum()), int(seen[list(SYMBOLS)].sum())
    lines, twice = set(), 0
    for line in data.split(b"\n") if b"\n" in data else ():
        if line in lines:
            twice += bool(line.split())
        lines.add(line)
    repeated = 0
    if n >= 4:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, n)
        pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1] if len(index) > 1 << 20 else None
        key = pairs[:-1] * len(index) + ids[2:] if pairs is not None else (ids[:-2] * len(index) + ids[1:-1]) * len(index) + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        often = np.zeros(n - 2, bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        repeated = int(covered.sum())
    return n, chars, symbols, twice, repeated


def with_group(df: DataFrame, lang: str, least_documents: int) -> DataFrame:
    """df with `__group`: its language if that has at least so many rows, else OTHER."""
    many = df.where(F.col(f"`{lang}`").isNotNull()).groupBy(F.col(f"`{lang}`").alias("__lang")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    own = written(many.select("__lang", F.col("__lang").alias("__group")))  # read back, its size is known: Spark sends it to all tasks only if it is small
    return df.join(own, F.col(f"`{lang}`") == F.col("__lang"), "left").drop("__lang").withColumn("__group", F.coalesce("__group", F.lit(OTHER)))


def count_grams(df: DataFrame, text: str, group: str) -> DataFrame:
    """(lang, gram, n) over whole texts: counted in each task, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def add(own: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(own)), return_counts=True)
            held[own] = 0
            if own in totals:
                codes, at = np.unique(np.concatenate([codes, totals[own][0]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, totals[own][1]])).astype(np.int64)
            totals[own] = codes, n

        def out(own: str) -> Iterator[pa.RecordBatch]:
            codes, n = totals.pop(own)
            for at in range(0, len(codes), 50_000):
                some = codes[at : at + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(some), pa.string()), pa.array(some), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])

        for batch in batches:
            for x, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for codes in grams(x.as_py()):
                    waiting.setdefault(own, []).append(codes)
                    held[own] = held.get(own, 0) + len(codes)
                    if held[own] > TOGETHER:
                        add(own)
                if sum(held.values()) > 2 * TOGETHER:
                    for some in [x for x in waiting if waiting[x]]:
                        add(some)
                if sum(len(n) for _, n in totals.values()) > 2 * TOGETHER:
                    for some in list(totals):
                        yield from out(some)
        for own in list(waiting):
            add(own)
        for own in list(totals):
            yield from out(own)

    return df.select(F.col(f"`{text}`"), group).mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shorter(level: DataFrame, k: int) -> DataFrame:
    """Continuation counts of n-grams of length k: how many symbols each has been seen after."""
    return level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def discounts(levels: list[DataFrame]) -> DataFrame:
    """(lang, k, d1, d2, d3) of the n-grams of each length k, from counts of counts (Chen and Goodman), kept between 0 and the count."""
    counts = [level.groupBy("lang", F.lit(k).alias("k")).agg(*(F.sum((F.col("n") == j).cast("double")).alias(f"n{j}") for j in range(1, 5))) for k, level in enumerate(levels, 1)]
    n = counts[0]
    for more in counts[1:]:
        n = n.unionByName(more)
    told = (F.col("n1") > 0) & (F.col("n2") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = []
    for k, plain in ((1, 0.5), (2, 0.75), (3, 0.9)):
        here, there = F.col(f"n{k}"), F.col(f"n{k + 1}")
        d = F.when((here > 0) & (there > 0), k - (k + 1) * y * there / here).otherwise(0.5 * k)
        out.append(F.when(told, F.greatest(F.lit(0.05), F.least(F.lit(0.95 * k), d))).otherwise(plain).alias(f"d{k}"))
    return n.select("lang", "k", *out)


def smoothed(level: DataFrame, by: DataFrame, lower: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, p) of the n-grams of length k, and (lang, context, weight): what a context leaves to the lower order."""
    rows = level.join(by.where(F.col("k") == k).drop("k"), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    rows = rows.select("lang", "gram", F.shiftrightunsigned("gram", SYMBOL_BITS).alias("context"), "n", "d")
    sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
    rows = rows.join(sums, ["lang", "context"])
    if lower is None:
        rows = rows.withColumn("q", F.lit(1 / (1 << SYMBOL_BITS)))
    else:
        suffix = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * (k - 1)) - 1))
        rows = rows.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
    p = (F.col("n") - F.col("d") + F.col("freed") * F.col("q")) / F.col("total")
    return rows.select("lang", "gram", p.alias("p")), sums.select("lang", "context", (F.col("freed") / F.col("total")).alias("weight"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): log probabilities and backoff weights of all orders, from (lang, gram, n)."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, written(shorter(levels[0], k)))
    by = written(discounts(levels))  # read back, its size is known: Spark sends it to all tasks only if it is small
    out, lower = None, None
    for k, level in enumerate(levels, 1):
        lower, weights = smoothed(level, by, lower, k)
        if k < ORDER:
            lower = written(lower)
        own = lower.select("lang", F.lit(k).alias("kind"), "gram", F.log("p").alias("value"))
        own = own.unionByName(weights.select("lang", F.lit(ORDER + k).alias("kind"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        out = own if out is None else out.unionByName(own)
    return out


def write_arrays(model: DataFrame, folder: str) -> None:
    """The model's entries as sorted hash arrays in `folder`. A repeated task leaves files with the same entries."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, codes = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            keys = np.zeros(len(codes), np.uint64)
            for kind in np.unique(kinds):
                keys[kinds == kind] = key_of(int(kind), codes[kinds == kind])
            ordered = (keys ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the order of unsigned
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ordered), batch.column(3)], names=["lang", "key", "value"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store.opened(folder)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own, rows, wrote = None, 0, 0

        def finish() -> None:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = keys.view(np.uint64) ^ np.uint64(1 << 63)
            store.put(files, f"{path}/{place_of(own)}/{int(keys[0]):016x}-{int(keys[-1]):016x}.kn", keys.tobytes() + values.astype(np.float32).tobytes())

        for batch in batches:
            langs = batch.column(0)
            names = langs.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(names)) if len(cuts) else [], strict=True):
                for at in range(a, b, FILE_ROWS):
                    stop = min(b, at + FILE_ROWS)
                    if held and (names[a] != own or rows + stop - at > FILE_ROWS):
                        finish()
                        held, rows, wrote = [], 0, wrote + 1
                    own, rows = names[a], rows + stop - at
                    held.append((batch.column(1).slice(at, stop - at).to_numpy(), batch.column(2).slice(at, stop - at).to_numpy()))
        if held:
            finish()
            wrote += 1
        yield pa.RecordBatch.from_arrays([pa.array([wrote], pa.int64())], names=["files"])

    entries = written(model.mapInArrow(keyed, "lang string, key long, value double"))  # ranges are told from a look at it
    entries.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key").mapInArrow(put, "files long").agg(F.sum("files")).collect()


def train(df: DataFrame, text: str, group: str) -> str:
    """The folder of the models of df's language groups, from all its rows."""
    folder = shared_folder(df.sparkSession)
    write_arrays(kneser_ney(written(count_grams(df, text, group))), folder)
    return folder


def measure(df: DataFrame, folder: str, text: str, group: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of df, the statistics, `lang_group` and `log_perplexity` by word (null for a text without words)."""
    fields = df.select(*(F.col(f"`{c}`") for c in keep)).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{c}` long" for c in STATISTICS] + ["lang_group string", "log_perplexity double"])
    names = [*keep, *STATISTICS, "lang_group", "log_perplexity"]
    k = len(keep)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HashArrays(folder)
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            groups = batch.column(k + 1).to_pylist()
            told, total = [], np.zeros(len(groups))
            waiting: dict[str, list[tuple[int, np.ndarray]]] = {}
            held = 0

            def look_up(waiting: dict, total: np.ndarray) -> None:
                for own, parts in waiting.items():
                    distinct, at = np.unique(np.concatenate([c for _, c in parts]), return_inverse=True)
                    logp = model.logp(own, distinct)[at]
                    rows = np.repeat([r for r, _ in parts], [len(c) for _, c in parts])
                    total += np.bincount(rows, logp, len(total))
                waiting.clear()

            for row, (x, own) in enumerate(zip(batch.column(k), groups, strict=True)):
                x = x.as_py()
                told.append(statistics(x))
                for codes in grams(x):
                    waiting.setdefault(own, []).append((row, codes))
                    held += len(codes)
                    if held > TOGETHER:
                        look_up(waiting, total)
                        held = 0
            look_up(waiting, total)
            values = [pa.array(c, pa.int64()) for c in zip(*told, strict=True)]
            n_words = np.array([t[0] for t in told])
            mean = pa.array(-total / np.maximum(n_words, 1), pa.float64(), mask=n_words == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *values, pa.array(groups, pa.string()), mean], names=names)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"), F.col(f"`{group}`").alias("__of")).mapInArrow(measured, schema)


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame, below: float, above: float) -> DataFrame:
    """(lang_group, low, high): for each group with a document to tell it, the median log perplexity, less `below` and plus `above` scaled median absolute deviations.

    From counts of documents in bins of log perplexity, of which a language has a few thousand at most.
    """
    bins = measured.where(~base_failed() & F.col("log_perplexity").isNotNull()).groupBy("lang_group", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = written(bins.select("lang_group", ((F.col("bin") + 0.5) * BIN).alias("x"), "n"))
    middle = bins.groupBy("lang_group").agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("middle"))
    spread = bins.join(middle, "lang_group").groupBy("lang_group", "middle").agg(F.percentile(F.abs(F.col("x") - F.col("middle")), F.lit(0.5), F.col("n")).alias("spread"))
    spread = spread.withColumn("spread", F.greatest(1.4826 * F.col("spread"), F.lit(5 * BIN)))
    return written(spread.select("lang_group", (F.col("middle") - below * F.col("spread")).alias("low"), (F.col("middle") + above * F.col("spread")).alias("high")))


def judged(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """`measured` with base_failed and kept: not failed, and within the band of its language (a text or language without one is kept)."""
    rows = measured.join(bands, "lang_group", "left").withColumn("base_failed", base_failed())
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("low", "high")


def _measured(df: DataFrame, text: str, lang: str, least_documents: int, keep: list[str]) -> DataFrame:
    rows = with_group(df, lang, least_documents)
    return written(measure(rows, train(rows, text, "__group"), text, "__group", keep))


def assess(df: DataFrame, text: str = "text", lang: str = "lang", below: float = BELOW, above: float = ABOVE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, the statistics, log_perplexity, base_failed and kept for each row of df.

    A null text has no words and fails; a null language belongs to the shared rest. Rows that
    repeat are judged each. An empty table gives no rows.
    """
    measured = _measured(df.select("doc_id", text, lang), text, lang, least_documents, ["doc_id"])
    return judged(measured, bands(measured, below, above))


def filter_documents(df: DataFrame, text: str = "text", lang: str = "lang", below: float = BELOW, above: float = ABOVE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of df that the rules keep, with df's columns."""
    plain, at = plain_names(df)
    measured = _measured(plain, at[text], at[lang], least_documents, plain.columns)
    return judged(measured, bands(measured, below, above)).where("kept").select(plain.columns).toDF(*df.columns)
