"""Toxicity: gradient-boosted trees over dense features of a text, calibrated isotonically.

Features: densities of a lexicon's words and stems, how near they are to words of the second
person, rates of capitals, punctuation and obfuscated words, and the length. The lexicon is
learned: words and word beginnings that are far more frequent in toxic texts. Lexicon, trees
and calibration are fitted on a sample of labelled rows, at most `per_class` of each label,
chosen by a hash of the id; weights restore the labels' shares. All rows serve all three, each
fold with what the other folds have taught.
Scoring runs over whole texts of all rows in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import boosting
from sketchloom.llm.common import written

#: Words that address someone, in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinem deinen euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro vuestra".split())
#: Characters that stand for letters.
DISGUISES = str.maketrans("0134578@$!|+€", "oieastbasilte")
STEMS = (4, 5, 6, 7)
NEAR = 5
FOLDS = 5
NAMES = ("log_words", "lexicon", "strong", "weight", "distinct", "hits", "disguised_hits", "disguised", "second_person", "near", "capitals", "shouted", "exclamations", "punctuation", "digits", "letters")
LETTERS = re.compile(r"[^\W\d_]+")
BETWEEN = re.compile(r"[^\W\d_][0-9@$!|+€*.\-_]+[^\W\d_]")
REPEATS = re.compile(r"(.)\1{2,}")
#: Runs of what BETWEEN may join, with what stands around them; and what joins words in them.
PIECES = re.compile(r"[^\w@$!|+€*.\-]*[\w@$!|+€*.\-]+(?:[^\w@$!|+€*.\-]+(?![\w@$!|+€*.\-]))?")
JOINED = re.compile(r"[.\-_]+")
#: Chunks are remembered, so many of at most so many bytes.
MEMO, LONG = 300_000, 200
#: Bits of a chunk's description, above the 12 bits of its lexicon entry plus 1.
SECOND, CAPITAL, SHOUT, EXCLAIM, PUNCTUATION, DIGIT, DISGUISE, DISGUISED_HIT = (1 << (12 + k) for k in range(8))


def entries_of(word: str) -> list[str]:
    """What the lexicon may have of a word (lower case): itself, and its beginnings with a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def text_entries(text: str | None) -> set[str]:
    return {e for w in set(LETTERS.findall((text or "").lower())) for e in entries_of(w)}


@dataclass
class Extractor:
    """Dense features by a lexicon: entry to weight, 4,000 at most."""

    lexicon: dict[str, float]

    def __post_init__(self) -> None:
        self.index = {e: k + 1 for k, e in enumerate(self.lexicon)}
        self.starts = {e.rstrip("*")[:4] for e in self.lexicon}  # no STEMS is shorter
        self.weights = np.array([0.0, *self.lexicon.values()])
        self.strong = max(self.weights.max() * 0.6, 1e-9)
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.same: dict[tuple[int, ...], tuple[int, ...]] = {}  # one tuple for all chunks with these codes

    def entry(self, word: str) -> int:
        if word[:4] not in self.starts:
            return 0
        found = [self.index[e] for e in entries_of(word) if e in self.index]
        return max(found, key=lambda k: self.weights[k], default=0)

    def described(self, chunk: bytes) -> tuple[int, ...]:
        """For each word of what stands between white space, its lexicon entry and traits; a disguised word, and signs alone, have one code."""
        text = chunk.decode("utf-8", "replace")
        if text.isalpha():
            return tuple(self.piece(text))
        return tuple(code for piece in map(str.strip, PIECES.findall(text) or [text]) if piece for code in self.piece(piece))

    @staticmethod
    def traits(text: str, words: list[str]) -> int:
        code = 0 if SECOND_PERSON.isdisjoint(words) else SECOND
        if text[:1].isupper():
            code |= CAPITAL
        if text.isupper() and sum(map(len, words)) > 1:
            code |= SHOUT
        if text.isalpha():
            return code
        if "!" in text:
            code |= EXCLAIM
        if not text.isalnum():
            code |= PUNCTUATION
        if any(map(str.isdigit, text)):
            code |= DIGIT
        return code

    def disguised(self, low: str) -> int:
        plain = low.strip(".,;:?!\"'()").translate(DISGUISES)
        for form in (re.sub(r"[^\w]|_", "", plain), REPEATS.sub(r"\1", plain), REPEATS.sub(r"\1\1", plain)):
            if hit := self.entry(form):
                return hit
        return 0

    def piece(self, text: str) -> list[int]:
        """The codes of a run of letters, digits and signs that may stand for letters or join words."""
        low = text.lower()
        plain = text.isalpha()
        words = LETTERS.findall(low)
        odd = (not plain and BETWEEN.search(low) is not None) or REPEATS.search(low) is not None
        hits = [k for w in words if (k := self.entry(w))]
        if odd and not hits and (hit := self.disguised(low)):
            return [hit | self.traits(text, words) | DISGUISE | DISGUISED_HIT]
        if len(words) > 1 and not plain:
            parts = [p for p in JOINED.split(text) if p]
            if sum(LETTERS.search(p) is not None for p in parts) > 1:
                codes = [code | PUNCTUATION for part in parts for code in self.piece(part)]
                return [codes[0] | DISGUISE * odd, *codes[1:]]
        code = self.traits(text, words) | DISGUISE * odd
        if len(hits) < 2:
            return [code | sum(hits)]
        return [self.entry(w.lower()) | self.traits(w, [w.lower()]) | code & ~SECOND & ~CAPITAL & ~SHOUT for w in LETTERS.findall(text)]

    def codes(self, text: str | None) -> np.ndarray:
        chunks = (text or "").encode("utf-8", "replace").split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            self.same.clear()
        long = {}
        for chunk in set(chunks):
            if chunk not in memo:
                found = self.described(chunk)
                if len(chunk) <= LONG:
                    memo[chunk] = self.same.setdefault(found, found)
                else:
                    long[chunk] = found
        found = chain.from_iterable(map(memo.__getitem__, chunks) if not long else (memo.get(c) or long[c] for c in chunks))
        return np.fromiter(found, np.int64)

    def __call__(self, text: str | None) -> list[float]:
        codes = self.codes(text)
        n = max(1, len(codes))
        own = codes & 0xFFF
        hits = np.flatnonzero(own)
        weights = self.weights[own[hits]]
        rate = lambda bit: float(np.count_nonzero(codes & bit)) / n
        second = np.flatnonzero(codes & SECOND)
        near = 0.0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= NEAR).mean())
        strong = int((weights >= self.strong).sum())
        return [math.log1p(len(codes)), len(hits) / n, strong / n, float(weights.sum()) / n, float(len(np.unique(own[hits]))), float(len(hits)), float(np.count_nonzero(codes & DISGUISED_HIT)), rate(DISGUISE), len(second) / n, near, rate(CAPITAL), rate(SHOUT), rate(EXCLAIM), rate(PUNCTUATION), rate(DIGIT), len(text or "") / n]


def features(df: DataFrame, lexicon: dict[str, float], text: str) -> DataFrame:
    """df with `features` (array of double) in place of its texts."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["features array<double>"])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(lexicon)
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*(f.name for f in keep), "features"])

    return df.select(*(F.col(f.name) for f in keep), F.col(text)).mapInArrow(extracted, schema)


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, part, ones, zeros): in how many texts of each label an entry is, by part; sample has text, y and part."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: Counter = Counter()
        for batch in batches:
            for x, y, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by.update((e, part, y) for e in text_entries(x.as_py()))
        keys = list({k[:2] for k in by})
        columns = [[e for e, _ in keys], [p for _, p in keys], [by[(*k, 1)] for k in keys], [by[(*k, 0)] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["entry", "part", "ones", "zeros"])

    return sample.select("text", "y", "part").mapInArrow(counted, "entry string, part long, ones long, zeros long")


def learned_lexicon(counts: DataFrame, ones: int, zeros: int, size: int = 500) -> dict[str, float]:
    """Entries by their log odds in `ones` texts of label 1 against `zeros` others: the `size` that tell most, of those at least 4 times as frequent."""
    if not ones or not zeros:
        return {}
    counts = counts.groupBy("entry").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    odds = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    told = counts.where(F.col("ones") >= max(2, ones // 500)).withColumn("odds", odds).where(F.col("odds") >= math.log(4))
    rows = told.orderBy((F.col("ones") * F.col("odds")).desc(), "entry").limit(min(size, 4000)).collect()
    return {r.entry: float(r.odds) for r in rows}


@dataclass
class Model:
    """Score of a text's features: 0 to 1, higher if label 1 is likelier."""

    lexicon: dict[str, float]
    trees: boosting.Boosted | None
    calibration: boosting.Isotonic | None
    share: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return np.clip(self.calibration(self.trees(x)), 0.0, 1.0)


def train(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 5000, trees: int = 80) -> Model:
    """A model from `labels` (id, label 0 or 1) of rows of df.

    At most `per_class` labelled ids of each label are used, those whose hash is smallest.
    Null ids and other labels are left out; an id labelled both ways counts as 1, and of an id
    that repeats in df the text that is first in order is learned from. Without
    rows of both labels the score is the share of label 1 among the labels (0 without any).
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    clean = clean.withColumn("h", F.xxhash64("id"))
    totals = {r.y: r["n"] for r in clean.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    chosen = clean.where("y = 1").orderBy("h", "id").limit(per_class).unionByName(clean.where("y = 0").orderBy("h", "id").limit(per_class))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # 2 * per_class ids at most
    rows = rows.select("id", "text", "y", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).alias("part"))
    rows = rows.groupBy("id", "y", "part").agg(F.min("text").alias("text"))  # so that no id has more than its share
    rows = written(rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "id"))
    many = {(r.part, r.y): r["n"] for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def lexicon_of(counts: DataFrame, parts: set[int]) -> dict[str, float]:
        ones, zeros = (sum(n for (p, y), n in many.items() if p in parts and y == label) for label in (1, 0))
        return learned_lexicon(counts.where(F.col("part").isin(*parts)), ones, zeros)

    counts, every = written(entry_counts(rows)), set(range(FOLDS))
    lexicon, found = lexicon_of(counts, every), []
    for k in range(FOLDS):  # each fold's features by a lexicon of the others
        found += features(rows.where(F.col("part") == k).select("y", "part", "text"), lexicon_of(counts, every - {k}), "text").collect()  # a row for each id: 2 * per_class at most
    y, part = np.array([r.y for r in found], float), np.array([r.part for r in found])
    if len(np.unique(y)) < 2:
        return Model(lexicon, None, None, share)
    x = np.array([r.features for r in found])
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    model = boosting.fit(x, y, trees=trees)
    odds = model(x)
    for k in range(FOLDS):
        if len(np.unique(y[part != k])) == 2:
            odds[part == k] = boosting.fit(x[part != k], y[part != k], trees=trees)(x[part == k])
    return Model(lexicon, model, boosting.isotonic(odds, y, weight), share)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with a score; a null text is empty. A column named `out` is replaced; others stay as they are."""
    keep = [f for f in df.schema.fields if f.name != out]
    at = [f.name for f in keep].index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out}` double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.lexicon)
        for batch in batches:
            x = np.array([extract(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(x))], names=[*batch.schema.names, out])

    return df.select(*(F.col(f"`{f.name}`") for f in keep)).mapInArrow(scored, schema)


def toxic(score_column: str | Column = "score", threshold: float = 0.5) -> Column:
    return (F.col(score_column) if isinstance(score_column, str) else score_column) >= threshold
