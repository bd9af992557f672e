"""The language model recomputed choice by choice, from its weights alone."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sketchloom.llm import lm_scoring as lm
from sketchloom.llm.common import table

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def learned(spark):
    df = table(spark, SF, "documents")
    blocks, sums = lm.corpus_blocks(df, "doc_id", "text", 0, 10)
    cut = lm.Classes.cut(sums, 8).told()
    return df, blocks, lm.fit(blocks, cut, 12, 1, 0.7)


class Plain:
    """P(token | before), one token at a time, over a dictionary of counts."""

    def __init__(self, model, counts):
        self.model, self.cut = model, model.classes
        self.counts = counts
        self.share = {}
        for w, n in [*counts.items(), *((leaf, 0) for leaf in range(lm.LEAVES))]:  # numbers: one never seen for each leaf
            if w != "":
                leaf = w if isinstance(w, int) else xxhash.xxh64_intdigest(w.encode()) % lm.LEAVES
                own = self.class_of(n)
                for key in ((own,), (own, leaf // 16), (own, leaf // 16, leaf % 16)):
                    self.share[key] = self.share.get(key, 0.0) + n + 0.1
        self.words = Counter(self.class_of(n) for w, n in counts.items() if w)

    def class_of(self, n):
        b = math.floor(32 * math.log2(max(1, n))) if n else -1
        return 1 + sum(b < int(s) for s in self.cut.starts)

    def row(self, code, node):
        x = (code + int(node) * 0xD6E8FEB86659FD93) * 0x9E3779B97F4A7C15 & MASK
        return ((x ^ x >> 29) * 0x9E3779B97F4A7C15 & MASK) >> 64 - self.model.bits

    def choice(self, codes, node, prior, chosen):
        z = [sum(float(self.model.weights[self.row(c, node)][k]) for c in codes) + p if p > -math.inf else -math.inf for k, p in enumerate(prior)]
        top = max(z)
        return z[chosen] - top - math.log(sum(math.exp(v - top) for v in z))

    def logp(self, before, word):
        h = [xxhash.xxh64_intdigest(w.encode()) & 0xFFFFFFFF for w in before[::-1][:3]]
        b = h + list(range(len(h) + 1, 4))
        codes = [b[0] * 4, ((b[0] * 0x9E3779B97F4A7C15 + b[1]) * 4 + 1) & MASK, b[1] * 4 + 2, b[2] * 4 + 3]
        n, leaf, classes = self.counts.get(word, 0), xxhash.xxh64_intdigest(word.encode()) % 256, len(self.cut)
        own = self.class_of(n) if word else 0
        out = self.choice(codes, 0, [float(x) for x in self.model.bias], own)
        if own:
            share = lambda *key: self.share.get(key, 0.0)
            log = lambda x: math.log(x) if x else -math.inf
            words = self.words[own] + 256 * (own == classes - 1)
            depth = 0 if words <= 1 else 1 if words <= 16 else 2
            d, e = divmod(leaf, 16)
            if depth:
                out += self.choice(codes[:2], 1 + own, [log(share(own, k) / share(own)) for k in range(16)], d)
            if depth == 2:
                out += self.choice(codes[:2], 1 + classes + own * 16 + d, [log(share(own, d, k) / share(own, d)) for k in range(16)], e)
            out += math.log((n + 0.1) / share(*((own, d, e)[: depth + 1])))
        return out


def test_scores_against_plain_ones_and_probabilities_sum_to_one(spark, learned):
    df, blocks, model = learned
    docs = {r.doc_id: [w.decode() for w in lm.lower_words(r.text)] for r in df.collect()}
    counts = Counter(w for k, t in docs.items() if zlib.crc32(str(k).encode()) % 10 for w in [*t, ""])
    plain = Plain(model, counts)
    assert set(model.classes.depth) >= {0, 2} and plain.words.total() == len(counts) - 1
    some = [k for k in docs if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    for r in blocks.collect():
        block = lm.block_of(r.asDict())
        of, leaf, inside = model.targets(block)
        ends = np.cumsum(block.lengths)
        for key, a, b in zip(block.ids, ends - block.lengths, ends, strict=True):
            if key in some:
                p = block.tokens[a:b]
                got = model.logp(of[p], leaf[p], lm.feature_codes(block, a, b)) + inside[p]
                text = [*docs[key], ""]
                assert got == pytest.approx([plain.logp(text[:k], w) for k, w in enumerate(text)], abs=2e-4)
    before = docs[some[0]][:5]
    total = sum(math.exp(plain.logp(before, w)) for w in counts)
    fresh, k = {}, 0
    while len(fresh) < 256:  # a word never seen for each leaf
        w = f"never-seen-{k}"
        fresh.setdefault(xxhash.xxh64_intdigest(w.encode()) % 256, w)
        k += 1
    assert total + sum(math.exp(plain.logp(before, w)) for w in fresh.values()) == pytest.approx(1, abs=1e-3)


def test_weights_grow_with_the_tokens():
    assert [lm.bits_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)] == sorted(lm.bits_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13))
    assert lm.bits_for(10**8) > lm.bits_for(10**6) + 2 and lm.bits_for(10**15) == lm.MOST_BITS


def test_features_within_classes_help_held_out_tokens(spark):
    """Pairs of words that only the word before tells apart, all of one frequency."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        at = rng.integers(0, 60, 150)
        rows.append((k, " ".join(f"a{i} b{i}" for i in at)))
    held = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    bits = lambda column: -sum(r[column] for r in held) / sum(r.n_tokens for r in held) * math.log2(10)
    assert bits("score") < bits("base_score") - 2


class Counted(np.ndarray):
    """An array that tells which rows are taken."""

    def take(self, rows, *args, **kwargs):
        self.told.extend(np.asarray(rows).tolist())
        return np.asarray(self).take(rows, *args, **kwargs)


@pytest.mark.parametrize("wide", [5, 16])
def test_a_step_follows_the_gradient_and_reads_a_row_of_weights_once(wide):
    rng = np.random.default_rng(4)
    weights, prior, squares = rng.normal(size=(64, 16)).astype(np.float32), rng.normal(size=wide).astype(np.float32), np.full(64, 2, np.float32)
    rows, chosen = rng.integers(0, 30, (50, 3)).astype(np.int32), rng.integers(0, wide, 50)
    z = weights[rows].sum(axis=1)[:, :wide] + prior
    g = np.eye(wide)[chosen] - np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    want, size = weights.astype(float), squares.astype(float)
    for r in np.unique(rows):
        change = sum(g[i] for i, k in zip(*np.nonzero(rows == r), strict=True))
        size[r] += change @ change
        want[r, :wide] += 0.3 * change / np.sqrt(size[r])
    own = weights.view(Counted)
    own.told = []
    got = lm.step(own, prior, rows, chosen, wide, squares, 0.3)
    assert np.allclose(got, g, atol=1e-5) and np.allclose(weights, want, atol=1e-4) and np.allclose(squares, size, atol=1e-4)
    assert sorted(own.told) == np.unique(rows).tolist()


def test_features_of_a_slice_are_those_of_the_whole():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 6, 200)
    n = int(lengths.sum())
    block = lm.Block([], np.ones(200, np.uint8), lengths, rng.integers(0, 50, n).astype(np.uint32), rng.integers(0, 1 << 32, 50).astype(np.uint32), np.ones(50), 0)
    whole, at = lm.feature_codes(block, 0, n), 0
    for size in lengths:  # by document, one token at a time
        for k in range(size):
            back = [int(block.hashes[block.tokens[at + k - d]]) if k >= d else d for d in (1, 2, 3)]
            assert whole[at + k].tolist() == [back[0] * 4, (back[0] * int(lm.MIX) + back[1]) * 4 + 1 & MASK, back[1] * 4 + 2, back[2] * 4 + 3]
        at += size
    for start, stop in ((0, 1), (1, 2), (2, 9), (37, 300), (n - 1, n)):
        assert np.array_equal(lm.feature_codes(block, start, stop), whole[start:stop])


def test_only_the_blocks_are_left_on_disk(spark, monkeypatch, tmp_path):
    whole = lm.written
    names = iter("abcdef")
    monkeypatch.setattr(lm, "shared_folder", lambda spark: f"{tmp_path}/{next(names)}")
    monkeypatch.setattr(lm, "written", lambda df, folder=None, **more: whole(df, folder or f"{tmp_path}/blocks", **more))
    blocks, _ = lm.corpus_blocks(table(spark, SF, "documents"), "doc_id", "text", 0, 10)
    assert [x.name for x in tmp_path.iterdir()] == ["blocks"]
    assert sum(len(r.ids) for r in blocks.collect()) == table(spark, SF, "documents").count()
