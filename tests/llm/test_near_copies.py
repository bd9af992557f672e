"""Near copies against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sketchloom.llm import near_copies, simhash
from sketchloom.llm.common import table, words


def brute(texts):
    """Component (smallest id) of each id, by Jaccard similarity 0.8 of five-word shingles."""
    sets = {}
    for k, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def edited(rng, text, n):
    for _ in range(n):
        text[rng.randrange(len(text))] = f"new{rng.randrange(10**9)}"
    return " ".join(text)


@pytest.mark.parametrize(("few", "neighbours"), [(32, 4), (2, 1)])
def test_near_copies_are_all_found(spark, monkeypatch, few, neighbours):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "NEIGHBOURS", neighbours)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, texts = " ".join(fresh(40)), {}
    for _ in range(12):  # some within 0.8 of each other, some not
        base = fresh(rng.randrange(60, 200))
        for _ in range(4):
            texts[len(texts)] = edited(rng, list(base), rng.randrange(0, 7))
    base = fresh(120)
    for _ in range(60):  # a crowd
        texts[len(texts)] = edited(rng, list(base), rng.randrange(0, 6))
    for _ in range(50):  # share a long passage, and no more
        texts[len(texts)] = f"{common} {' '.join(fresh(12))}"
    texts |= {1000: None, 1001: "", 1002: "a B c", 1003: "A b  c", 1004: "a b c d"}
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(texts)


def test_stage_leaves_one_of_documents_alike(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    left = corpus_pipeline.near_duplicates_stage(spark, docs, sf)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(k for k, v in want.items() if k == v)


def test_rows_of_odd_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c d"), (None, "C  d"), (2, None), (3, ""), (4, "a b")]
    left = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left if r.text) in ([(0, "C  d"), (1, "a b")], [(0, "c d"), (1, "a b")]) and [r.doc_id for r in left if not r.text] == [2]
    assert near_copies.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_find_candidates_before_prefixes_do(spark, monkeypatch):
    """Without the meetings of prefixes, texts with fingerprints within 2 bits are linked, if the sets are alike."""
    whole = near_copies.meetings
    monkeypatch.setattr(near_copies, "meetings", lambda *args: whole(*args).where("false"))
    rng = random.Random(7)
    text = [f"w{k}" for k in rng.sample(range(10**6), 1000)]
    bits = lambda x: (near_copies.fingerprint(" ".join(text), 5) ^ near_copies.fingerprint(" ".join(x), 5)).bit_count()
    near = {bits(x): x for k in range(1, 40) for x in [[*text[:-k], *(f"other{i}" for i in range(k))]]}
    assert {0, 1, 2} <= set(near)
    rows = [(1, " ".join(text)), (2, " ".join(near[0])), (3, " ".join(near[1])), (4, " ".join(near[2])), (5, "a b c d e f"), (6, "b c a d e f")]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    rng, made = random.Random(9), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {k: edited(rng, list(base), rng.randrange(2, 6)) for k in range(600)}
    whole = near_copies.strangers
    monkeypatch.setattr(near_copies, "strangers", lambda *args: made.append(whole(*args)) or made[-1])
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(texts)
    assert sum(x.count() for x in made) <= len(texts)


def test_links_that_span_are_of_those_given():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        a = rng.integers(0, 300, n).astype(np.uint64)
        b = a + rng.integers(1, 9, n).astype(np.uint64)
        x, y = simhash.spanning(a, b)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(x) < 2 * len(np.unique([a, b]))
        assert all(np.array_equal(p, q) for p, q in zip(simhash.forest(x, y), simhash.forest(a, b), strict=True))


def test_whole_sets_are_fetched_for_pairs_that_may_be_alike_only(spark, monkeypatch):
    """Texts that share rare shingles meet, but what differs in far more than links allow isn't compared; no table has whole sets."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, texts = [fresh(60) for _ in range(6)], {}
    for passage in common:  # frequent, so that the rare ones come first
        for _ in range(10):
            texts[len(texts)] = " ".join([*passage, *fresh(60)])
    for _ in range(12):
        rare = fresh(40)
        for passage in rng.sample(common, 2):
            texts[len(texts)] = " ".join([*rare, *passage])
    for _ in range(5):
        base = fresh(100)
        for k in (0, 2, 3):
            texts[len(texts)] = edited(rng, list(base), k)
    compared, tables = [], []
    alike, written = near_copies.alike, near_copies.written
    monkeypatch.setattr(near_copies, "alike", lambda df, pairs, *args: compared.append(pairs.count()) or alike(df, pairs, *args))
    monkeypatch.setattr(near_copies, "written", lambda df, *args: tables.append(df.columns) or written(df, *args))
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(texts)
    assert sum(compared) <= 15 and not any("own" in columns for columns in tables)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_marks_tell_all_names_and_few_others(spark, n):
    rng = np.random.default_rng(n)
    names = rng.integers(-(2**63), 2**63, 60_000)
    told = near_copies.among(spark.createDataFrame([(int(x),) for x in names[:n]], "node long"))(names)
    assert told[:n].all() and told[n:].mean() < 1 / 25
