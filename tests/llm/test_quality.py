"""Quality rules against a plain Kneser-Ney over dictionaries, and plain word and line statistics."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import catalog, quality
from sketchloom.llm.common import shared_folder, table

SF = "/root/testdata/sf0.001"


def symbols(text):
    """A character at a time."""
    out = []
    for c in text:
        s = "0" if c in "0123456789" else " " if c.isspace() or ord(c) < 33 or ord(c) == 127 else c
        if s != " " or out[-1:] != [" "]:
            out.append(s)
    return out


def four(text):
    padded = ["\0"] * 3 + symbols(text)
    return [tuple(padded[k : k + 4]) for k in range(len(padded) - 3)]


class Plain:
    """Interpolated modified Kneser-Ney from counts of tuples of four."""

    def __init__(self, texts):
        levels = {4: Counter(g for t in texts for g in four(t))}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        self.levels, self.told = levels, {}
        for k, counts in levels.items():
            n = [sum(c == j for c in counts.values()) for j in range(5)]
            if n[1] and n[2]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [min(0.95 * j, max(0.05, j - (j + 1) * y * n[j + 1] / n[j] if n[j] and n[j + 1] else 0.5 * j)) if j < 4 else 0 for j in (1, 2, 3)]
            else:
                d = [0.5, 0.75, 0.9]
            total, freed = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                freed[g[:-1]] += d[min(c, 3) - 1]
            self.told[k] = d, total, freed

    def p(self, g):
        if not g:
            return 1 / 65536
        d, total, freed = self.told[len(g)]
        lower = self.p(g[1:])
        if not total[g[:-1]]:
            return lower
        c = self.levels[len(g)][g]
        return (max(0.0, c - (d[min(c, 3) - 1] if c else 0)) + freed[g[:-1]] * lower) / total[g[:-1]]

    def log_perplexity(self, text):
        return -sum(math.log(self.p(g)) for g in four(text)) / len(text.split())


def plain_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        twice += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(covered)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").collect()]
    found = {r.doc_id: r for r in catalog.QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert len(found) == len(docs)
    many = Counter(lang for *_, lang in docs)
    group = lambda lang: lang if many[lang] >= quality.LEAST_DOCUMENTS else ""
    models = {g: Plain([t or "" for _, t, lang in docs if group(lang) == g]) for g in {group(lang) for lang in many}}
    told, logs = {}, defaultdict(list)
    for key, text, lang in docs:
        n, chars, signs, lines, repeated = plain_statistics(text)
        failed = n < 50 or 100 * repeated > 50 * n
        log = models[group(lang)].log_perplexity(text) if n else None
        told[key] = n, chars, signs, lines, repeated, failed, log
        if not failed:
            logs[group(lang)].append((math.floor(log / quality.BIN) + 0.5) * quality.BIN)
    for key, _, lang in docs:
        r, own = found[key], told[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == own[:6]
        assert own[6] is None or r.log_perplexity == pytest.approx(own[6], rel=1e-4)
        middle = np.median(logs[group(lang)])
        spread = max(1.4826 * np.median(np.abs(np.array(logs[group(lang)]) - middle)), 5 * quality.BIN)
        edges = middle - quality.BELOW * spread, middle + quality.ABOVE * spread
        if own[6] is not None and min(abs(own[6] - e) for e in edges) > 2 * quality.BIN:
            assert r.kept == (not own[5] and edges[0] <= own[6] <= edges[1])


def arrays(spark, texts):
    folder = shared_folder(spark)
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, g string")
    quality.write_arrays(quality.kneser_ney(quality.count_grams(df, "text", "g")), folder)
    return folder


def test_model_of_unseen_text_backs_off_and_is_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILE_ROWS", 50)  # many files
    texts = ["the cat and the hat and the other cat 12\n\n 7", "aé ж😀"]
    model, plain = quality.HashArrays(arrays(spark, texts)), Plain(texts)
    for text in ("the hat", "xq#jz", "thж a 9", ""):
        codes = np.concatenate([*quality.grams(text), np.zeros(0, np.uint64)])
        assert model.logp("x", codes) == pytest.approx([math.log(plain.p(g)) for g in four(text)], rel=1e-5)
    for context in ("th", "zz", "e "):
        last = list(quality.grams(context))[0][-1]
        every = (last << np.uint64(16)) | np.arange(1 << 16, dtype=np.uint64)
        assert np.exp(model.logp("x", every)).sum() == pytest.approx(1, abs=1e-4)


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "ab  c\n" * 50 + "é 😀😀  " * 30
    whole = np.concatenate(list(quality.grams(text)))
    monkeypatch.setattr(quality, "PIECE", 7)
    assert (np.concatenate(list(quality.grams(text))) == whole).all() and len(whole) == len(symbols(text))
    assert list(quality.grams(None)) == list(quality.grams("")) == []
    scripts = "жгдαβγ中文字あいう" * 2
    assert len(np.unique(quality.folded(scripts))) == len(set(scripts))  # each letter is itself


def test_a_language_is_read_by_its_own_model(spark):
    """Letters in another order are beyond the band of any script; a small language's documents are kept."""
    rng = random.Random(3)
    rows = []
    for lang, letters in (("ru", "абвгдежзиклмнопрст"), ("el", "αβγδεζηθικλμνξοπρσ"), ("de", "abcdefghiklmnoprst")):
        syllables = ["".join(rng.sample(letters, 3)) for _ in range(30)]
        for _ in range(60):
            words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(120)]
            rows.append((len(rows), " ".join(words), lang))
        shuffled = [c for c in rows[-1][1] if c != " "]
        rng.shuffle(shuffled)
        joined = iter(shuffled)
        rows.append((1000 + len(rows), " ".join("".join(next(joined) for _ in w) for w in rows[-1][1].split()), lang))
    rows += [(3000 + k, " ".join("".join(rng.sample("xyzwvu", 4)) for _ in range(60)), "rare") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.assess(df).collect()}
    assert all(kept[k] for k in kept if k < 1000 or k >= 3000)
    assert [kept[k] for k in sorted(kept) if 1000 <= k < 3000] == [False] * 3
    left = quality.filter_documents(df.withColumn("kept", F.lit("mine")))
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k in kept if kept[k]) and left.columns == [*df.columns, "kept"]


def test_documents_under_another_language_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    moved = [r.doc_id for r in docs.where("lang = 'de'").orderBy("doc_id").limit(15).collect()]
    told = quality.assess(docs.withColumn("lang", F.when(F.col("doc_id").isin(moved), "en").otherwise(F.col("lang")))).collect()
    assert not any(r.kept for r in told if r.doc_id in moved)
    assert np.mean([r.kept for r in told if r.lang_group == "de" and not r.base_failed]) > 0.8
