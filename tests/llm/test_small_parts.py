"""The operators' own parts against brute force, without Spark."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as spm
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sketchloom.llm import boosting, lm_scoring, neighbours, packing, quality, sentencepiece, simhash, token_files, tokens, toxicity, warc

TEXTS = st.text(st.sampled_from("aA bé\n\t.,!'1?中 \x1c\xa0 ß😀#|"), max_size=60)
WORDS = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=WORDS)
def encoder(request):
    return tokens.encoder(public_tokenizers.path(request.param))


def test_partings_are_known():
    assert [tokens.encoder(public_tokenizers.path(w)).parting for w in WORDS] == ["words", "spaced"]


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
@pytest.mark.parametrize("name", WORDS)
def test_chunks_give_the_tokenizers_ids(name, text):
    own = tokens.encoder(public_tokenizers.path(name))
    assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_hard_texts(encoder):
    plain = Tokenizer.from_file(public_tokenizers.path(WORDS[0] if encoder.parting == "words" else WORDS[1]))
    plain.encode_special_tokens = True
    for text in ("", " ", "it's  'S Ǆ é é́x <|endoftext|>", "x " * 3000 + "y" * 5000, "İstanbul ΑΣ", "a\x1cb c", "x\xa0\n y", "Straße,Ärger;«été».", "hello   ", "\r\n\r\na"):
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS | st.text(max_size=8), max_size=9), together=st.sampled_from([1, 30, 1 << 20]), skip=st.integers(0, 2))
@pytest.mark.parametrize("name", WORDS)
def test_many_texts_together_give_the_tokenizers_ids(name, texts, together, skip):
    own = tokens.encoder(public_tokenizers.path(name))
    own.clear()
    own.spaced.clear()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "TOGETHER", together)
        for _ in range(2):  # new parts, then known ones
            found = list(own.arrays(pa.array(texts, pa.string()).slice(skip)))
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[skip:]]
    assert [n for _, lengths in found for n in lengths.tolist()] == [len(x) for x in want]
    assert [x for ids, _ in found for x in ids.tolist()] == [x for w in want for x in w]


def test_words_are_learnt_without_the_marks_around_them(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 400)
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{a}{b}é" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq"]
    texts = ["\n".join(f"{w}{m} {w} {m}{w}" for w in words) for m in (".", ",", "!", "?", ";", ":", "...", "--")]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert len(own.spaced.numbers) == 2 * len(words) + 2 * 8 + 1  # words with a space before them and without, marks likewise, the line break
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts[:1])] == want[:1]
    assert len(own.spaced.numbers) == 2 * len(words) + 2 + 1  # begun anew, as there were too many


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(b, k) for k, b in enumerate(bins) if b >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plans_are_best_fit_decreasing(case):
    capacity, lengths = case
    counts = Counter(lengths)
    plan = packing.plan(counts, capacity)
    assert plan.bins == best_fit(lengths, capacity)
    bins = {}
    for n, many in counts.items():
        for b, o in zip(*plan.place(np.full(many, n), np.arange(many)), strict=True):
            bins.setdefault(int(b), []).append((int(o), n))
    assert len(bins) == plan.bins
    for placed in bins.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= capacity


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_fingerprints(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_of_null_and_very_long(monkeypatch):
    assert simhash.fingerprint(None) == 0
    text = " ".join(random.Random(1).choices("abcdefgh", k=3_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("pairwise", [1, 256])
def test_links_join_what_is_near(radius, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(radius)
    own = np.unique(rng.integers(0, 1 << 9, 150, dtype=np.uint64))
    a, b = simhash.linked(np.zeros(len(own), np.int64), own, radius, (1 << 64) - 1)
    label = dict(zip(own.tolist(), own.tolist(), strict=True))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[max(find(x), find(y))] = min(find(x), find(y))
    got = [find(x) for x in own.tolist()]
    label = dict(zip(own.tolist(), own.tolist(), strict=True))
    for i, x in enumerate(own.tolist()):
        for y in own.tolist()[:i]:
            if bin(x ^ y).count("1") <= radius:
                p, q = find(x), find(y)
                label[max(p, q)] = min(p, q)
    assert got == [find(x) for x in own.tolist()]


def test_thresholds_take_the_cheapest_allocation():
    costs = [{-1: 0, 0: 10, 1: 90, 2: 500}, {-1: 0, 0: 1000, 1: 5000, 2: 9000}, {-1: 0, 0: 10, 1: 20, 2: 500}]
    assert simhash.allocated(costs, 0) == [0, -1, 1]
    groups = simhash.grouped_bits(0, np.zeros((64, 64)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}
    for mask in (0, simhash.mask_of([0, 5, 63])):
        parts = simhash.split_masks(mask, 2)
        assert all(p & mask == mask for p in parts)
        assert (parts[0] & ~mask) | (parts[1] & ~mask) | (parts[2] & ~mask) == (1 << 64) - 1 & ~mask


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=300), max_size=8), st.integers(1, 3))
def test_token_files_come_back(docs, scale):
    ids = np.array([x for d in docs for x in d], np.uint32)
    counts = np.bincount(ids, minlength=1) * scale
    table = token_files.Table.of(token_files.Table(token_files.scaled(counts)).image())
    keys = [None if k == 1 else k - 2 for k in range(len(docs))]
    lengths = np.array([len(d) for d in docs], np.int64)
    image = token_files.file_image(3, 4, keys, lengths, ids, table)
    shard, number, found, sizes, back = token_files.read_image(image, table)
    assert (shard, number, found, sizes.tolist(), back.tolist()) == (3, 4, keys, lengths.tolist(), ids.tolist())
    assert token_files._of_draft(token_files._draft(keys, lengths, ids))[2].tolist() == ids.tolist()


def test_token_files_in_blocks_and_spoilt(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1 << 10)
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 5_000), 50_000).astype(np.uint32)
    table = token_files.Table(token_files.scaled(np.bincount(ids)))
    image = token_files.file_image(0, 0, [7], np.array([len(ids)]), ids, table)
    assert (token_files.read_image(image, table)[4] == ids).all()
    assert (token_files.read_image(image, table, range(2, 4))[4] == ids[2048:4096]).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(image) < entropy * 1.05 + 5 * (64 * 8 + 12) + 200
    for at in rng.integers(0, len(image), 200):
        with pytest.raises(token_files.Corrupt):
            token_files.read_image(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :], table)
    with pytest.raises(ValueError):
        token_files.file_image(0, 0, [1], np.array([1]), np.array([60_000], np.uint32), table)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece.codec(public_tokenizers.path("piece_bpe_32k.model"))


def best_path(codec, text):
    """Plain dynamic programming over a dictionary of pieces."""
    pieces = {codec.pieces[k]: (k, s) for k, s in codec.scores.items()}
    best = [(0.0, [])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        ways = []
        for s in range(max(0, e - 16), e):
            if text[s:e] in pieces:
                ways.append((best[s][0] + pieces[text[s:e]][1], best[s][1] + [pieces[text[s:e]][0]]))
            elif e == s + 1:
                ways.append((best[s][0] + codec.lowest, best[s][1] + [codec.byte[b] for b in text[s:e].encode()]))
        best[e] = max(ways, key=lambda w: w[0])
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("the aniong.é\n 中😀 "), max_size=40))
def test_paths_are_best_and_come_back(codec, text):
    ids, score = codec.encode(text)
    found = np.frombuffer(ids, "<u4").tolist()
    assert codec.decode(found) == text
    if text:
        want = best_path(codec, (" " + text).replace(" ", sentencepiece.SPACE))
        assert score == pytest.approx(want[0])
        whole, whole_score = codec.path((" " + text).replace(" ", sentencepiece.SPACE))
        assert whole_score == pytest.approx(score)


def test_paths_are_the_librarys_for_a_unigram_model(codec):
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    unigram = spm.SentencePieceProcessor(model_proto=raw.replace(b"\x06tok_v0\x18\x02", b"\x06tok_v0\x18\x01"))
    for text in ("the cat sat on the mat", "retitioning", "of then and other", "Straße über alles"):
        best = max(sum(codec.scores.get(k, codec.lowest) for k in ids) for ids in unigram.nbest_encode_as_ids(text, 5))
        assert codec.encode(text)[1] == pytest.approx(best)


def test_new_parts_are_encoded_together_and_as_one_by_one(monkeypatch):
    own = sentencepiece.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(["the", "an", "ión", "wh", "é", "x", ".\n", "q", "7", "%%"], rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(20)] + ["", " ", "  a", "a ", "\n", "a  b " * 3, "y" * 62, "one 𐀀two", "z" * 63 + " end"]
    want = [own.path((" " + x).replace(" ", sentencepiece.SPACE)) if x else ([], 0.0) for x in texts]
    calls = []
    path = own.path
    monkeypatch.setattr(own, "path", lambda x: calls.append(x) or path(x))
    assert [own.encode(x) for x in texts] == [(np.array(ids, "<u4").tobytes(), score) for ids, score in want]
    assert sorted(calls) == ["▁" + "z" * 63, "▁𐀀two"]  # a long part, and a character of several bytes without a piece; before, every new part
    assert "z" * 63 not in own.memo and "𐀀two" in own.memo
    own.memo.clear()
    own.table.fits = False  # as for a model that is too large
    assert [own.encode(x) for x in texts] == [(np.array(ids, "<u4").tobytes(), score) for ids, score in want]


def test_bytes_that_are_no_text_decode_to_replacements(codec):
    assert codec.decode([codec.byte[0xFF], codec.byte[0x41]]) == "�A" and codec.decode([]) == ""


def test_trees_and_calibration_learn():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:2_000], y[:2_000])
    p = boosting.isotonic(model(x[:2_000]), y[:2_000], np.ones(2_000))(model(x[2_000:]))
    assert ((p >= 0.5) == y[2_000:]).mean() > 0.95
    curve = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert curve(np.array([0, 2, 2.5, 3, 9])).tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_toxic_features():
    extract = toxicity.Extractor({"idiot": 3.0, "lowei*": 2.0})
    at = dict(zip(toxicity.NAMES, extract("You utter IDIOT! loweichen"), strict=True))
    assert at["hits"] == 2 and at["lexicon"] == 0.5 and at["near"] == 1.0 and at["second_person"] == 0.25 and at["shouted"] == 0.25
    assert dict(zip(toxicity.NAMES, extract("1d10t here"), strict=True))["disguised_hits"] == 1
    assert len(extract(None)) == len(extract("")) == len(extract("x" * 100_000)) == len(toxicity.NAMES)


@pytest.mark.parametrize("joint", [",", "\xa0", "\u3000", "\u2028", "_", "-"])
def test_toxic_features_of_words_joined_otherwise(joint):
    extract = toxicity.Extractor({"idiot": 3.0, "lowei*": 2.0})
    words = "you utter idiot what a lovely 1d10t loweichen".split() * 200
    at, spaced = (dict(zip(toxicity.NAMES, extract(j.join(words)), strict=True)) for j in (joint, " "))
    assert spaced["hits"] == 600 and spaced["disguised_hits"] == 200
    for name in ("log_words", "lexicon", "strong", "weight", "hits", "disguised_hits", "second_person", "near", "digits"):
        assert at[name] == spaced[name]


def word_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            twice += line in seen
            seen.add(line)
    often = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), twice, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é中"), max_size=80))
def test_word_statistics(text):
    assert quality.statistics(text) == word_statistics(text)
    assert quality.statistics(None) == (0, 0, 0, 0, 0)


def test_classes_part_the_words():
    counts = np.array([1000, 400, 400, 50, 50, 7, 1, 1, 1, 1])
    bins = lm_scoring.count_bins(counts)
    leaf = np.arange(len(counts)) * 37 % lm_scoring.LEAVES
    sums = {(int(b), int(x)): (int(((bins == b) & (leaf == x)).sum()), int(counts[(bins == b) & (leaf == x)].sum())) for b, x in zip(bins, leaf, strict=True)} | {(-1, 0): (1, 100)}
    cut = lm_scoring.Classes.cut(sums, 5).told()
    assert cut.tokens == counts.sum() + 100 and cut.kinds == 11 and len(cut) <= 5
    own = cut.of(np.append(counts, 0))
    assert own.min() >= 1 and own[-1] == len(cut) - 1 and list(own[:-1]) == sorted(own[:-1])
    assert own[-2] == own[-1] and cut.mass.sum() == cut.tokens and cut.size[1:].sum() == len(counts)
    assert lm_scoring.Classes.cut({}, 4).told().tokens == 0


def test_search_in_a_block_finds_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    x[10] = x[11]
    index = neighbours.Index(np.arange(500), x)
    ratio = neighbours.width_for(0.99, neighbours.PROJECTIONS, neighbours.PROJECTIONS // 2)
    hits = 0
    asked = np.arange(0, 500, 20)
    for q, (rows, d, _) in zip(asked, index.search(x[asked], asked, 10, neighbours.PROJECTIONS // 2, ratio), strict=True):
        exact = np.sqrt(((x - x[q]) ** 2).sum(1))
        exact[q] = np.inf
        best = np.lexsort((np.arange(500), exact))[:10]
        hits += len(set(best) & set(rows))
        assert np.allclose(d, exact[rows]) and len(rows) == 10
    assert hits / 250 >= 0.95
    one = neighbours.Index(np.arange(2), np.ones((2, 3)))
    assert next(one.search(np.ones((1, 3)), np.array([0]), 10, 24, ratio))[0].tolist() == [1]


def test_warc_records_in_gzip_members():
    row = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "http://a/\n b", "date": "2024-01-01T00:00:00Z", "payload_digest": warc.digest(b"hi\r\n\r\nthere"), "payload_bytes": 11, "refers_to": None, "payload": b"hi\r\n\r\nthere"}
    data = warc.record(row)
    packed = warc.member(data, 3)
    assert zlib.decompress(packed, 31) == data and warc._member_length(packed) == len(packed)
    assert b"WARC-Target-URI: http://a/%0A b\r\n" in data
    assert struct.unpack("<I", packed[-4:])[0] == len(data)
    import io

    for image in (packed * 3, data * 3):
        rows = list(warc.scan(io.BytesIO(image), len(image), "f", lambda r: True, True, True))
        assert [r["payload"] for r in rows] == [b"hi\r\n\r\nthere"] * 3 and rows[1]["offset"] == len(image) // 3
        assert [r["payload"] for r in warc.scan(io.BytesIO(image), len(image), "f", lambda r: True, False, True)] == [None] * 3
        assert not list(warc.scan(io.BytesIO(image), len(image), "f", lambda r: False, True, True))
    with pytest.raises(ValueError, match="isn't what its header says"):
        bad = data.replace(b"there", b"thera")
        list(warc.scan(io.BytesIO(bad), len(bad), "f", lambda r: True, True, True))
