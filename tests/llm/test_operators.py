"""The operators and their queries against brute force on small tables, and on tables of odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sketchloom.llm import catalog, components, lm_scoring, neighbours, packing, quality, sentencepiece, simhash, store, token_files, toxicity, url_filters, warc
from sketchloom.llm.common import shared_folder, table

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "Lorem ipsum dolor sit amet " * 4_000
#: Null ids, null and empty texts, repeated rows, ties, and columns whose names the operators use.
ODD = [(1, "a b c d e", "en", 5, 0.5), (1, "a b c d e", "en", 5, 0.5), (None, None, None, None, None), (None, "", "xx", 0, 0.1), (2, "", "de", 0, None), (3, None, "de", 1, 1.0), (4, "A b  c\nd e", "en", 2, 2.0), (5, LONG, "en", 3, 3.0), (6, LONG + "x", None, 4, 4.0), (7, "é中😀" * 10, "fr", 1, 1.0)]
ODD_SCHEMA = "doc_id long, text string, lang string, piece int, score double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# neighbours


def test_neighbours_query_against_brute_force(spark):
    rows = table(spark, SF, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = catalog.QUERIES["op1_nearest"](spark, SF).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = sorted((v, i) for v, i in zip(d, ids, strict=True) if i != q)[:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hits += len({i for _, i in best} & {r.vec_id for r in own})
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in own)
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, None), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [3.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("id", F.lit(1))
    found = neighbours.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 1), (0, 2), (0, 100), (0, 8), (100, 0), (100, 1), (100, 2), (100, 8)]
    assert [r.score for r in found[:4]] == [0.0, 0.0, 1.0, 2.0]
    assert neighbours.search(df.limit(0), df).count() == neighbours.search(df, df.limit(0)).count() == 0
    small = neighbours.search(df, df.where("vec_id % 100 = 0"), block_rows=2, query_rows=1).orderBy("query_id", "rank").collect()
    assert small == found  # blocks make no difference


# packing


def test_packing_query_against_brute_force(spark, docs):
    found = catalog.QUERIES["op2_packing"](spark, SF).collect()
    want = {}
    for (key, _), ids in zip(docs, encoded(WORD, [t or "" for _, t in docs]), strict=True):
        ids = [*ids, 0]
        for k in range(0, len(ids), 2048):
            want[key, k // 2048] = (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(placed)] == [0, *ends[:-1]]
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 2


def test_packing_of_odd_rows_and_sequences(spark, odd, none):
    packed = packing.pack(odd, WORD, keep_ids=True)
    rows = packed.collect()
    assert len(rows) > len(ODD) and sum(r.doc_id == 1 for r in rows) == 2 and sum(r.length == 1 for r in rows) == 4
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        ids = made[r.sequence_id].ids
        assert zlib.crc32(ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32 and len(ids) == 4 * made[r.sequence_id].length
    assert packing.pack(none, WORD).count() == 0


# token files


def test_token_files_query_against_brute_force(spark, docs):
    found = catalog.QUERIES["op3_token_files"](spark, SF).collect()
    at, want = 0, {}
    docs = sorted(docs)
    for (key, _), ids in zip(docs, encoded(BYTE, [t or "" for _, t in docs]), strict=True):
        ids = [*ids, 2]
        want[key] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want)


def test_token_files_of_odd_rows(spark, odd, none, monkeypatch):
    folder = shared_folder(spark)
    found = token_files.tokens_round_trip(odd, BYTE, keep_ids=True, folder=folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert sorted(zlib.crc32(r.ids) for r in found) == sorted(crc([*ids, 2]) for ids in encoded(BYTE, [r[1] or "" for r in ODD]))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert not store.listed(folder, ".draft") and store.listed(folder, ".tok")
    assert token_files.tokens_round_trip(none, BYTE).count() == 0
    files, _ = store.opened(folder)
    path = store.listed(folder, ".tok")[0][0]
    data = bytearray(store.get(files, path))
    data[len(data) // 2] ^= 4
    store.put(files, path, bytes(data))
    with pytest.raises(Exception, match="not a whole file"):
        token_files.read_tokens(spark, folder).collect()


def test_token_files_end_with_the_document_that_fills_them(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 100)
    texts = {k: "a " * (k * 7 % 60) for k in range(200)} | {77: "b " * 500}
    folder = shared_folder(spark)
    found = token_files.tokens_round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), BYTE, folder=folder)
    rows = sorted((r.shard, r.number, r.position, r.n_tokens) for r in found.collect())
    assert [n for *_, n in rows] == [len(ids) + 1 for ids in encoded(BYTE, [texts[k] for k in range(200)])]
    files = {}
    for shard, number, _, n in rows:
        files.setdefault((shard, number), []).append(n)
    last = {shard: number for shard, number in sorted(files)}
    assert len(files) > 20 and all(sum(f[:-1]) < 100 and (sum(f) >= 100 or last[at[0]] == at[1]) for at, f in files.items())


# sentencepiece


def test_sentencepiece_query_round_trips(spark, docs):
    found = {r.doc_id: r for r in catalog.QUERIES["op4_sentencepiece"](spark, SF).collect()}
    codec = sentencepiece.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(found) == len(docs) and all(r.round_trip for r in found.values())
    for key, text in docs[:5]:
        ids, score = codec.path((" " + text).replace(" ", sentencepiece.SPACE))
        assert (found[key].n_pieces, found[key].ids_crc32) == (len(ids), crc(ids)) and found[key].score == pytest.approx(score)


def test_sentencepiece_of_odd_rows(spark, odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece.encode(odd, model)
    assert "piece" in coded.columns and coded.count() == len(ODD) and all(r.round_trip for r in coded.collect())
    back = sentencepiece.decode(coded, model)
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in ODD)
    assert sentencepiece.encode(none, model).count() == 0


# toxicity


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op5_toxicity"](spark, sf)
    rows = found.join(table(spark, sf, "labels"), "doc_id").collect()
    assert found.count() == table(spark, sf, "documents").count()
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    ones, zeros = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    ahead = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert ahead > 0.7 and sum(s >= 0.5 for s in zeros) / len(zeros) < 0.05


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (5, 7), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.columns == ["doc_id", "text", "lang", "piece", "score"] and scored.count() == len(ODD)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(none, model).count() == 0
    alone = toxicity.train(odd, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score(odd, alone).collect()} == {1.0}
    assert {r.score for r in toxicity.score(odd, toxicity.train(none, labels.limit(0))).collect()} == {0.0}


# quality rules


def test_quality_of_odd_rows(spark, odd, none):
    told = quality.assess(odd).collect()
    assert len(told) == len(ODD) and sum(r.base_failed for r in told) == len(ODD)  # short, or repetitive
    assert quality.filter_documents(odd).count() == 0 and quality.filter_documents(odd).columns == odd.columns
    assert quality.assess(none).count() == 0 and quality.filter_documents(none).count() == 0


# simhash


def components_of(fps, radius):
    label = {k: k for k in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_query_against_brute_force(spark, docs):
    found = {r.doc_id: r for r in catalog.QUERIES["op7_simhash"](spark, SF).collect()}
    fps = {}
    for key, text in docs:
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps[key] = sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))
    want = components_of(fps, 2)
    assert {k: (r.fingerprint, r.component_id) for k, r in found.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


@pytest.mark.parametrize(("radius", "bucket_rows"), [(0, 20_000), (1, 20_000), (2, 20_000), (2, 8)])
def test_near_links_lose_nothing(spark, radius, bucket_rows):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(s) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for s in seeds for _ in range(4)]
    hot = [(1 << 62) + k for k in range(300)]  # agree in most bits
    every = sorted({*map(int, seeds), *near, *hot})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in every], "fp long"), radius, bucket_rows=bucket_rows).collect()
    label = {x: x for x in every}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        x, y = find(r.a), find(r.b)
        label[max(x, y)] = min(x, y)
    assert {x: find(x) for x in every} == components_of({x: x for x in every}, radius)


def test_simhash_of_odd_rows(spark, odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.fp == 0} == {2} and sum(r.fp == 0 for r in found) == 4
    assert {r.component_id for r in found if r.doc_id in (1, 4)} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7]
    unique = simhash.deduplicate(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert sorted(r.doc_id for r in unique.collect()) == [1, 2, 5, 7]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
    nulls = simhash.near_duplicates(odd.where("doc_id is null")).collect()
    assert [r.component_id for r in nulls] == [None, None]


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 150)]
    found = components.connected_components(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_after_more_links_are_those_of_all_links(spark):
    rng = np.random.default_rng(3)
    old, new = rng.integers(0, 300, (120, 2)).tolist(), rng.integers(0, 400, (60, 2)).tolist() + [[0, 0], [500, 501]]

    def framed(rows):
        return spark.createDataFrame(rows, "a long, b long")

    def as_dict(members):
        rows = members.collect()
        assert len({r.node for r in rows}) == len(rows)
        return {r.node: r.component for r in rows}

    members = components.connected_components(framed(old))
    found, want = as_dict(components.joined_components(members, framed(new))), as_dict(components.connected_components(framed(old + new)))
    assert {k: v for k, v in found.items() if k in want} == want and all(k == found[k] for k in found if k not in want)  # an end linked to itself only
    assert as_dict(components.joined_components(members, framed([]))) == as_dict(members)


# WARC


def archived(rows):
    by = {}
    for key, html in rows:
        by.setdefault(html or "", []).append(key)
    told = {}
    for key, html in rows:
        body, last = (html or "").encode(), max(by[html or ""])
        told[key] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if key == last else "revisit", None if key == last else last)
    return told


def test_warc_query_against_brute_force(spark):
    rows = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    found = catalog.QUERIES["op8_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == archived(rows) and len(found) == len(rows)


def test_warc_of_odd_rows_and_pushed_filters(spark):
    rows = [(1, "http://a/x", "same"), (2, None, "same"), (3, "http://b/\r\ny é", "other " * 9_000), (4, "u", None), (5, "v", ""), (6, "http://a/z", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("id", F.lit(2))
    folder = shared_folder(spark)
    found = warc.archive_round_trip(df, "page_id", "html", "url", folder=folder).cache()
    got = {int(r.record_id.rpartition(":")[2]): (r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to.rpartition(":")[2]) if r.refers_to else None) for r in found.collect()}
    assert got == archived([(k, h) for k, _, h in rows])
    assert {r.payload for r in found.where("record_type = 'response'").collect()} == {b"same", ("other " * 9_000).encode(), b""}
    read = warc.read_archive(spark, folder)
    for condition in ("record_type = 'revisit'", "record_type in ('response', 'x')", "target_uri like 'http://a%'", "payload_bytes > 4", "refers_to is not null", "not record_type = 'revisit'"):
        assert read.where(condition).count() == found.where(condition).count() > 0
    assert warc.read_archive(spark, folder, payload=False).where("payload is null").count() == len(rows)
    nothing = warc.archive_round_trip(df.limit(0), "page_id", "html", "url")
    assert nothing.count() == 0
    apart = warc.archive_round_trip(df, "page_id", "html", min_bytes=5)
    assert apart.where("record_type = 'revisit'").count() == 0
    repeated = warc.archive_round_trip(df.union(df).union(df.withColumn("page_id", F.lit(None).cast("long"))), "page_id", "html")
    assert repeated.count() == 18 and repeated.where("record_type = 'response'").count() == 6


def test_warc_pushes_what_it_can():
    from pyspark.sql.datasource import EqualTo, Not, StringContains

    reader = warc.WarcReader({"path": "/nowhere"})
    own, far = [EqualTo(("record_type",), "response"), Not(StringContains(("target_uri",), "x"))], EqualTo(("payload",), b"x")
    assert list(reader.pushFilters([*own, far])) == [far] and reader.filters == own
    assert len(reader.partitions()) == 1 and not reader.partitions()[0].files


# language model


def test_lm_query_against_brute_force(spark, docs):
    found = {r.doc_id: r for r in catalog.QUERIES["op9_lm_scoring"](spark, SF).collect()}
    texts = {k: [*words(t), ""] for k, t in docs}
    c = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in texts.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_of_odd_rows(spark, odd, none):
    rows = lm_scoring.score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    assert sum(r.n_tokens == 1 for r in rows) == 4
    assert lm_scoring.score(none).count() == 0
    held = lm_scoring.score(odd.where("doc_id is null")).collect()  # crc32 of empty text is 0: nothing to learn from
    assert [(r.held_out, r.train_tokens, r.base_score) for r in held] == [(True, 0, 0.0)] * 2


# URL filters


def test_url_rules_and_parts(spark):
    rules = [url_filters.Rule.parse(x) for x in catalog.URL_RULES]
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://b.example.org/en/2", "http://x.com/fr/", "http://com/de/1", "http://xcom/de/1", "http://org", "http://u://v/w?x", "ftp://h?/p", "http://h#/p", "http://Ä.org/A?"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = url_filters.filter_urls(df, spark.createDataFrame([], "url string, good int"), rules).orderBy("page_id").collect()
    for r, url in zip(found, urls, strict=True):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.text, best.verdict if best else "allow")
    with pytest.raises(ValueError):
        url_filters.Rule.parse("deny x/")


def test_reputation_shrinks_towards_domain_and_blocks_the_surely_bad(spark):
    rows = [(f"http://bad{k}.evil.net/{i}", 0) for k in range(3) for i in range(40)] + [(f"http://h{k}.fine.net/{i}", 1) for k in range(5) for i in range(40)] + [("http://one.fine.net/", 0), ("http://one.evil.net/", 1), ("http://10.0.0.1/a", 1), (None, 1), ("http://x.co.uk/", None)]
    outcomes = spark.createDataFrame(rows, "url string, good int")
    found = {r.host: r for r in url_filters.host_reputation(outcomes.select(url_filters.host_of(F.col("url")).alias("host"), "good")).collect()}
    assert found["bad0.evil.net"].mean < 0.1 and found["h0.fine.net"].mean > 0.9
    assert 0 < found["one.fine.net"].mean < 1 and found["one.fine.net"].mean > found["one.evil.net"].mean - 0.5
    assert all(r.lower <= r.mean <= r.upper for r in found.values()) and "x.co.uk" not in found
    judged = {r.url: r.verdict for r in url_filters.filter_urls(outcomes.select("url").distinct(), outcomes, []).collect()}
    assert judged["http://bad0.evil.net/0"] == "block" and judged["http://h0.fine.net/0"] == "allow" and judged["http://x.co.uk/"] == "allow"
    r = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("10.0.0.1",), ("",)], "h string").select(url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h"))).collect()
    assert [tuple(x) for x in r] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("10.0.0.1", ""), ("", "")]


def test_hosts_without_outcomes_have_the_prior_of_their_domain_or_suffix(spark):
    rows = [(f"http://bad{k}.evil.net/{i}", 0) for k in range(9) for i in range(40)] + [(f"http://h{k}.fine.net/{i}", 1) for k in range(9) for i in range(40)] + [(f"http://w{k}.d{k}.zip/{i}", 0) for k in range(9) for i in range(40)] + [(f"http://w{k}.d{k}.org/{i}", 1) for k in range(9) for i in range(40)]
    pages = spark.createDataFrame([("http://fresh.evil.net/",), ("http://fresh.fine.net/",), ("http://a.fresh.zip/",), ("http://a.fresh.org/",), ("http://a.fresh.xyz/",), ("http://a.fresh.xyz/",)], "url string")
    found = url_filters.filter_urls(pages, spark.createDataFrame(rows, "url string, good int"), []).collect()
    assert {r.host: r.verdict for r in found} == {"fresh.evil.net": "block", "fresh.fine.net": "allow", "a.fresh.zip": "block", "a.fresh.org": "allow", "a.fresh.xyz": "allow"}
    assert len(found) == 6 and all(r.outcomes == 0 and r.good == 0 and r.lower <= r.mean <= r.upper for r in found)
    assert {r.host: r.mean for r in found}["a.fresh.xyz"] == pytest.approx(0.5)


def test_url_query_is_native(spark):
    df = catalog.QUERIES["op10_url_filters"](spark, SF)
    assert df.count() == table(spark, SF, "pages").count()
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


# the pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "packing"]
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, sf).cache()
        if k < 3:
            assert out.columns == docs.columns and out.count() == out.select("doc_id").distinct().count() and out.exceptAll(left).count() == 0
        if k == 3:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in left.select("doc_id").collect()}
        left = out


def test_toxicity_learns_its_lexicon_from_all_labels(spark):
    letters = "bcdfghjklmnpqrst"
    rare = [f"x{a}{b}z" for a in letters for b in letters][:210]
    rows = [(k, f"{rare[k % 210]} said the cat", 1) for k in range(420)] + [(420 + k, "thus said the cat", 0) for k in range(420)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), trees=5)
    assert set(rare) <= set(model.lexicon)
