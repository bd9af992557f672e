"""What operators must not lose: appended archives, repeated rows, words of long runs, hosts with ports; and the stages on odd rows."""

import base64
import hashlib
import io
import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sketchloom.llm import catalog, components, packing, store, toxicity, url_filters, warc
from sketchloom.llm.common import join_spread, shared_folder, table, written

SF = "/root/testdata/sf0.001"


def test_a_second_append_keeps_the_first_archive(spark):
    folder = shared_folder(spark)
    for base in (0, 100):
        warc.archive(spark.range(base, base + 10).selectExpr("id page_id", "concat('p', id) html"), folder, "page_id", "html")
    assert warc.read_archive(spark, folder).count() == 20 and not store.listed(folder, ".draft")


def test_of_two_attempts_of_a_task_one_is_published(tmp_path, monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(warc, "TaskContext", Task)
    rows = [{"record_id": f"urn:{k}", "record_type": "response", "target_uri": None, "date": "2024-01-01T00:00:00Z", "payload_digest": hashlib.sha1(b"x" * k).hexdigest(), "payload_bytes": k, "refers_to": None, "payload": b"x" * k} for k in range(40)]
    writer = warc.WarcWriter({"path": str(tmp_path), "file_bytes": "2000"})
    writer.write(iter([pa.RecordBatch.from_pylist(rows)]))
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows[::-1])]))])
    reader = warc.WarcReader({"path": str(tmp_path)})
    found = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in found) == sorted(r["record_id"] for r in rows) and not store.listed(str(tmp_path), ".draft")
    other = warc.WarcWriter({"path": str(tmp_path)})
    other.abort([other.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    assert not store.listed(str(tmp_path), ".draft") and sum(len(list(reader.read(p))) for p in reader.partitions()) > 0


@pytest.mark.parametrize("told", ["md5:" + hashlib.md5(b"body").hexdigest(), "sha256:" + hashlib.sha256(b"body").hexdigest(), "SHA-1:" + hashlib.sha1(b"body").hexdigest().upper(), "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode(), "blake9:zz"])
def test_digests_are_verified_by_their_algorithm(told):
    def scanned(body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        data = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: {told}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        return list(warc.scan(io.BytesIO(data), len(data), "f", lambda row: True, True, True))

    assert [r["payload"] for r in scanned(b"body")] == [b"body"]
    if "blake9" not in told:
        with pytest.raises(ValueError):
            scanned(b"else")


def test_rows_alike_are_ranked_in_many_groups(spark):
    cut = written(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"), F.lit(5).alias("ids_crc32")).repartition(4))
    salted = packing.with_salts(cut.withColumn("__row", F.monotonically_increasing_id()), {1: 20_000}).groupBy("__salt").count().collect()
    assert len(salted) == 20 and max(r["count"] for r in salted) < 2_000
    placed = packing.place(cut).select("sequence_id", "offset")
    assert placed.distinct().count() == 20_000 and placed.select("sequence_id").distinct().count() == 10


def test_hot_keys_are_joined_in_many_tasks(spark):
    rows = spark.range(50_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 40_000))
    few = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    joined = join_spread(rows, few, "k")
    assert joined.columns == ["k", "id", "least"] and joined.count() == 50_000
    assert joined.exceptAll(rows.join(few.drop("n"), "k")).count() == 0
    assert join_spread(rows, few.where("k >= 0"), "k", "left").where("least is null").count() == rows.where("k = -1").count()
    assert join_spread(rows.limit(0), few, "k").count() == join_spread(rows, few.limit(0), "k").count() == 0


def test_a_star_of_many_links(spark):
    links = spark.range(1, 30_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = components.connected_components(links)
    assert found.count() == 30_000 and found.where("component != 0").count() == 0


def test_hosts_share_their_names_reputation(spark):
    hosts = ["a.example.com:8080", "user:pw@a.example.com", "a.example.com.", "1.2.3.4:80", "[::1]:80", "example.com.", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(url_filters.name_of(F.col("h")).alias("h"))
    found = [tuple(r) for r in df.select("h", url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h"))).collect()]
    assert found == [("a.example.com", "example.com", "com")] * 3 + [("1.2.3.4", "1.2.3.4", ""), ("[::1]", "[::1]", ""), ("example.com", "example.com", "com"), ("", "", "")]
    bad = [(f"http://a.evil.net:{80 + k % 3}/{k}", 0) for k in range(60)] + [(f"http://b{k}.fine.org/", 1) for k in range(60)]
    pages = spark.createDataFrame([("http://u@a.evil.net./x",), ("http://a.evil.net/" + "x" * 100_000,), ("http://b1.fine.org:1/",), (None,)], "url string")
    outcomes = spark.createDataFrame(bad, "url string, good int")
    judged = {r.host: r.verdict for r in url_filters.filter_urls(pages, outcomes, []).collect()}
    assert judged == {"u@a.evil.net.": "block", "a.evil.net": "block", "b1.fine.org:1": "allow", "": "allow"}
    assert url_filters.filter_urls(pages.limit(0), outcomes, []).count() == 0
    endings = spark.createDataFrame([("co.kr",), ("kr",), ("a.b.c",)], "suffix string")
    told = url_filters.with_domains(spark.createDataFrame([("x.shop.co.kr",), ("co.kr",), ("y.z.a.b.c",), ("q.zz",), ("1.2.3.4",)], "host string"), endings)
    assert {r.host: (r.domain, r.suffix) for r in told.collect()} == {"x.shop.co.kr": ("shop.co.kr", "co.kr"), "co.kr": ("co.kr", "co.kr"), "y.z.a.b.c": ("z.a.b.c", "a.b.c"), "q.zz": ("q.zz", "zz"), "1.2.3.4": ("1.2.3.4", "")}


def plain_features(text, lexicon):
    """The features of a text of plain words, one at a time."""
    units = [w for chunk in re.findall(r"[^\x20\x09-\x0d]+", text) for w in [chunk]]
    strong, weights = max(lexicon.values(), default=0) * 0.6, []
    second, hits = [], []
    for at, unit in enumerate(units):
        word = re.sub(r"[^a-z]", "", unit.lower())
        forms = [word, *(f"{word[:n]}*" for n in (4, 5, 6, 7) if len(word) > n)]
        found = [lexicon[f] for f in forms if f in lexicon]
        if found:
            hits.append(at)
            weights.append(max(found))
        if word in toxicity.SECOND_PERSON:
            second.append(at)
    n = max(1, len(units))
    share = lambda test: sum(map(test, units)) / n
    entry = lambda unit: (lambda w: max((f for f in [w, *(f"{w[:k]}*" for k in (4, 5, 6, 7) if len(w) > k)] if f in lexicon), key=lambda f: lexicon[f]))(re.sub(r"[^a-z]", "", unit.lower()))
    near = sum(any(abs(h - s) <= 5 for s in second) for h in hits) / len(hits) if hits and second else 0.0
    return {"log_words": math.log1p(len(units)), "lexicon": len(hits) / n, "strong": sum(w >= strong for w in weights) / n, "weight": sum(weights) / n, "distinct": len({entry(units[h]) for h in hits}), "hits": len(hits),
            "second_person": len(second) / n, "near": near, "capitals": share(lambda u: u[0].isupper()), "shouted": share(lambda u: u.isupper() and sum(c.isalpha() for c in u) > 1),
            "exclamations": share(lambda u: "!" in u), "punctuation": share(lambda u: not u.isalnum()), "letters": len(text) / n}


def test_features_against_plain_ones():
    rng = np.random.default_rng(2)
    words = ["idiot", "idiotic", "moron", "You", "your", "cat", "HOUSE", "tree", "Sing", "nice", "stupid", "STUPID"]
    lexicon = {"idiot": 4.0, "idio*": 2.0, "moron": 3.0, "stupid": 1.5}
    extract = toxicity.Extractor(lexicon)
    for n in (0, 1, 7, 300, 40_000):
        text = " ".join(w + ("!" if rng.random() < 0.1 else "," if rng.random() < 0.1 else "") for w in rng.choice(words, n))
        found = dict(zip(toxicity.NAMES, extract(text), strict=True))
        assert {k: found[k] for k in plain_features(text, lexicon)} == pytest.approx(plain_features(text, lexicon))


@pytest.mark.parametrize("joint", [" ", "\u00a0", "\u3000", "-", "_", ","])
def test_words_count_whatever_joins_them(joint):
    words = ["moron" if k % 10 == 0 else "cat" if k % 3 else "you" for k in range(20_000)]
    extract = toxicity.Extractor({"moron": 3.0})
    found, apart = (dict(zip(toxicity.NAMES, extract(j.join(words)), strict=True)) for j in (joint, " "))
    for name in ("hits", "lexicon", "second_person", "near", "log_words"):
        assert found[name] == pytest.approx(apart[name], rel=0.01), name
    long = "x" * 50 + "moron" * 30
    assert long in toxicity.text_entries(f"a {long} b") and toxicity.Extractor({long: 2.0})(long)[5] == 1


def test_query_scores_are_those_of_the_model_on_its_features(spark):
    """The whole of op5 once more: a model of the labels not held out, trees and calibration walked one document at a time."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    learned = labels.where(F.udf(lambda x: zlib.crc32(str(x).encode()) % 5 != 0, "boolean")("doc_id")).select("doc_id", "toxic")
    model = toxicity.train(docs, learned)
    extract, found = toxicity.Extractor(model.lexicon), {r.doc_id: r for r in catalog.QUERIES["op5_toxicity"](spark, sf).collect()}

    def walked(x):
        odds = model.trees.base
        for tree in model.trees.trees:
            node = 0
            for _ in range(tree.depth):
                node = 2 * node + (2 if x[tree.feature[node]] > tree.split[node] else 1)
            odds += model.trees.rate * tree.value[node]
        return float(np.interp(odds, model.calibration.x, model.calibration.y))

    for r in docs.collect():
        score = walked(extract(r.text))
        assert found[r.doc_id].score == pytest.approx(min(1, max(0, score)), abs=1e-9) and found[r.doc_id].predicted == int(found[r.doc_id].score >= 0.5)


def test_an_id_that_repeats_is_learned_once(spark):
    letters = string.ascii_lowercase
    rows = [(k, f"{letters[k % 26] * 5} said the cat", k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    many = df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    one, other = (toxicity.train(x, df.select("doc_id", "toxic"), trees=5) for x in (df, many))
    assert one.lexicon == other.lexicon and one.trees.base == other.trees.base


def test_stages_on_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(90))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " x", "en", None, None), (2, None, None, None, None), (3, "", "de", "b", 0), (4, "short", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__toxicity", F.lit(1)).withColumn("__fp", F.lit("x"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    left = [stages[k](spark, docs, SF) for k in range(3)]
    assert [x.columns for x in left] == [docs.columns] * 3
    assert left[0].count() == len(rows)
    assert sorted((r.doc_id or 0) for r in left[1].collect()) == [0, 1, 1]
    assert sorted((r.doc_id or 0) for r in left[2].collect()) == [1, 2, 4]
    assert stages[3](spark, docs, SF).count() == len(rows)
    assert [f(spark, docs.limit(0), SF).count() for f in stages] == [0, 0, 0, 0]
