"""This subpackage's queries by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import lm_scoring, neighbours, packing, quality, sentencepiece, simhash, token_files, toxicity, url_filters, warc
from sketchloom.llm.common import id_remainder_column, table
from sketchloom.llm.oracles import ORACLE_SQL  # noqa: F401

#: Production rules of the URL filter.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.tokens_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder_column("doc_id", 5) == 0
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", toxicity.toxic().cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"), "page_id", "html", "url")
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: pages whose id has a row in `labels`; good is quality 1 and not toxic, in all such rows."""
    pages = table(spark, sf_dir, "pages")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.min(good).alias("good"))
    outcomes = pages.select("page_id", "url").join(labels, "page_id").select("url", "good")
    judged = url_filters.filter_urls(pages.select("page_id", "url"), outcomes, [url_filters.Rule.parse(x) for x in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict", F.coalesce("outcomes", F.lit(0)).alias("outcomes"), F.coalesce("good", F.lit(0)).alias("good"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op3_token_files": op3_token_files,
    "op2_packing": op2_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filters": op10_url_filters,
}
