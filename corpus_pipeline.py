"""The corpus pipeline: documents through toxicity, quality rules, near-duplicates and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import near_copies, packing, quality, toxicity
from sketchloom.llm.common import free_name, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled documents among them.

    A null text is empty. Each row is judged for itself, so that repeated rows stay or go
    together; null ids have no label but are scored. No documents give none.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, out=score).where(~toxicity.toxic(score)).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the perplexity bands reject.

    Null and empty texts fail the base rules. Null languages are read by the model of the small
    ones. Repeated rows stay or go together. No documents give none.
    """
    return quality.filter_documents(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of links of Jaccard similarity 0.8 or more on five-word shingles.

    Candidates are found by SimHash fingerprints of those shingles and compared exactly; what
    fingerprints miss at this similarity is found by prefixes (near_copies; README has the
    figures why both). Texts without words are copies of each other; null ids come after others, and of rows that are alike one stays.
    No documents give none.
    """
    return near_copies.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 2,048 tokens.

    A null text is empty; repeated rows and null ids are packed each. No documents give no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of the four; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
