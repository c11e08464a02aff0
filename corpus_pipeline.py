"""A training corpus from raw documents in five stages, each written as Parquet and read by the next.

``run`` applies the stages to the table documents; the last one returns the packed sequences' pieces.
SQL can't express the learned and the packing stages, so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` holds every stage against brute force on its own input (the learned one against its model's
predictions), and checks that planted documents are dropped and the others stay.

Defined results: a null or empty text fails the quality rules and goes; a null label isn't learned from, and without labels no document is
toxic; rows without doc_id go through like others and are judged by their texts; repeated rows are one group of copies, of which one stays; an empty
table of documents gives no sequences, an empty benchmark drops nothing; all columns of documents, extra ones too, are handed on to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from burrow.llm import decontam, jaccard, packing, quality, toxicity
from burrow.llm.textual import scratch

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are depleted of lines of their own, and takes their hosts' boilerplate lines out of the others."""
    return quality.reject_low_quality(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a model of the labelled ones among those it gets."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.keep_one(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontam.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
