"""The corpus pipeline: five operators of tessel.llm, each on all that the one before it kept.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
``documents`` but for the last stage. ``run`` applies them to ``documents``, writing each result as Parquet.

SQL can't express the stages (models, signatures, components, piece lattices): ORACLE_SQL is None and the tests hold
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import classifier, lines, mixing, near_dedup, pieces
from tessel.session import release, scratch, settle, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling takes; the labels give its target."""
    return classifier.select_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents of which nothing is left; n_chars follows the text."""
    out = lines.dedup_lines(docs, emptied="drop")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, checked by decoding them."""
    return pieces.encode_checked(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup_stage),
    ("source_mix", mix),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:  # what a stage has written goes once its result is written
            keep.append(docs := settle(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if hasattr(before, "settled_at"):
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
