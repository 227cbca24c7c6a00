"""The corpus pipeline: five operators of textloom.llm from raw documents to packed sequences."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.blocks import stored
from textloom.llm.jaccard import JaccardRule, jaccard_components
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.packing import pack_documents
from textloom.llm.pseudonyms import pseudonymise
from textloom.llm.quality import fit_quality, held_out, keep_quality
from textloom.llm.queries import END_ID, pseudonym_key
from textloom.operators.skew import join_ids


# Added by one stage and dropped again; no input column has this name.
REMOVED = "_lines_removed_by_line_dedup"


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorisation machine rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return keep_quality(docs, fit_quality(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines, and documents of which nothing but blanks is left."""
    lean = dedup_lines(docs, removed_col=REMOVED)
    emptied = (F.col(REMOVED) > 0) & ~F.col("text").rlike(r"\S")
    return _measured(lean.where(F.col("text").isNull() | ~emptied).drop(REMOVED))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group of near-duplicates."""
    groups = jaccard_components(docs, JaccardRule(words=5, percent=80), count_links=False)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return join_ids(docs, copies, "doc_id", "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by format-preserving pseudonyms."""
    return _measured(pseudonymise(docs, pseudonym_key(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of at most 4096."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("pii", pii), ("packing", packing),
]

# Scores, keyed pseudonyms and packing have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
