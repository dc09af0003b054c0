"""A training corpus from the documents table, stage by stage.

Each stage takes the documents that the one before kept, written as Parquet and read again, and returns
documents; the last one returns what the mix takes of each.

Cases, for every stage: rows without an id are documents like any other, and so are rows with equal ids; a null text
counts as empty; texts of any length are judged whole; other columns, whatever their names, are handed on as they
are by all stages but the last; an empty table gives an empty table. What becomes of repeated rows and ties is said with each stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.llm import contamination, lines, mixing, rules, simhash
from itspark.sources import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules find good with the needed probability.

    Repeated rows get one verdict. Null and empty texts fail the base test and go.
    """
    return rules.score(docs).filter("_kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents share; a document keeps its row even if nothing is left.

    Repeated rows count as documents of their own and lose the same lines. A null text stays null.
    """
    cleaned = lines.apply_bitmaps(docs)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": n_chars}
    return cleaned.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of rows with equal ids and texts any one.

    Rows without an id stay only if no row of their group has one. Texts without words are one group.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark.

    Of rows with one id each is judged by its own text. Texts and items without words match nothing.
    """
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    found = contamination.contamination(docs, benchmark).filter("contaminated")
    bad = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), contamination.text_key().alias("_text"))
    return rows.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_anti").select("row.*")


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each document, repeated ones too.

    Documents without words are taken zero times; sources that are null are one source.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mixing_to_weights),
]

#: Expectation-maximisation and majority fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, function in STAGES:
        docs = stage.write_stage(function(spark, docs, sf_dir), stage.new_stage_path(spark, f"pipeline-{name}"))
    return docs
