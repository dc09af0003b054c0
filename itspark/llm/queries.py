"""The operators over whole driver tables: one query each, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.llm import audit, chat, contamination, lines, mixing, packing, rules, simhash, spelling, sql, suffixes, tokens, warc, windows
from itspark.llm.common import table_path
from itspark.sources import stage


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(table_path(sf_dir, t)) for t in ("documents", "benchmark"))
    found = contamination.contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), stage.new_stage_path(spark, "token-cache"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return simhash.groups(docs).select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return suffixes.remove_repeated_bytes(docs).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.repair(spark.read.parquet(table_path(sf_dir, "conversations")))
    inserted = [F.array_join(F.col(c), ",").alias(c) for c in ("inserted_before", "inserted_after")]
    return turns.select("conv_id", "turn", "role", "new_role", "merged", *inserted, "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    return lines.apply_bitmaps(docs, body=False).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return windows.remove_repeated_windows(docs).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages become legacy archives, half of them of either version; these are converted and read back."""
    pages = spark.read.parquet(table_path(sf_dir, "pages"))
    folder = stage.new_stage_path(spark, "archives")
    parts = {1: F.xxhash64("page_id") % 2 == 0, 2: F.xxhash64("page_id") % 2 != 0}
    for version, own in parts.items():
        warc.to_arc(pages.filter(own), f"{folder}/arc{version}", version)
    warc.convert(spark, [f"{folder}/arc{v}" for v in parts], f"{folder}/warc")
    read = warc.read_warc(spark, f"{folder}/warc", body=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    scored = rules.score(docs, body=False)
    return scored.select(
        "row.doc_id", *[F.col(f"_{c}").alias(c) for c in rules.STATS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        F.round("_posterior", 6).alias("posterior"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return audit.audit(docs).select("lang", "source", "part", "item", "value", "rank")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return spelling.variants(docs, drop=spelling.DROP).select("word", "form", "root", "n", "n_near", "form_n")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    operators = (
        op1_mix, op2_decontaminate, op3_tokens, op4_simhash, op5_suffixes, op6_chat, op7_lines, op8_windows, op9_warc, op10_quality,
        op11_audit, op12_packing, op13_spelling,
    )
    return {**{f.__name__: f for f in operators}, "pipeline": corpus_pipeline.run}


def statements() -> dict[str, str]:
    return dict(sql.STATEMENTS)
