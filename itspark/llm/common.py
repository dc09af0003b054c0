"""What the operators share: stages, content keys, tables of distinct texts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.sources import stage


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and go on from the files; cuts the lineage."""
    path = stage.new_stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


#: Whether Spark deletes the shuffle files of a query when it has ended, and not when the driver next collects garbage.
BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffles go with the query that made them; for steps that hand on stages and nothing else."""
    before = spark.conf.get(BRIEF, "false")
    spark.conf.set(BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.set(BRIEF, before)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for table in tables:
        stage.remove(table.sparkSession, table._stage_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a text's content; null counts as empty."""
    return F.unhex(F.md5(text_of(column)))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Spark takes no more buckets than this for a table, and a bucket needs a file for each task that has rows of it.
MAX_BUCKETS = 50_000


class Texts:
    """The distinct texts of a table, bucketed by content key, with how many rows have each.

    Texts cross the network once. Later steps join their own small tables by key and the texts stay where
    they are, since the buckets are already dealt by key. A group of copies is one row from the map side on.
    The files lie in the shared folder of the stages; the catalog only knows how they are bucketed. Used as a
    context manager it goes when the work is done or has failed.
    """

    def __init__(self, docs: DataFrame, column: str = "text"):
        self.spark = docs.sparkSession
        self.name = f"texts_{uuid.uuid4().hex}"
        self.path = stage.new_stage_path(self.spark, "texts")
        keyed = docs.select(text_key(column).alias("key"), text_of(column).alias("text")).groupBy("key")
        rows = keyed.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        buckets = min(shuffle_partitions(self.spark), MAX_BUCKETS)
        rows.write.bucketBy(buckets, "key").option("compression", "zstd").option("path", self.path).saveAsTable(self.name)

    def __enter__(self) -> Texts:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def table(self) -> DataFrame:
        """key, text, copies."""
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        stage.remove(self.spark, self.path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
