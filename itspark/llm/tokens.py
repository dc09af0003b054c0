"""Token counts with a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the tokenizer: its
file and how it is called. Texts whose digests are not stored are encoded once each, however many rows have
them, and their counts appended to the cache. Normalising must not change a count: a null text is an empty
one, and nothing else is touched, since the tokenizer looks at white space and case.

Cases: a null text counts as an empty one; repeated rows and copies get one encoding and the same count; an
empty table leaves the cache as it is. Text that is not valid where it comes from never gets here: Spark's
strings are UTF-8. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.llm.common import staged, text_of

LIMIT = 4096
CACHE = "content binary, tokenizer string, n_tokens long"
BATCH = 64


def tokenizer_digest(path: str) -> str:
    """Stands for the tokenizer's version: its file, and that no special tokens are added or read."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0plain text, no added tokens, whole text").hexdigest()


def _encoder(path: str):
    """Counts tokens of a list of texts; made once in a task."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def content_digest(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(column), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing was ever stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def encode_misses(docs: DataFrame, path: str, cache: str) -> None:
    """Encode each distinct text that the cache does not have, and append the counts to it."""
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("content")
    # Copies meet on the map side: one text per content and task goes on.
    distinct = docs.select(content_digest().alias("content"), text_of().alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    missing = distinct.join(known, "content", "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            counts = []
            for start in range(0, batch.num_rows, BATCH):
                counts.extend(count(batch.column("text").slice(start, BATCH).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"]
            )

    missing.mapInArrow(work, CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; the counts come from the cache, filled up first."""
    docs = docs.select("doc_id", "text")
    encode_misses(docs, path, cache)
    stored = read_cache(docs.sparkSession, cache).filter(F.col("tokenizer") == tokenizer_digest(path))
    # Two jobs that filled the cache at once may have stored a text twice, with the same count. The counts are
    # staged so that the join has plain shuffles on both sides and Spark can split the rows of a hot text.
    counts = staged(stored.groupBy("content").agg(F.first("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), content_digest().alias("content"))
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
