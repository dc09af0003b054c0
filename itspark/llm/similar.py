"""Texts whose sets of shingles have a Jaccard similarity of at least a given fraction, exactly.

Shingles are put into one order for all texts, frequent ones last. Two sets that are similar enough share one
of their first ``n - ceil(fraction * n) + 1`` shingles, so only these are looked up (prefix filter); sizes and
places rule out more pairs, none of them similar enough. Every pair that becomes a link has had its shingle
sets compared. How frequent a shingle is comes from a sample of the texts, and only moves work: any order
gives the same links.

A large group of near copies shares a list of texts per shingle. Its texts are first compared with one text of
the list, another one each round; texts linked so far count as one, and only pairs of texts that are still
apart are listed in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import discard, staged, text_key, text_of
from itspark.llm.components import components
from itspark.llm.grams import shingle_hashes

#: One text in so many is counted, and a shingle is frequent from so many texts of the sample on.
SAMPLE, FREQUENT = 8, 4
#: The most frequent shingles that are sent to all tasks.
MAX_FREQUENT = 1 << 19
ROUNDS = 3
#: Pairs are listed at once while a text is in lists of at most so many on average.
LONG = 32


def distinct_shingles(text: bytes, width: int) -> np.ndarray:
    """A text's shingles, each once; texts without words share one of their own."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], np.uint64)).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    keyed = docs.select(text_key().alias("key"), text_of().alias("text"))
    return keyed.withColumn("node", F.xxhash64("key")).select("node", "text")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node, shingles of each text; a task passes over copies of a text it has had lately."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary())):
                if node in had:
                    continue
                if len(had) > 200_000:
                    had.clear()
                had.add(node)
                own = distinct_shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([own], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(work, "node long, shingles array<long>")


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order, and how often the sample has each."""
    sample = _sets(texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0), width).select(F.explode("shingles").alias("hash"))
    found = sample.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT).toArrow().sort_by("hash")
    return found.column("hash").to_numpy(), found.column("n").to_numpy()


def _prefixes(texts: DataFrame, width: int, fraction: tuple[int, int]) -> DataFrame:
    """hash, node, n, place of the first shingles of each text, and how many shingles it has."""
    sent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, width))
    over, under = fraction

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        had = set()
        for batch in batches:
            hashes, nodes, sizes, places = [], [], [], []

            def flush():
                lengths = [len(h) for h in hashes]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), pa.array(np.repeat(nodes, lengths).astype(np.int64)), pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(np.concatenate(places))],
                    names=["hash", "node", "n", "place"],
                )

            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary())):
                if node in had:
                    continue
                if len(had) > 200_000:
                    had.clear()
                had.add(node)
                own = distinct_shingles(text.as_py(), width)
                often = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    often = np.where(frequent[at] == own, counts[at], 0)
                first = own[np.lexsort((own, often))][: len(own) - -(-over * len(own) // under) + 1]
                hashes.append(first)
                nodes.append(node)
                sizes.append(len(own))
                places.append(np.arange(len(first), dtype=np.int32))
                if len(hashes) >= 200:
                    yield flush()
                    hashes, nodes, sizes, places = [], [], [], []
            if hashes:
                yield flush()

    return texts.mapInArrow(work, "hash long, node long, n int, place int")


def _possible(fraction: tuple[int, int], a: str, b: str) -> Column:
    """Whether sizes allow the fraction, and the shared shingle is early enough in both to be the first shared one."""
    over, under = fraction
    m, n, p, q = (F.col(c).cast("long") for c in (f"{a}_n", f"{b}_n", f"{a}_place", f"{b}_place"))
    sizes = under * F.least(m, n) >= over * F.greatest(m, n)
    return sizes & ((over + under) * F.least(m - p, n - q) >= over * (m + n))


def verified(texts: DataFrame, pairs: DataFrame, width: int, fraction: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose shingle sets are similar enough."""
    over, under = fraction
    pairs = staged(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "pairs")
    wanted = staged(pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct(), "wanted")
    sets = staged(_sets(texts.join(wanted, "node", "left_semi"), width).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - shared
    out = staged(pairs.join(a, "u").join(b, "v").filter(under * shared >= over * union).select("u", "v"), "similar")
    discard(pairs, wanted, sets)
    return out


def similar(docs: DataFrame, candidates: DataFrame, width: int, fraction: tuple[int, int]) -> DataFrame:
    """Links (u, v) that connect exactly the texts that pairs of at least this similarity connect.

    Nodes are xxhash64 of the content keys. ``candidates`` are pairs that are likely to be similar; they save
    work and need be neither right nor complete.
    """
    texts = _keyed(docs)
    links = [verified(texts, candidates, width, fraction)]
    rows = staged(_prefixes(texts, width, fraction), "prefixes")
    several = staged(rows.groupBy("hash").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("hash"), "several")
    lists = staged(rows.join(several, "hash", "left_semi").distinct(), "lists")
    discard(rows, several)

    def apart() -> DataFrame:
        """The lists that hold texts not yet linked, with each text's root."""
        found = links[0]
        for more in links[1:]:
            found = found.unionAll(more)
        rooted = staged(lists.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        mixed = rooted.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("hash")
        out = staged(rooted.join(mixed, "hash", "left_semi"), "apart")
        discard(rooted)
        return out

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select("hash", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "place", "root")])

    left = apart()
    for turn in range(ROUNDS):
        sizes = left.groupBy("hash").count().agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
        if sizes[0] is None or sizes[1] <= LONG * sizes[0]:
            break
        middle = left.groupBy("hash").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "place", "root")).alias("m")).select("hash", "m.*")
        pairs = side(left, "a").join(side(staged(middle, "middle"), "b"), "hash").filter(F.col("a_root") != F.col("b_root")).filter(_possible(fraction, "a", "b"))
        links.append(verified(texts, pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")), width, fraction))
        discard(left)
        left = apart()
    pairs = side(left, "a").join(side(left, "b"), "hash").filter("a_node < b_node and a_root != b_root").filter(_possible(fraction, "a", "b"))
    links.append(verified(texts, pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")), width, fraction))
    discard(lists)
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    return found
