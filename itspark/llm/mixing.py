"""Mix sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by (source, key), which spreads a large
source over as many tasks as it needs; running sums of the sizes inside a range plus the sums of the ranges
before give each document's place in its source, and the source is cut where its budget ends. A budget
above the source's size repeats the whole source first. DataFrame functions only.

Cases: a null text has size 0; a null source is a source of its own, last in order; rows with equal keys
(repeated rows) are ordered by size, and equal ones split the cut between them; a source without words and
an empty table have target 0. Columns other than the id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itspark.llm.common import shuffle_partitions, staged, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the random key of each document."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    )


def in_order(df: DataFrame, by: Sequence[Column], name: str) -> DataFrame:
    """Range-partition by columns and number the ranges.

    The range number is staged with the rows, so sums and offsets speak of the same ranges whatever task is
    run again. Only one sum per range is put in order in one place.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by)
    return staged(ranged.withColumn("_range", F.spark_partition_id()), name)


def source_order(size_of: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with their weights: in code point order, null last, the weights repeat.

    A source's place is the number of sources in earlier ranges plus its place in its own range.
    """
    ranged = in_order(size_of, [F.col("source").isNull(), F.col("source")], "sources")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), F.col("source")))
    place = F.col("_offset") + inside - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.join(offsets, "_range").select(
        "source", "source_size", F.get(listed, F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight")
    )


def targets(size_of: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target: shares by weight, held at ``max_epochs`` times the size.

    What a held source leaves is shared again by weight among the rest until no source is above. Each round
    is one aggregate over the sources; three numbers come back to the driver.
    """
    table = staged(source_order(size_of, weights), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(max_epochs)
    rate, held_before = None, -1
    while True:
        held = F.lit(False) if rate is None else limit <= F.col("weight") * F.lit(rate)
        got = table.agg(
            F.sum(F.when(held, limit)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("weight"), F.count(F.when(held, 1)).alias("n")
        ).first()
        if got["n"] == held_before or not got["weight"]:
            break
        held_before = got["n"]
        rate = (share * total - (got["held"] or 0)) / got["weight"]
    free = F.col("weight") * F.lit(rate if rate is not None else 0.0)
    return table.withColumn("target", F.when(limit <= free, limit.cast("double")).otherwise(free).cast("double"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes of the document).

    ``taken`` is the document's size times the whole repeats of its source, plus what falls into the rest of
    the budget. The document at the cut gives the words up to it, so a source's sum is its target without
    the fraction.
    """
    order = [F.col("source"), F.col("draw"), F.col("doc_id"), F.col("size")]
    ranged = in_order(staged(sizes(docs), "sizes"), order, "drawn")
    sums = staged(ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, max_epochs)
    # One row per source and range: at most the number of ranges plus the number of sources in all.
    ahead = Window.partitionBy("source").orderBy("_range")
    offsets = sums.select("source", "_range", (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_offset"))
    known = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("_source"), F.col("o._range").alias("_r"), "_offset", "source_size", "target"
    )
    inside = Window.partitionBy("_range", "source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    cut = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - (F.col("_offset") + F.col("_inside"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))
