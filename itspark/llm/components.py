"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; the root is the component's smallest node.

    Rounds of large-star and small-star (Kiveris et al. 2014): each node's neighbours are hung below the
    smallest of them, first the larger ones, then the smaller ones, until nothing changes; the number of
    rounds grows with the logarithm of the component. Neighbours are never listed: a minimum per node is
    an aggregate, and joining it back leaves the rows of a hub to be split. Every round is staged.
    """
    u, v = F.col("u"), F.col("v")
    pairs = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u != v).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionAll(pairs.select(v.alias("u"), u.alias("v")))
        smallest = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "smallest")
        # Rows where the node is itself the smallest stay as they are, so hubs that are roots are not joined.
        large = both.join(smallest, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        smallest = staged(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        joined = large.join(smallest, "u")
        small = joined.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionAll(smallest.select("u", F.col("m").alias("v")))
        pairs = staged(small.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return pairs.select(u.alias("node"), v.alias("root")).unionAll(pairs.select(v.alias("node"), v.alias("root")).distinct())
        before = now
