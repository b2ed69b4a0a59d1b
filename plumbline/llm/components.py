"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node reachable.

    Both columns of links are long and not null; loops and repeats are allowed.
    Every round re-hangs neighbours on smaller ones (Kiveris et al., "Connected
    components in MapReduce and beyond"), in O(log n) rounds in practice. Minima
    are combined before the shuffle and neighbour lists are never gathered, so a
    hub with many links stays many rows. Each round is a reliable checkpoint.
    Raises if max_rounds don't suffice; an empty link table gives an empty result.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e)
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select("u", F.col("m").alias("v")).unionByName(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
