"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.sources.frames import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for nodes ``a`` and ``b`` of the edges.

    Each round first hangs every larger neighbour of a node on the smallest
    one (large star), then every smaller neighbour (small star). Rounds grow
    with the logarithm of the longest path. Minima are aggregated before they
    are shuffled, and a hub's rows are split by the adaptive join.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut_lineage(e), None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
