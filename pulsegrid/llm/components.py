"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (two columns of whole numbers), the root being the
    smallest node reachable; the root itself has a row too.

    A large star links a node's greater neighbours to its least neighbour, a small star links the
    lesser ones; both keep components and repeating them leaves one star per component. Loops, repeats,
    either direction and nulls (left out) are allowed. Each round is written to the shared folder; the
    driver sees two numbers a round.
    """
    a, b = edges.columns[:2]
    pairs = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    now = cut_lineage(pairs, name)
    seen = _signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.union(lower).distinct(), name)
        before, seen = seen, _signature(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
