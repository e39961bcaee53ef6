"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(u, v)`` with ``v < u``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(least, "u").where("v > u and v > m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(down, "u").where("v != m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` that is not its component's least.

    Only minima are gathered per node, so a hub is a skewed join key and not a
    group; every round is stored, and the loop ends when a round changes
    nothing.  Self loops and repeated edges are harmless.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"),
                                              F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(now)
    while before[0]:
        now = stored(_round(now), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
