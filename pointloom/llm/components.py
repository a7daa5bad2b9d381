"""Connected components of a graph held in a DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import drop_stored, stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root), root the smallest node reachable; nodes without an edge are absent.

    Each round hangs every neighbour of a node on the smallest one, first the larger
    neighbours, then the smaller ones, until the edges are stars. Rows only carry two
    longs and a round at most keeps the number of edges, so a hub costs rows, not pairs.
    Self loops are ignored; an empty input gives an empty result.
    """
    stars = stored(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = stars.union(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        low = low.select("c", F.least("c", "m").alias("m"))
        large = both.where("u > v").join(low, F.col("v") == F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        down = large.join(low, F.col("v") == F.col("c"))
        small = down.select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select(F.col("c").alias("v"), F.col("m").alias("u")))
        last, stars = stars, stored(small.where("u <> v").distinct())
        drop_stored(last)
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("u", "v") % 1000003))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).union(stars.select("u", "u").distinct())
