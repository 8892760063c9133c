"""Connected components of a stored edge list, by large-star and small-star rounds.

Each round is two aggregates and two joins on node keys; hot nodes combine
before the shuffle and their join partitions are split by the runtime re-plan. Rounds grow with the
logarithm of the longest chain. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, settle


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` are distinct (a, b) with a < b. Small: per node its smaller neighbours join the least; large: the larger ones do."""
    if small:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        own = least.select(F.col("b").alias("v"), "m")
        moved = edges.join(least, "b").select(F.col("a").alias("v"), "m")
        out = own.unionAll(moved)
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        out = both.filter("v > u").join(least, "u").select("v", "m")
    return out.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches. Nulls and loops are dropped; no edges, no rows."""
    current = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), label)
    state = None
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state or not row.n:
            break
        state, before = (row.n, row.h), current
        current = settle(_star(_star(current, small=False), small=True), label)
        drop(before)
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        current.select(F.col("a"), F.col("a")).distinct())
