"""Connected components of a large edge table, by alternating large-star and small-star rounds.

Every round is a partial aggregation and a join, so a hub with a large share of all edges is summed before the
shuffle and split by the skew join. Rounds are cut by stored tables and end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them. Here u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`u`, `v` (any comparable type; order and repeats don't matter) -> `node`, `root`: the smallest node that can
    be reached, for every node that is not itself the smallest."""
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(ordered, "edges")
    seen = _print(now)
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        then, seen = seen, _print(now)
        if then == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
