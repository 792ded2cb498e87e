"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins over the edges; nothing is collected but two numbers
that tell whether the edge table still changes. A hub with very many edges is a skewed join key, which
adaptive execution splits; its minimum is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v): links go to the smallest neighbour of their centre."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u").where(F.col("v") > F.col("u") if large else F.lit(True))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of one integer type -> (node, component) for every node with an edge, component its smallest member.

    Self links and repeated or reversed links are harmless; nulls are ignored; no edges give no rows.
    """
    now = materialize(spark, edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = materialize(spark, _star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
