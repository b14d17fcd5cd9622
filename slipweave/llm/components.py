"""Connected components by alternating large-star and small-star steps.

Edges never leave the executors: each round is two shuffles over the edge
table, written to the shared checkpoint folder so that a lost executor costs a
re-read. Rounds grow with the logarithm of a component's diameter. Groups are
reduced with min(), which combines before the shuffle, so a hub's edges never
meet in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, remove, new_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Links each node's neighbours to the smallest of the
    neighbourhood: the larger neighbours (large star) or the smaller ones."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").dropDuplicates(["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have a link.

    Self links and repeated links are harmless; nulls are dropped; no links give
    no rows. Raises if `rounds` alternations do not converge.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).dropDuplicates(["u", "v"])
    path = new_path(spark, "links")
    now = materialize(now, "links", path)
    for _ in range(rounds):
        # Done when every larger node has one link and no node is both ends.
        u, v = now.select("u"), now.select(F.col("v").alias("u")).distinct()
        if now.groupBy("u").count().where("count > 1").isEmpty() and u.join(v, "u", "left_semi").isEmpty():
            break
        nxt = new_path(spark, "links")
        now = materialize(_star(_star(now, True), False), "links", nxt)
        remove(spark, path)
        path = nxt
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
