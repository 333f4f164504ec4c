"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: hang neighbours on the least neighbour."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the least node reachable.

    Each round is two star steps (aggregate and equi-join, so a hot node is
    pre-aggregated and its join can be split) stored in the shared folder; it
    ends when a round changes nothing, after O(log^2 n) rounds.
    """
    digest = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    cur = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    before = cur.agg(*digest).first()
    while before[0]:
        cur = stored(_star(_star(cur, True), False), "edges")
        after = cur.agg(*digest).first()
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
