"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.staging import Stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself its least neighbour. Edges run from the larger end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u BIGINT, v BIGINT); component is the least node of each.

    Loops and repeated edges are allowed, nulls are dropped, an empty table gives no rows. Minimum aggregates combine
    before the shuffle, so a node with a third of all edges is no hot task; joins rely on adaptive skew splitting. Each
    round writes its edges to the shared folder, and the round before is deleted; no node list reaches the driver.
    """
    stage = Stage(spark, "components")
    oriented = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen, name = stage.put(oriented.distinct(), "round0"), None, "round0"
    for turn in range(1, most_rounds + 1):
        following = stage.put(_small_star(_large_star(now)), f"round{turn}")
        sign = following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        stage.drop(name)
        now, name = following, f"round{turn}"
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
