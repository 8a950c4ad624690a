"""Exact ranks and running sums of hot groups without one task per group.

A window over a group sorts that group in one task, which fails when one key holds a third of the rows. Here the rows
are range-partitioned by group, order and tie, with bounds that Spark samples, so a hot group is cut into as many ranges
as its size asks for; the number of ranges is the session's shuffle partitions, less what adaptive execution joins. A
small table of range totals gives the offset of every range, and the window runs within (group, range) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.staging import Stage


def seeded_hash(seed: int, *columns: str) -> Column:
    """A 64-bit hash that permutes rows under `seed`."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def ranged(df: DataFrame, group: list[str], order: str, tie: list[str]) -> DataFrame:
    """`df` with `_range`, the number of its range in the order of group, order and tie. It is written once, so that the
    numbers hold whatever is computed again."""
    parts = df.repartitionByRange(*group, order, *tie).withColumn("_range", F.spark_partition_id())
    return Stage(df.sparkSession, "ranged").put(parts, "rows")


def _with_offsets(rows: DataFrame, columns: list[str], group: list[str], totals: Column, within: Column, name: str) -> DataFrame:
    sums = rows.groupBy(*group, "_range").agg(totals.alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    o = sums.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).alias("o")
    same = F.col("l._range") == F.col("o._range")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = rows.withColumn("_r", within).alias("l").join(o, same)
    return joined.select(*[F.col(f"l.{c}") for c in columns], (F.col("l._r") + F.col("o._before")).alias(name))


def permuted_rank(df: DataFrame, group: list[str], order: str, tie: list[str], name: str = "rank") -> DataFrame:
    """Adds `name`: 1, 2, … within `group` by (`order`, `tie`). Rows equal in all of these are ranked arbitrarily.

    A null group value is a group of its own; null orders come first. An empty table gives no rows.
    """
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order, *tie))
    return _with_offsets(ranged(df, group, order, tie), df.columns, group, F.count(F.lit(1)), within, name)


def running_total(df: DataFrame, group: list[str], order: str, tie: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of `group` that come before this one by (`order`, `tie`).

    Null values count as 0. Same distribution as `permuted_rank`.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("long")
    window = Window.partitionBy(*group, "_range").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(v).over(window), F.lit(0))
    return _with_offsets(ranged(df, group, order, tie), df.columns, group, F.sum(v), within, name)
