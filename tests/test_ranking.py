from pyspark.sql import functions as F

from siltstone.operators.ranking import permuted_rank, ranged, running_total, seeded_hash


def test_permuted_rank_and_running_total(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.lit(None)).otherwise("b").alias("g"), "id", seeded_hash(3, "id").alias("h"), (F.col("id") % 7).alias("v"))
    rows = [r.asDict() for r in permuted_rank(df, ["g"], "h", ["id"]).collect()]
    before = {r["id"]: r["before"] for r in running_total(df, ["g"], "h", ["id"], "v").collect()}
    for g in ("a", None, "b"):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in own] == list(range(1, 1001))
        total = 0
        for r in own:
            assert before[r["id"]] == total
            total += r["v"]


def test_a_hot_group_is_cut_into_ranges(spark):
    """Whatever the width of the order values, one group of all rows spreads over the partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        small = spark.range(0, 6000).select(F.lit("g").alias("g"), "id", (F.col("id") % 500).alias("o"))
        n = ranged(small, ["g"], "o", ["id"]).groupBy("_range").count().collect()
        assert len(n) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in n) < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranks_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, 3, 3), (None, None, 4)], "g string, o long, id int")
    assert {(r["id"], r["rank"]) for r in permuted_rank(rows, ["g"], "o", ["id"]).collect()} == {(1, 1), (2, 2), (4, 1), (3, 2)}
    assert permuted_rank(rows.limit(0), ["g"], "o", ["id"]).count() == 0 and running_total(rows.limit(0), ["g"], "o", ["id"], "id").count() == 0
