from pyspark.sql import functions as F

from siltstone.llm import splits as C

SLICE = "record_id string, family_id string, normalized_sha256 string, node string, component string, split string, key int, u int"


def slice_rows(spark, rows):
    """Rows with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 2) for r in rows], SLICE)


def test_family_key(spark):
    same = ["src_1:path:alpha-beta-0a1", "SRC_1:Path:Alpha Beta 0A1", " src_1|path|alpha.beta.0a1 ", "src_1::path::test_alpha-beta-0a1", "src_1/path/alpha-beta-0a1-tests ", "src_1 : path : tests alpha beta 0a1:"]
    other = ["src_1:path:alpha-beta-0a2", "src_2:path:alpha-beta-0a1", "src_1:path:contest-0a1", "src_1:path:testable-0a1"]
    df = spark.createDataFrame([(x,) for x in same + other + [None, "a:test", "--"]], "f string").withColumn("k", C.family_key(F.col("f")))
    keys = {r["f"]: r["k"] for r in df.collect()}
    assert len({keys[x] for x in same}) == 1
    assert len({keys[x] for x in [same[0], *other]}) == 5
    assert keys[None] is None and keys["a:test"] == "atest" and keys["--"] == "--"


def test_linked_families_and_splits(spark):
    rows = [
        ("r1", "s:a:x-1", "h1"), ("r1", "s:a:y-2", "h1"), ("r2", "S:A:Y 2", "h2"), ("r3", "s:a:z-3", "h2"), ("r4", "s:b:q-4", None), ("r5", "s:b:w-5", None), ("r6", None, "h2"), ("r7", None, None),
        (None, "s:c:e-6", "h9"), (None, "s:c:f-7", "h8"), ("r4", "s:b:q-4", None), ("r8", None, "hh"), ("r9", None, "hh"),
    ]
    df = slice_rows(spark, rows)
    pairs = {tuple(r) for r in C.linked_families(spark, df).collect()}
    group = sorted(["s:a:x-1", "s:a:y-2", "S:A:Y 2", "s:a:z-3"])
    assert pairs == {(a, b) for a in group for b in group if a < b}
    s = {r["record_id"]: (r["component"], r["split"]) for r in C.grouped_splits(spark, df).collect()}
    assert s["r1"] == s["r2"] == s["r3"] == s["r6"] and s["r8"] == s["r9"] and s["r4"][0] != s["r5"][0]
    assert set(s) == {"r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "r9"}


def test_splits_of_empty_table(spark):
    empty = slice_rows(spark, [])
    assert C.grouped_splits(spark, empty).count() == 0 and C.linked_families(spark, empty).count() == 0


def test_split_shares_with_a_heavy_component(spark):
    rows = spark.range(20000).select(F.when(F.col("id") < 6000, F.lit(-1)).otherwise(F.col("id")).alias("c"))
    got = {r["split"]: r["count"] / 20000 for r in C.component_splits(rows, "c").groupBy("split").count().collect()}
    assert abs(got["train"] - 0.8) < 0.02 and abs(got["validation"] - 0.1) < 0.02 and abs(got["test"] - 0.1) < 0.02
    again = C.component_splits(rows, "c")
    assert again.groupBy("c").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_records_without_family_link_by_every_hash(spark):
    """r1 holds two hashes; r2 shares one of them; both have no family."""
    s = {r["record_id"]: r["component"] for r in C.grouped_splits(spark, slice_rows(spark, [("r1", None, "A"), ("r1", None, "B"), ("r2", None, "B"), ("r5", None, "C")])).collect()}
    assert s["r1"] == s["r2"] != s["r5"]


def test_a_record_without_family_bridges_two_families(spark):
    rows = [("r1", None, "A"), ("r1", None, "B"), ("r3", "s:a:f-1", "A"), ("r4", "s:a:g-2", "B"), ("r6", "s:a:g-2", None), (None, "s:a:h-3", "C"), ("r7", "s:a:h-3", None), ("r8", None, "C")]
    s = {r["record_id"]: (r["component"], r["split"]) for r in C.grouped_splits(spark, slice_rows(spark, rows)).collect()}
    assert s["r1"] == s["r3"] == s["r4"] == s["r6"] and s["r7"] == s["r8"] != s["r1"]
    checks = {r["check"]: r["found"] for r in C.split_checks(spark, slice_rows(spark, rows)).collect()}
    assert checks == {"hash_over_splits": 0, "family_over_splits": 0, "record_over_splits": 0, "record_without_split": 0, "records": 6}
