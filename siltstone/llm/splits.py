"""Splits that keep related records together: components of records over shared entities, then hashed split ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components
from siltstone.plans.staging import Stage

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: A component with at least this share of the rows is placed by itself; at most 1 / HEAVY_SHARE of them exist.
HEAVY_SHARE = 0.01
SPLIT_RANGE = 1 << 30


def family_key(family: Column) -> Column:
    """What tells families apart: letters and digits in lower case, without a leading or trailing `test` or `tests`
    in the last component. Components end at `:`, `/` or `|`. Null stays null; a name of only such words is kept."""
    text = F.regexp_replace(F.lower(family), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    last = F.regexp_extract(text, r"([^:/|]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(last, r"^[^\p{L}\p{N}]*tests?[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+tests?[^\p{L}\p{N}]*$", "")
    first = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(last))
    squeezed = F.regexp_replace(F.concat(first, bare), r"[^\p{L}\p{N}]+", "")
    return F.when(squeezed == "", F.lower(family)).otherwise(squeezed)


def star_edges(keyed: DataFrame) -> DataFrame:
    """(u, v) from (node, key): each node of a key with its least one. A key with one node gives no edge, and none gives
    pairs of its rows; the least node of a hot key is found by partial aggregates."""
    ends = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return keyed.join(ends, "key").where("node > low").select(F.col("node").alias("u"), F.col("low").alias("v"))


def _keys(**columns: Column) -> Column:
    """64-bit keys of the columns that are not null, each kind apart."""
    return F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.xxhash64(F.lit(kind), c)) for kind, c in columns.items()])))


def family_components(spark: SparkSession, slice_: DataFrame) -> DataFrame:
    """(family_id, component) for each distinct stored, non-null `family_id`.

    Families with one `family_key`, one `record_id` or one `normalized_sha256` in common are joined, transitively.
    Keys are 64-bit hashes. A record or hash seen with one family only gives no edge, so the graph holds just the links.
    """
    node = F.xxhash64(family_key(F.col("family_id")))
    rows = slice_.where(F.col("family_id").isNotNull())
    names = rows.select("family_id").distinct().withColumn("node", node)
    keyed = rows.select(node.alias("node"), _keys(r=F.col("record_id"), s=F.col("normalized_sha256")).alias("key"))
    parts = connected_components(spark, star_edges(keyed))
    return names.join(parts, "node", "left").select("family_id", F.coalesce("component", "node").alias("component"))


def linked_families(spark: SparkSession, slice_: DataFrame) -> DataFrame:
    """(family_a, family_b), family_a < family_b by code point, for all stored families of one component.

    The result is a list of pairs by its definition; `grouped_splits` has one row per record instead.
    """
    c = family_components(spark, slice_)
    many = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    c = Stage(spark, "families").put(c.join(many, "component"), "members")
    a, b = c.select("component", F.col("family_id").alias("family_a")), c.select("component", F.col("family_id").alias("family_b"))
    return a.join(b, "component").where("family_a < family_b").select("family_a", "family_b")


def component_splits(rows: DataFrame, component: str, splits=SPLITS, seed: int = 17) -> DataFrame:
    """Adds `split` to `rows`: all rows of a component share it, shares of rows come near `splits`.

    The component's hash falls into ranges proportional to the shares. Components of at least HEAVY_SHARE of all
    rows would bend the shares, so these few (at most 100) are placed first, each into the split with most room, and
    the ranges of the rest are proportional to the room left. Null components are spread by the hash of null: give
    such rows a component of their own before. An empty table gives no rows.
    """
    sizes = rows.groupBy(component).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    heavy = sizes.where(F.col("_n") >= F.lit(max(2, int(total * HEAVY_SHARE)))).orderBy(F.desc("_n"), component).limit(int(1 / HEAVY_SHARE)).collect() if total else []
    room = {name: share * total for name, share in splits}
    placed: dict[str, list[int]] = {}
    for c, n in heavy:
        name = max(room, key=lambda k: room[k])
        room[name] -= n
        placed.setdefault(name, []).append(c)
    left = {name: max(0.0, r) for name, r in room.items()}
    scale = sum(left.values()) or 1.0
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(component)), F.lit(SPLIT_RANGE))
    choice, reached = None, 0.0
    for name, of in placed.items():
        choice = F.when(F.col(component).isin(of), name) if choice is None else choice.when(F.col(component).isin(of), name)
    names = [name for name, _ in splits]
    for name in names[:-1]:
        reached += left[name] / scale
        at = draw < F.lit(int(reached * SPLIT_RANGE))
        choice = F.when(at, name) if choice is None else choice.when(at, name)
    return rows.withColumn("split", choice.otherwise(names[-1]) if choice is not None else F.lit(names[-1]))


def record_components(spark: SparkSession, slice_: DataFrame) -> DataFrame:
    """(record_id, component) for every distinct record, those without a family among them.

    Records are the nodes. Every row links its record to its family and to its hash, so a record with two hashes, with
    or without a family, joins all records of both, and two families that any chain of records links fall into one
    component. Rows without a record id are nodes of their own: they pass links on, but are not in the result.
    """
    family = F.xxhash64(family_key(F.col("family_id")))
    node = F.when(F.col("record_id").isNotNull(), F.xxhash64(F.lit("r"), "record_id")).otherwise(F.xxhash64(F.lit("row"), "family_id", "normalized_sha256"))
    keys = _keys(f=F.when(F.col("family_id").isNotNull(), family), s=F.col("normalized_sha256"))
    keyed = Stage(spark, "records").put(slice_.select(node.alias("node"), keys.alias("key")).distinct(), "keyed")
    parts = connected_components(spark, star_edges(keyed))
    ids = slice_.where("record_id is not null").select("record_id").distinct().withColumn("node", F.xxhash64(F.lit("r"), "record_id"))
    return ids.join(parts, "node", "left").select("record_id", F.coalesce("component", "node").alias("component"))


def grouped_splits(spark: SparkSession, slice_: DataFrame, splits=SPLITS, seed: int = 17) -> DataFrame:
    """(record_id, component, split) for every distinct record of a slice."""
    parts = Stage(spark, "splits").put(record_components(spark, slice_), "records")
    return component_splits(parts, "component", splits, seed)


def split_checks(spark: SparkSession, slice_: DataFrame) -> DataFrame:
    """(check, found): how many entities stand in two splits, how many records have none or more than one, and how many
    records there are."""
    stage = Stage(spark, "checks")
    splits = stage.put(grouped_splits(spark, slice_), "splits")
    rows = stage.put(slice_.select("record_id", "family_id", "normalized_sha256").join(splits.select("record_id", "split"), "record_id", "left"), "rows").where("record_id is not null")
    over = lambda key, name: rows.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), "found")
    out = over(F.col("normalized_sha256"), "hash_over_splits").union(over(family_key(F.col("family_id")), "family_over_splits")).union(over(F.col("record_id"), "record_over_splits"))
    out = out.union(rows.where("split is null").agg(F.count(F.lit(1)).alias("found")).select(F.lit("record_without_split").alias("check"), "found"))
    return out.union(splits.agg(F.count_distinct("record_id").alias("found")).select(F.lit("records").alias("check"), "found"))
