"""Exact set-similarity joins by rare-first prefixes, generalised over threshold and token sets."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.staging import Stage


#: Passes over the runs, so that a part of them is on disk at a time, and runs from which on more than one pass is taken.
PASSES, LEAST_RUNS = 4, 1_000_000
#: Keys that are sent to all executors at once; more of them take more passes over the rows.
KEYS_AT_ONCE = 500_000


def _where_in(stage: Stage, rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose `column` is among `keys` (of one column of that name, distinct and stored), found without a shuffle of
    rows. A key is in one pass only, so no row comes twice."""
    passes = max(1, -(-keys.count() // KEYS_AT_ONCE))
    part = lambda k: keys.where(F.pmod(F.xxhash64(F.lit(5), column), F.lit(passes)) == k)
    return stage.put_each([lambda k=k: rows.join(F.broadcast(part(k)), column, "left_semi") for k in range(passes)], name)


def similar_sets(stage: Stage, sets: DataFrame, threshold: Fraction, name: str = "sim") -> DataFrame:
    """(a, b, score) for every two keys a < b of `sets` (key, runs ARRAY<BIGINT>) with Jaccard ≥ threshold.

    Two such sets share at least ⌈t·n⌉ of the n runs of either, so one of the n − ⌈t·n⌉ + 1 rarest runs of a set, in
    one order over the corpus, is among those of any partner. The smaller set shares ⌈2t/(1+t)·n⌉ of its runs, so of it
    fewer serve. Runs of one set only are counted off first. Empty and null sets have no partner. Copies are not folded
    here: fold them before where groups of copies may be large.

    Bytes on disk decide at scale: `sets` should be a stored table, as it is read several times. Runs are shuffled in
    passes, by run to be counted and by key to be ordered, and sets are fetched for candidates only.
    """
    p, q = threshold.numerator, threshold.denominator
    rows = sets.where("key is not null and size(runs) > 0").select("key", "runs", F.size("runs").alias("n"))
    passes = max(1, min(PASSES, -(-(rows.agg(F.sum("n")).first()[0] or 0) // LEAST_RUNS)))
    part = lambda c, k: F.pmod(F.xxhash64(F.lit(3), c), F.lit(passes)) == k
    runs = rows.select(F.explode("runs").alias("run"))
    often = stage.put_each([lambda k=k: runs.where(part("run", k)).groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1") for k in range(passes)], f"{name}_often")
    n, absent = F.col("n"), F.col("n") - F.size("common")
    spare = F.size("common") - F.floor((n * p + q - 1) / q)
    spare_least = n - F.floor((n * (2 * p) + p + q - 1) / (p + q)) - absent

    def heads(k: int) -> DataFrame:
        ones = rows.where(part("key", k)).select("key", "n", F.explode("runs").alias("run"))
        own = ones.join(often, "run").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("common"))
        kept = own.withColumn("spare", spare).withColumn("least", spare_least).where("spare >= 0")
        head = F.slice("common", F.lit(1), (F.col("spare") + 1).cast("int"))
        return kept.select("key", "n", "least", F.posexplode(head).alias("at", "b")).select("key", "n", "b.run", (F.col("at") <= F.col("least")).alias("first"))

    blocks = stage.put_each([lambda k=k: heads(k) for k in range(passes)], f"{name}_blocks")
    stage.drop(f"{name}_often")
    x, y = blocks.alias("x"), blocks.where("first").alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.key") > F.col("y.key"))
    met = x.join(y, (F.col("x.run") == F.col("y.run")) & larger & (F.col("y.n") * q >= F.col("x.n") * p))
    pairs = stage.put_each([lambda: met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()], f"{name}_pairs")
    stage.drop(f"{name}_blocks")
    keys = stage.put_each([lambda: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()], f"{name}_keys")
    mine = _where_in(stage, rows.select("key", "runs"), "key", keys, f"{name}_sets")
    left, right = mine.select(F.col("key").alias("a"), F.col("runs").alias("r_a")), mine.select(F.col("key").alias("b"), F.col("runs").alias("r_b"))
    both = F.size(F.array_intersect("r_a", "r_b"))
    union = F.size("r_a") + F.size("r_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * q >= union * p).select("a", "b", (both / union).alias("score"))


def best_match(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, best, score): for each query set (key, runs) the corpus set of highest Jaccard; ties to the least key.

    Only sets with a common run can score; queries without any have no row. The query set is the stated, small side;
    counting shared runs combines before the shuffle.
    """
    q = queries.select("key", F.size("runs").alias("n_q"), F.explode("runs").alias("run"))
    c = corpus.select(F.col("key").alias("other"), F.size("runs").alias("n_c"), F.explode("runs").alias("run"))
    shared = c.join(q, "run").groupBy("key", "n_q", "other", "n_c").agg(F.count(F.lit(1)).alias("i"))
    scored = shared.select("key", "other", (F.col("i") / (F.col("n_q") + F.col("n_c") - F.col("i"))).alias("score"))
    best = scored.groupBy("key").agg(F.max("score").alias("score"))
    return scored.join(best, ["key", "score"]).groupBy("key", "score").agg(F.min("other").alias("best")).select("key", "best", "score")
