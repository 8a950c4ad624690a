"""Near-duplicate records by pigeonhole blocks over sparse fingerprints, with an exact Hamming check.

A record's fingerprint is the bit vector, over all 3-word runs there are, with a one for each run it holds; stored are
the positions of the ones. Two fingerprints A and B have Jaccard similarity ≥ 0.6 exactly if their Hamming distance
is at most (|A| + |B|) / 4, and then each lacks at most k = |A| − ⌈0.6 |A|⌉ of A's ones. Split k + 1 one-bit blocks off
A: by the pigeonhole principle one of them agrees. Taking the rarest ones in both records keeps the principle (the
first common one in that order stands in both prefixes) and keeps blocks small. Ones that no other record has can
never agree, so they use up k without a block, and most records of a varied corpus drop out there. No link is missed.
Of two records the smaller needs only a block of the first |B| − ⌈0.75 |B|⌉ + 1 ones, which saves candidates.

Bytes on disk decide at scale. Each one is shuffled once, as (run, row number); how many records hold it is counted
where it arrives. Runs that a large part of all records hold would make hot tasks there: a sample by hash names them, a
list of bounded length, and only their order is taken from it, never a decision. After that only the ones that two
records share go on, and the Hamming check needs no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import window_hashes
from siltstone.operators.components import connected_components
from siltstone.plans.staging import Stage

RUN = 3
NUMERATOR, DENOMINATOR = 3, 5  # similarity of at least 3/5
#: Positions of ones are hashes of so many bits; the bits above hold how many records have a one, up to MOST_DF.
POSITION_BITS, MOST_DF = 48, (1 << 15) - 1
#: Hot runs: held by 1 / HOT_PART of a sample of one record in SAMPLE_PART. There are at most HOT_PART × the mean number
#: of runs of them, at any size. A sample under LEAST_SAMPLE records names none, as no task is large then.
SAMPLE_PART, HOT_PART, LEAST_SAMPLE = 64, 200, 400


def words(text: Column) -> Column:
    """The lower-cased text with one space for all between its runs of a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _texts(accepted: DataFrame) -> DataFrame:
    """(id, received_at, words, fp) of each row with an id; fp identifies the sequence of words."""
    text = F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n"), F.coalesce("answer", F.lit("")))
    return accepted.where("id is not null").select("id", "received_at", words(text).alias("words")).withColumn("fp", F.xxhash64(F.length("words"), "words"))


def record_classes(stage: Stage, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, row) of records with at least one run, and classes (row, n, runs): one per sequence of words.

    The latest row of an id counts. Texts are shuffled once, by class; ids travel with hashes only.
    """
    texts = _texts(accepted)
    latest = stage.put(texts.groupBy("id").agg(F.max(F.struct("received_at", "fp")).alias("l")).select("id", F.col("l.fp").alias("fp")), "latest")
    alive = latest.select("fp").distinct()
    one = texts.select("fp", "words").groupBy("fp").agg(F.min("words").alias("words")).join(alive, "fp", "left_semi")
    place = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    runs = one.select("fp", F.split("words", " ").alias("w")).select("fp", F.transform(window_hashes(F.col("w"), RUN), place).alias("runs"))
    classes = stage.put(runs.where("size(runs) > 0").withColumn("row", F.monotonically_increasing_id()), "classes")
    members = stage.put(latest.join(classes.select("fp", "row"), "fp").select("id", "row"), "members")
    return members, classes.select("row", F.size("runs").alias("n"), "runs")


def _least_common(n: Column) -> Column:
    """⌈0.6 n⌉: the ones of a fingerprint of size n that any partner must have."""
    return F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR)


def _shared_runs(stage: Stage, classes: DataFrame) -> DataFrame:
    """(row, one) of the runs that at least two classes hold; `one` is the run below the number of its classes, so it
    orders runs from the rarest on, the same for all that hold one."""
    sample = classes.where(F.pmod(F.xxhash64(F.lit(41), "row"), F.lit(SAMPLE_PART)) == 0)
    size = sample.count()
    counted = sample.select(F.explode("runs").alias("run")).groupBy("run").agg((F.count(F.lit(1)) * SAMPLE_PART).alias("df"))
    hot = stage.put(counted.where(F.col("df") >= F.lit(max(size, LEAST_SAMPLE) * SAMPLE_PART // HOT_PART)), "hot")
    ones = classes.select("row", F.explode("runs").alias("run"))
    marked = ones.join(F.broadcast(hot), "run", "left")
    rare = marked.where("df is null").select("row", "run")
    often = rare.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("run"))).where("df > 1")
    both = often.union(marked.where("df is not null").select("row", "run", "df"))
    return both.select("row", F.shiftleft(F.least("df", F.lit(MOST_DF)), POSITION_BITS).bitwiseOR(F.col("run")).alias("one"))


def near_pairs(stage: Stage, classes: DataFrame) -> DataFrame:
    """(row_a, row_b), row_a < row_b, of different classes (row, n, runs) whose similarity is at least 0.6."""
    # Per record, the shared ones, rarest first. A record has few ones, so sorting its array is local work.
    own = _shared_runs(stage, classes).groupBy("row").agg(F.sort_array(F.collect_list("one")).alias("common"))
    sized = own.join(classes.select("row", "n"), "row").select("row", "n", "common")
    n, absent = F.col("n"), F.col("n") - F.size("common")
    spare = n - _least_common(n) - absent
    # Of the smaller of two records ⌈0.75 n⌉ ones must be common: 2t / (1 + t) of n for a similarity t of 3/5.
    spare_least = n - F.ceil(n * 3 / 4) - absent
    kept = stage.put(sized.withColumn("spare", spare).withColumn("spare_least", spare_least).where("spare >= 0"), "kept")
    blocks = kept.select("row", "n", "spare_least", F.posexplode(F.slice("common", F.lit(1), (F.col("spare") + 1).cast("int"))).alias("at", "run"))
    blocks = stage.put(blocks.select("run", "row", "n", (F.col("at") <= F.col("spare_least")).alias("first")), "blocks")
    a, b = blocks.alias("a"), blocks.where("first").alias("b")
    larger = (F.col("a.n") > F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.row") > F.col("b.row"))
    near = F.col("b.n") * DENOMINATOR >= F.col("a.n") * NUMERATOR
    met = a.join(b, (F.col("a.run") == F.col("b.run")) & larger & near).select(F.least("a.row", "b.row").alias("row_a"), F.greatest("a.row", "b.row").alias("row_b"))
    candidates = stage.put(met.distinct(), "candidates")
    # Ones that no other record has count in n and never agree, so the shared ones give the exact distance.
    left = kept.select(F.col("row").alias("row_a"), F.col("n").alias("n_a"), F.col("common").alias("c_a"))
    right = kept.select(F.col("row").alias("row_b"), F.col("n").alias("n_b"), F.col("common").alias("c_b"))
    both = candidates.join(left, "row_a").join(right, "row_b")
    hamming = F.col("n_a") + F.col("n_b") - 2 * F.size(F.array_intersect("c_a", "c_b"))
    return both.where(hamming * 4 <= F.col("n_a") + F.col("n_b")).select("row_a", "row_b")


def similar(spark: SparkSession, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, row) and pairs of classes (row_a, row_b); records with equal sequences of words form one class.

    Null or empty texts have no runs and no partner; repeated rows of an id count once (the latest; of equal times one
    and the same). An empty table gives no rows.
    """
    stage = Stage(spark, "neardup")
    members, classes = record_classes(stage, accepted)
    return members, stage.put(near_pairs(stage, classes), "pairs")


def similar_ids(spark: SparkSession, accepted: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two ids whose similarity is at least 0.6, copies included."""
    members, pairs = similar(spark, accepted)
    one, two = members.select(F.col("row").alias("row_a"), F.col("id").alias("x")), members.select(F.col("row").alias("row_b"), F.col("id").alias("y"))
    across = pairs.join(one, "row_a").join(two, "row_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = members.groupBy("row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("row")
    copies = members.join(many, "row")
    within = copies.select("row", F.col("id").alias("id_a")).join(copies.select("row", F.col("id").alias("id_b")), "row").where("id_a < id_b").select("id_a", "id_b")
    return across.union(within)


def similar_groups(spark: SparkSession, accepted: DataFrame) -> DataFrame:
    """(id, copies, links, group_id): one row per id that has a copy or a link; links count other classes, copies the
    ids of its own class, group_id is the least id reachable over links and copies."""
    members, pairs = similar(spark, accepted)
    links = pairs.select(F.col("row_a").alias("row")).union(pairs.select(F.col("row_b").alias("row"))).groupBy("row").agg(F.count(F.lit(1)).alias("links"))
    parts = connected_components(spark, pairs.select(F.col("row_a").alias("u"), F.col("row_b").alias("v")))
    sizes = members.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    info = sizes.join(links, "row", "left").where("copies > 1 or links is not null").join(parts.withColumnRenamed("node", "row"), "row", "left")
    info = info.select("row", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "row").alias("component"))
    rows = Stage(spark, "groups").put(members.join(info, "row"), "rows")
    least = rows.groupBy("component").agg(F.min("id").alias("group_id"))
    return rows.join(least, "component").select("id", "copies", "links", "group_id")
