"""Queries over slice records and the source manifest: families, splits, offsets, review samples, selection, summaries, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import dedup
from siltstone.operators.ranking import permuted_rank, running_total
from siltstone.plans.staging import Stage
from siltstone.sources.tables import label, table

SLICE, MANIFEST = "build_stage_a_250k_slice", "stage_a_sources_v1_candidate"
VALIDATION, SEED, REVIEW_ROWS = 0.1, 11, 8
COLUMNS = ("record_id", "source_id", "group_id", "family_id", "selection_score", "token_count_proxy", "normalized_sha256", "template_sha256", "simhash64", "actual_token_count")


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the latest loaded, `source_id` trimmed in lower case, families as they are."""
    rows = table(spark, d, SLICE, *COLUMNS, "loaded_at", "retrieved_at").where("record_id is not null")
    cols = [c for c in COLUMNS if c != "record_id"]
    last = rows.groupBy("record_id").agg(F.max(F.struct("loaded_at", "retrieved_at", *cols)).alias("r"))
    return last.select("record_id", *[label(f"r.{c}").alias(c) if c == "source_id" else F.col(f"r.{c}").alias(c) for c in cols])


def latest_sources(manifest: DataFrame) -> DataFrame:
    """(source_id, target_tokens, max_repeats) of the latest row of each source, its name trimmed in lower case."""
    latest = F.max(F.struct("recorded_at", "target_tokens", "max_repeats")).alias("l")
    named = manifest.withColumn("source_id", label("source_id")).where(F.col("source_id").isNotNull())
    return named.groupBy("source_id").agg(latest).select("source_id", "l.target_tokens", "l.max_repeats")


def shared_rank(*parts) -> Column:
    """A 60-bit rank from seed and key parts that any engine can compute."""
    text = F.concat_ws("\x1f", *[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def family_groups(spark, d):
    """Members of each family as one sorted hash, with their number; families stay rows, members are not gathered."""
    rows = table(spark, d, SLICE, "record_id", "family_id").where("family_id is not null and record_id is not null").distinct()
    return rows.groupBy("family_id").agg(F.count(F.lit(1)).alias("members"), F.min("record_id").alias("first_member"), F.max("record_id").alias("last_member"))


def family_sizes(spark, d):
    """Each record with the number of records of its family."""
    r = records(spark, d).select("record_id", "family_id")
    n = r.groupBy("family_id").agg(F.count(F.lit(1)).alias("family_size"))
    return r.join(n, r["family_id"].eqNullSafe(n["family_id"])).select("record_id", "family_size")


def family_split(spark, d):
    """(source_id, family, split): per source, families in seeded order go to validation while its tokens so far are
    under a tenth of the source's; a source of one family stays in training."""
    r = records(spark, d).where("source_id is not null")
    fam = Stage(spark, "families").put(r.groupBy("source_id", F.coalesce("family_id", "record_id").alias("family")).agg(F.sum(F.coalesce("actual_token_count", F.lit(0))).alias("tokens")).withColumn("rank", shared_rank(str(SEED), F.col("source_id"), F.col("family"))), "sums")
    totals = fam.groupBy("source_id").agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("families"))
    placed = running_total(fam, ["source_id"], "rank", ["family"], "tokens", "before").join(totals, "source_id")
    taken = (F.col("families") >= 2) & (F.col("before") < F.greatest(F.lit(1), F.bround(F.col("all") * VALIDATION)))
    return placed.select("source_id", "family", F.when(taken, "validation").otherwise("train").alias("split"))


def token_offsets(spark, d):
    """(split, record_id, token_offset, token_count): where each record starts in its split's stream of tokens, in
    seeded order. The offset is a prefix sum over ranges, not over one sorted task."""
    r = records(spark, d).where("source_id is not null").select("record_id", "source_id", F.coalesce("family_id", "record_id").alias("family"), F.coalesce("actual_token_count", F.lit(0)).alias("token_count"))
    s = r.join(family_split(spark, d), ["source_id", "family"]).select("split", "record_id", "token_count").withColumn("rank", shared_rank(str(SEED), F.col("record_id")))
    rows = Stage(spark, "offsets").put(s, "rows")
    return running_total(rows, ["split"], "rank", ["record_id"], "token_count", "token_offset").select("split", "record_id", "token_offset", "token_count")


def review_even(spark, d):
    """Up to eight records per source, evenly spaced by size; places are whole-number positions of a global rank."""
    r = records(spark, d).where("source_id is not null and token_count_proxy is not null").select("record_id", "source_id", "token_count_proxy")
    rows = Stage(spark, "even").put(r, "rows")
    ranked = permuted_rank(rows, ["source_id"], "token_count_proxy", ["record_id"], "rank")
    n = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    k = REVIEW_ROWS - 1
    step = F.col("rank") - 1
    at = F.exists(F.sequence(F.lit(0), F.lit(k)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(k)) == step)
    return ranked.join(n, "source_id").where((F.col("n") <= REVIEW_ROWS) | at).select("source_id", "record_id", "rank")


def review_round_robin(spark, d, size: int = 40):
    """The first `size` records when groups take turns, each in the order of its ids."""
    r = records(spark, d).where("group_id is not null").select("record_id", "group_id")
    ranked = r.withColumn("turn", F.row_number().over(Window.partitionBy("group_id").orderBy("record_id"))).where(F.col("turn") <= size)
    return ranked.orderBy("turn", "group_id").limit(size).select("record_id", "group_id", "turn")


def _prints(spark, d, *more) -> DataFrame:
    r = records(spark, d)
    return r.select(F.col("record_id").alias("id"), *more, F.col("normalized_sha256").alias("exact"), F.col("template_sha256").alias("template"), F.when(F.length("simhash64") == 16, dedup.hex_long("simhash64")).alias("sim"), F.coalesce("token_count_proxy", F.lit(0)).alias("tokens"))


def band_near(spark, d):
    """(id_a, id_b, verdict) of records that share a fingerprint band and are near; copies by hash stand for one."""
    stage = Stage(spark, "near")
    p = _prints(spark, d).where("exact is not null")
    heads = stage.put(p.groupBy("exact").agg(F.min_by(F.struct("id", "template", "sim", "tokens"), "id").alias("f")).select("exact", "f.*"), "heads")
    return dedup.band_pairs(stage, heads)


def keep_first_dedup(spark, d):
    """The verdict of ordered keep-first de-duplication for each record: keep, review or reject, and beside which."""
    return dedup.keep_first(spark, _prints(spark, d))


def ranked_select(spark, d):
    """Records taken per source by score, size and id, under the source's whole token target and one record a family,
    without copies or near copies of records taken before in any source. Sources go in the order of their names."""
    quotas = {r["source_id"]: int(r["target_tokens"]) for r in latest_sources(table(spark, d, MANIFEST)).where("target_tokens is not null").collect()}
    rows = _prints(spark, d, "source_id", F.col("family_id").alias("family"), "selection_score").where("source_id is not null")
    return dedup.greedy_unique(spark, rows, "source_id", [-F.coalesce("selection_score", F.lit(0)), F.coalesce("tokens", F.lit(0)), F.col("id")], quotas, 1)


def candidate_exclusions(spark, d, least: int = 80, most: int = 400):
    """Records of a pool by the first rule that excludes them: group, copy, size; the rest are candidates."""
    r = records(spark, d)
    first = r.where("normalized_sha256 is not null").groupBy("normalized_sha256").agg(F.min("record_id").alias("first"))
    j = r.join(first, "normalized_sha256", "left")
    n = F.col("actual_token_count")
    why = F.when(F.col("group_id").isNull(), "group_not_allowed").when(F.col("record_id") > F.col("first"), "exact_duplicate").when(F.coalesce(n, F.lit(0)) < least, "record_too_short").when(n > most, "record_too_long").otherwise("candidate")
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(n, F.lit(0))).alias("tokens"))


def group_totals(spark, d):
    """Records, tokens and families per group and source, with totals."""
    r = records(spark, d)
    return r.rollup("group_id", "source_id").agg(F.count(F.lit(1)).alias("records"), F.sum("actual_token_count").alias("tokens"), F.countDistinct("family_id").alias("families"), F.grouping_id().alias("level"))


def source_summary(spark, d):
    """Every planned source with what the slice has of it; sources without records are named so."""
    have = records(spark, d).where("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.sum("actual_token_count").alias("tokens"))
    j = latest_sources(table(spark, d, MANIFEST)).join(have, "source_id", "left")
    return j.select("source_id", "target_tokens", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("records").isNull(), "without_records").otherwise("present").alias("state"), F.round(F.try_divide("tokens", "target_tokens"), 9).alias("ratio"))


def manifest_digest(spark, d):
    """One digest of a source's records as a multiset of ids and hashes: four numbers from each, added up and
    folded by exclusive or, with their number. Equal rows do not cancel, and no list is gathered."""
    r = records(spark, d).where("source_id is not null").select("source_id", F.sha2(F.concat_ws("\x1f", "record_id", F.coalesce("normalized_sha256", F.lit("-"))), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("long")
    folds = [F.bit_xor(part(i)).alias(f"digest_{i}") for i in range(4)] + [F.sum(part(i).cast("decimal(38,0)")).cast("string").alias(f"sum_{i}") for i in range(4)]
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), *folds)


def verify_checks(spark, d):
    """(check, bad): how many rows break each rule of a finished slice."""
    s = table(spark, d, SLICE, *COLUMNS)
    row = s.agg(
        F.count_if(F.col("record_id").isNull()).alias("record_without_id"), F.count_if(F.col("family_id").isNull()).alias("record_without_family"), F.count_if(F.col("source_id").isNull()).alias("record_without_source"),
        F.count_if(F.col("normalized_sha256").isNull() | ~F.col("normalized_sha256").rlike("^[0-9a-f]{64}$")).alias("bad_normalized_hash"), F.count_if(F.col("template_sha256").isNull() | ~F.col("template_sha256").rlike("^[0-9a-f]{64}$")).alias("bad_template_hash"),
        F.count_if(F.col("simhash64").isNull() | ~F.col("simhash64").rlike("^[0-9a-f]{16}$")).alias("bad_simhash"), F.count_if(F.coalesce("actual_token_count", F.lit(0)) <= 0).alias("no_tokens"),
    )
    repeats = s.where("record_id is not null").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_record"))
    copies = records(spark, d).where("normalized_sha256 is not null").groupBy("normalized_sha256").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surviving_exact_copy"))
    unknown = s.select(label("source_id").alias("source_id")).where("source_id is not null").join(latest_sources(table(spark, d, MANIFEST)), "source_id", "left_anti").agg(F.count(F.lit(1)).alias("source_not_in_manifest"))
    wide = row.crossJoin(repeats).crossJoin(copies).crossJoin(unknown)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("bad")) for c in wide.columns])).alias("x")).select("x.*")


def metric_extremes(spark, d):
    """Per event type the user and value of its best and its least value, their gap, and a warning where it is wide."""
    e = table(spark, d, "events", "event_id", "event_type", "value").where("value is not null")
    g = e.groupBy("event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("least_event"), F.max_by("event_id", F.struct("value", "event_id")).alias("most_event"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    return g.withColumn("gap", F.round(F.col("most") - F.col("least"), 6)).withColumn("wide", F.col("most") > F.col("least") + 0.15)


def set_operations(spark, d):
    """Sizes of intersection, both differences and union of the manifest's and the slice's source names."""
    a = latest_sources(table(spark, d, MANIFEST)).select("source_id").distinct()
    b = table(spark, d, SLICE, "source_id").select(label("source_id").alias("source_id")).where("source_id is not null").distinct()
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "source_id", "full_outer")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("manifest_only"), F.count_if(F.col("a").isNull()).alias("slice_only"), F.count(F.lit(1)).alias("union_size"))


def learning_rates(spark, d):
    """Warm-up and cosine schedule at each hundredth step."""
    steps = spark.range(0, 2001, 100).select(F.col("id").alias("step"))
    p = (F.col("step") - 100) / 1900
    rate = F.when(F.col("step") <= 100, F.lit(0.0003) * F.col("step") / 100).otherwise(F.lit(0.00003) + 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))) * (0.0003 - 0.00003))
    return steps.select("step", F.round(rate, 9).alias("rate"))


_REC = f"""(SELECT record_id, lower(trim(r.source_id)) AS source_id, {', '.join(f'r.{c} AS {c}' for c in COLUMNS if c not in ('record_id', 'source_id'))} FROM (SELECT record_id, max({{'a': loaded_at, 'b': retrieved_at, {', '.join(f"'{c}': {c}" for c in COLUMNS if c != 'record_id')}}}) AS r FROM {SLICE} WHERE record_id IS NOT NULL GROUP BY record_id))"""
_SRC = f"(SELECT s AS source_id, x.t AS target_tokens, x.r AS max_repeats FROM (SELECT lower(trim(source_id)) AS s, arg_max({{'t': target_tokens, 'r': max_repeats}}, recorded_at) AS x FROM {MANIFEST} WHERE source_id IS NOT NULL GROUP BY 1))"
_RANK = lambda *parts: "('0x' || substr(md5(" + " || chr(31) || ".join(parts) + "), 1, 15))::UBIGINT::BIGINT"
_SPLIT = f"""(SELECT source_id, family, CASE WHEN families >= 2 AND before < greatest(1, round_even("all" * 0.1, 0)) THEN 'validation' ELSE 'train' END AS split FROM (SELECT source_id, family, coalesce(sum(tokens) OVER (PARTITION BY source_id ORDER BY {_RANK("'11'", 'source_id', 'family')}, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(tokens) OVER (PARTITION BY source_id) AS "all", count(*) OVER (PARTITION BY source_id) AS families FROM (SELECT source_id, coalesce(family_id, record_id) AS family, sum(coalesce(actual_token_count, 0)) AS tokens FROM {_REC} WHERE source_id IS NOT NULL GROUP BY 1, 2)))"""
_SIM = lambda x: f"('0x' || {x})::UBIGINT"
_TRY_XOR = f"bit_count(xor({_SIM('a.simhash64')}, {_SIM('b.simhash64')})::BIT)"
SQL = {
    "family_groups": f"SELECT family_id, count(*) AS members, min(record_id) AS first_member, max(record_id) AS last_member FROM (SELECT DISTINCT record_id, family_id FROM {SLICE} WHERE family_id IS NOT NULL AND record_id IS NOT NULL) GROUP BY family_id",
    "family_sizes": f"SELECT record_id, count(*) OVER (PARTITION BY family_id) AS family_size FROM {_REC}",
    "family_split": f"SELECT * FROM {_SPLIT}",
    "token_offsets": f"WITH r AS (SELECT s.split, record_id, coalesce(actual_token_count, 0) AS token_count FROM {_REC} r JOIN {_SPLIT} s ON r.source_id = s.source_id AND coalesce(r.family_id, r.record_id) = s.family) SELECT split, record_id, coalesce(sum(token_count) OVER (PARTITION BY split ORDER BY {_RANK(chr(39) + '11' + chr(39), 'record_id')}, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset, token_count FROM r",
    "review_even": f"WITH r AS (SELECT record_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY token_count_proxy, record_id) AS rank, count(*) OVER (PARTITION BY source_id) AS n FROM {_REC} WHERE source_id IS NOT NULL AND token_count_proxy IS NOT NULL) SELECT source_id, record_id, rank FROM r WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: round_even(i * (n - 1) / 7, 0)::BIGINT), rank - 1)",
    "review_round_robin": f"SELECT record_id, group_id, turn FROM (SELECT record_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY record_id) AS turn FROM {_REC} WHERE group_id IS NOT NULL) ORDER BY turn, group_id LIMIT 40",
    "band_near": f"""WITH h AS (SELECT normalized_sha256, arg_min({{'record_id': record_id, 'template_sha256': template_sha256, 'simhash64': simhash64, 'tokens': coalesce(token_count_proxy, 0)}}, record_id) AS x FROM {_REC} WHERE normalized_sha256 IS NOT NULL GROUP BY 1), r AS (SELECT normalized_sha256, x.record_id AS record_id, x.template_sha256 AS template_sha256, x.simhash64 AS simhash64, x.tokens AS tokens FROM h WHERE length(x.simhash64) = 16 AND x.tokens >= 40),
  k AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM r), b AS (SELECT *, substr(simhash64, 1 + 4 * i, 4) AS v FROM k),
  p AS (SELECT DISTINCT a.record_id AS id_a, b.record_id AS id_b, a.tokens AS n, greatest(a.tokens, b.tokens) / least(a.tokens, b.tokens) AS ratio, {_TRY_XOR} AS distance, coalesce(a.template_sha256 = b.template_sha256, false) AS same FROM b a JOIN b ON a.i = b.i AND a.v = b.v AND a.record_id > b.record_id)
  SELECT id_a, id_b, CASE WHEN same OR (n >= 60 AND ratio <= 1.2 AND distance <= 3) THEN 'reject' ELSE 'review' END AS verdict FROM p WHERE ratio <= 1.35 AND distance <= 6""",
    "candidate_exclusions": f"WITH r AS (SELECT *, CASE WHEN normalized_sha256 IS NOT NULL THEN min(record_id) OVER (PARTITION BY normalized_sha256) END AS first FROM {_REC}) SELECT CASE WHEN group_id IS NULL THEN 'group_not_allowed' WHEN record_id > first THEN 'exact_duplicate' WHEN coalesce(actual_token_count, 0) < 80 THEN 'record_too_short' WHEN actual_token_count > 400 THEN 'record_too_long' ELSE 'candidate' END AS reason, count(*) AS records, sum(coalesce(actual_token_count, 0))::BIGINT AS tokens FROM r GROUP BY 1",
    "group_totals": f"SELECT group_id, source_id, count(*) AS records, sum(actual_token_count)::BIGINT AS tokens, count(DISTINCT family_id) AS families, grouping(group_id, source_id) AS level FROM {_REC} GROUP BY ROLLUP (group_id, source_id)",
    "source_summary": f"WITH h AS (SELECT source_id, count(*) AS records, sum(actual_token_count) AS tokens FROM {_REC} WHERE source_id IS NOT NULL GROUP BY 1) SELECT source_id, target_tokens, coalesce(records, 0) AS records, coalesce(tokens, 0)::BIGINT AS tokens, CASE WHEN records IS NULL THEN 'without_records' ELSE 'present' END AS state, round(tokens / nullif(target_tokens, 0), 9) AS ratio FROM {_SRC} LEFT JOIN h USING (source_id)",
    "manifest_digest": f"SELECT source_id, count(*) AS records, " + ", ".join(f"bit_xor(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::BIGINT) AS digest_{i}, sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::HUGEINT)::VARCHAR AS sum_{i}" for i in range(4)) + f" FROM (SELECT source_id, sha256(record_id || chr(31) || coalesce(normalized_sha256, '-')) AS h FROM {_REC} WHERE source_id IS NOT NULL) GROUP BY source_id",
    "verify_checks": f"""SELECT 'record_without_id' AS "check", count(*) FILTER (record_id IS NULL) AS bad FROM {SLICE} UNION ALL SELECT 'record_without_family', count(*) FILTER (family_id IS NULL) FROM {SLICE} UNION ALL SELECT 'record_without_source', count(*) FILTER (source_id IS NULL) FROM {SLICE}
  UNION ALL SELECT 'bad_normalized_hash', count(*) FILTER (normalized_sha256 IS NULL OR NOT regexp_matches(normalized_sha256, '^[0-9a-f]{{64}}$')) FROM {SLICE} UNION ALL SELECT 'bad_template_hash', count(*) FILTER (template_sha256 IS NULL OR NOT regexp_matches(template_sha256, '^[0-9a-f]{{64}}$')) FROM {SLICE}
  UNION ALL SELECT 'bad_simhash', count(*) FILTER (simhash64 IS NULL OR NOT regexp_matches(simhash64, '^[0-9a-f]{{16}}$')) FROM {SLICE} UNION ALL SELECT 'no_tokens', count(*) FILTER (coalesce(actual_token_count, 0) <= 0) FROM {SLICE}
  UNION ALL SELECT 'repeated_record', count(record_id) - count(DISTINCT record_id) FROM {SLICE} UNION ALL SELECT 'surviving_exact_copy', count(normalized_sha256) - count(DISTINCT normalized_sha256) FROM {_REC} UNION ALL SELECT 'source_not_in_manifest', count(*) FROM {SLICE} WHERE source_id IS NOT NULL AND lower(trim(source_id)) NOT IN (SELECT source_id FROM {_SRC})""",
    "metric_extremes": "SELECT event_type, arg_min(event_id, {'v': value, 'e': event_id}) AS least_event, arg_max(event_id, {'v': value, 'e': event_id}) AS most_event, round(min(value), 6) AS least, round(max(value), 6) AS most, round(round(max(value), 6) - round(min(value), 6), 6) AS gap, round(max(value), 6) > round(min(value), 6) + 0.15 AS wide FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "set_operations": f"WITH a AS (SELECT DISTINCT source_id FROM {_SRC}), b AS (SELECT DISTINCT lower(trim(source_id)) AS source_id FROM {SLICE} WHERE source_id IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS manifest_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS slice_only, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS union_size",
    "learning_rates": "SELECT s AS step, round(CASE WHEN s <= 100 THEN 0.0003::DOUBLE * s / 100 ELSE 0.00003::DOUBLE + 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (s - 100)::DOUBLE / 1900)))) * (0.0003::DOUBLE - 0.00003::DOUBLE) END, 9) AS rate FROM range(0, 2001, 100) t(s)",
}
QUERIES = {k: globals()[k] for k in SQL} | {"keep_first_dedup": keep_first_dedup, "ranked_select": ranked_select}
