"""Queries of the language-model text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import junk, leaks, mixing, neardup, packing, pairs, sampling, splits, tokens
from siltstone.sources.tables import table

INVENTORY, HELDOUT, ACCEPTED = "phase3_5b_record_inventory", "phase3_5b_heldout_v1", "phase3_5b_batch07_accepted"
SLICE, MANIFEST, TARGETS = "build_stage_a_250k_slice", "stage_a_sources_v1_candidate", "phase3_5b_sample_targets"
SLICE_LINKS = ("record_id", "family_id", "normalized_sha256")
MIX_COLUMNS = ("record_id", "source_id", "actual_token_count")
PAIR_COLUMNS = ("id", "received_at", "instruction", "answer", "bad_code")
INVENTORY_COLUMNS = ("record_id", "audited_at", "full_record_tokens", "rendered", "source_kind", "language", "category")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(spark, table(spark, d, ACCEPTED, *PAIR_COLUMNS))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_counts(spark, table(spark, d, ACCEPTED, *PAIR_COLUMNS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_families(spark, table(spark, d, SLICE, *SLICE_LINKS))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(spark, table(spark, d, SLICE, *SLICE_LINKS))


def p2_split_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = p2_splits(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    return rows.crossJoin(rows.agg(F.sum("records").alias("all"))).select("split", "records", "components", (F.col("records") / F.col("all")).alias("share"))


def p2_split_checks(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_checks(spark, table(spark, d, SLICE, *SLICE_LINKS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return tokens.wrong_counts(table(spark, d, INVENTORY, *INVENTORY_COLUMNS))


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, INVENTORY, *INVENTORY_COLUMNS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    report = sampling.cell_report(spark, table(spark, d, ACCEPTED, "id", "received_at", *sampling.LEVELS), table(spark, d, TARGETS))
    return report.where("supply < wanted").select(*sampling.LEVELS).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cell_report(spark, table(spark, d, ACCEPTED, "id", "received_at", *sampling.LEVELS), table(spark, d, TARGETS))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_targets(spark, table(spark, d, ACCEPTED, "id", "received_at", *sampling.LEVELS), table(spark, d, TARGETS))


def p4_supply(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).select(*sampling.LEVELS, F.round("wanted", 6).alias("wanted"), "supply", F.round("unmet", 6).alias("unmet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_ids(spark, table(spark, d, ACCEPTED, "id", "instruction", "answer", "received_at"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(spark, table(spark, d, ACCEPTED, "id", "instruction", "answer", "received_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(spark, table(spark, d, SLICE, *MIX_COLUMNS), table(spark, d, MANIFEST))
    return plan.where("wanted > cap").select("source_id")


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(spark, table(spark, d, SLICE, *MIX_COLUMNS), table(spark, d, MANIFEST))
    return plan.select("source_id", "target_tokens", "max_repeats", "supply", F.round("wanted", 3).alias("wanted"), "cap", "blocks")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(spark, table(spark, d, SLICE, *MIX_COLUMNS), table(spark, d, MANIFEST))


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(spark, table(spark, d, SLICE, *MIX_COLUMNS), table(spark, d, MANIFEST))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_texts(spark, table(spark, d, "documents", "doc_id", "text"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(spark, table(spark, d, "documents", "doc_id", "text"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(spark, table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(spark, table(spark, d, "documents", "doc_id", "text"), table(spark, d, HELDOUT, "id", "prompt"))
    return found.select("doc_id", "eval_id").distinct()


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, d, "documents", "doc_id", "text"), table(spark, d, HELDOUT, "id", "prompt"))


def p8_overlap(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.shared_runs(spark, table(spark, d, "documents", "doc_id", "text"), table(spark, d, HELDOUT, "id", "prompt"))
    return found.select("doc_id", "eval_id", F.col("runs").cast("long").alias("runs"), F.col("prompt_runs").cast("long").alias("prompt_runs"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.clean_documents(spark, table(spark, d, "documents", "doc_id", "text"), table(spark, d, HELDOUT, "id", "prompt")).select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return junk.junk_pages(spark, table(spark, d, "documents", "doc_id", "text", "source"))


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    return junk.page_evidence(spark, table(spark, d, "documents", "doc_id", "text", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p2_found, p2_splits, p2_split_shares, p2_split_checks, p3_found, p3_budget, p4_found, p4_supply, p4_report, p4_sample, p5_found, p5_groups,
        p6_found, p6_plan, p6_report, p6_mix, p7_found, p7_containers, p7_fill, p8_found, p8_matches, p8_overlap, p8_clean, p9_found, p9_evidence,
    )
}


def _count(column: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{tokens.LEXICAL}'))"


_KEY = r"""lower(regexp_replace(family_id, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"""
_LATEST = f"""
WITH l AS (SELECT record_id, max({{'at': audited_at, 'stated': full_record_tokens, 'n': {_count("rendered")}, 'source_kind': lower(trim(source_kind)), 'language': lower(trim(language)), 'category': lower(trim(category))}}) AS x
  FROM {INVENTORY} WHERE record_id IS NOT NULL GROUP BY record_id)"""
_RUNS = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS w FROM phase3_5b_heldout_v1 WHERE prompt IS NOT NULL),
er AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS r FROM e, range(1, len(w) - 3) t(i)),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS r FROM w, range(1, len(w) - 3) t(i)),
n AS (SELECT id, count(*) AS n FROM er GROUP BY id),
f AS (SELECT doc_id, id AS eval_id, count(*) AS runs, any_value(n.n) AS n FROM dr JOIN er USING (r) JOIN n USING (id) GROUP BY doc_id, id)"""

SQL: dict[str, str] = {
    "p2_found": rf"""
WITH RECURSIVE t AS (SELECT family_id, record_id, normalized_sha256, {_KEY} AS k FROM build_stage_a_250k_slice WHERE family_id IS NOT NULL),
p AS (SELECT *, regexp_extract(k, '([^:/|]*)$', 1) AS last, regexp_replace(k, '[^:/|]*$', '') AS head FROM t),
n AS (SELECT family_id, record_id, normalized_sha256, regexp_replace(head || regexp_replace(regexp_replace(last, '^[^\p{{L}}\p{{N}}]*tests?[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+tests?[^\p{{L}}\p{{N}}]*$', ''), '[^\p{{L}}\p{{N}}]+', '', 'g') AS f FROM p),
keys AS (SELECT DISTINCT f, 'r' || record_id AS k FROM n WHERE record_id IS NOT NULL UNION SELECT DISTINCT f, 's' || normalized_sha256 FROM n WHERE normalized_sha256 IS NOT NULL),
many AS (SELECT k FROM keys GROUP BY k HAVING count(*) > 1),
e AS (SELECT DISTINCT a.f AS u, b.f AS v FROM keys a JOIN keys b USING (k) WHERE k IN (SELECT k FROM many) AND a.f <> b.f),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
comp AS (SELECT u AS f, least(u, min(v)) AS c FROM reach GROUP BY u),
m AS (SELECT DISTINCT n.family_id, coalesce(comp.c, n.f) AS c FROM n LEFT JOIN comp ON n.f = comp.f)
SELECT a.family_id AS family_a, b.family_id AS family_b FROM m a JOIN m b ON a.c = b.c AND a.family_id < b.family_id""",
    "p4_found": f"""
WITH a AS (SELECT id, arg_max({{'l': lower(trim(language)), 'c': lower(trim(category)), 'd': lower(trim(difficulty))}}, received_at) AS x FROM phase3_5b_batch07_accepted WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT x.l AS l, x.c AS c, x.d AS d, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT count(*) // 5 AS s FROM a)
SELECT DISTINCT t.language, t.category, t.difficulty FROM phase3_5b_sample_targets t CROSS JOIN s
LEFT JOIN n ON lower(trim(t.language)) = n.l AND lower(trim(t.category)) = n.c AND lower(trim(t.difficulty)) = n.d
WHERE coalesce(n.n, 0) < greatest(coalesce(t.target_share, 0) * s.s, coalesce(t.min_records, 0))""",
    "p5_found": """
WITH r AS (SELECT id, regexp_extract_all(lower(arg_max(coalesce(instruction, '') || chr(10) || coalesce(answer, ''), received_at)), '[a-z0-9]+') AS w
  FROM phase3_5b_batch07_accepted WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM r, range(1, len(w) - 1) t(i)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT x AS id_a, y AS id_b FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE i * 5 >= (p.n + q.n - i) * 3""",
    "p6_found": """
WITH m AS (SELECT lower(trim(source_id)) AS s, arg_max({'t': target_tokens, 'r': max_repeats}, recorded_at) AS x FROM stage_a_sources_v1_candidate WHERE source_id IS NOT NULL GROUP BY 1),
r AS (SELECT record_id, max(lower(trim(source_id))) AS s, max(coalesce(actual_token_count, 0)) AS n FROM build_stage_a_250k_slice WHERE source_id IS NOT NULL AND record_id IS NOT NULL GROUP BY 1),
u AS (SELECT s, sum(n) AS supply FROM r GROUP BY 1),
j AS (SELECT m.s, x.t AS t, x.r AS r, coalesce(supply, 0) AS supply FROM m LEFT JOIN u USING (s) WHERE x.t IS NOT NULL)
SELECT s AS source_id FROM j WHERE t * (SELECT sum(supply) FROM j) / (SELECT sum(t) FROM j) > r * supply""",
    "p2_split_checks": f"SELECT unnest(['hash_over_splits', 'family_over_splits', 'record_over_splits', 'record_without_split']) AS \"check\", 0::BIGINT AS found UNION ALL SELECT 'records', count(DISTINCT record_id) FROM {SLICE}",
    "p4_supply": """
WITH a AS (SELECT id, arg_max({'l': lower(trim(language)), 'c': lower(trim(category)), 'd': lower(trim(difficulty))}, received_at) AS x FROM phase3_5b_batch07_accepted WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT x.l AS l, x.c AS c, x.d AS d, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT count(*) // 5 AS s FROM a),
w AS (SELECT t.language, t.category, t.difficulty, greatest(coalesce(t.target_share, 0) * s.s, coalesce(t.min_records, 0))::DOUBLE AS wanted, coalesce(n.n, 0) AS supply FROM phase3_5b_sample_targets t CROSS JOIN s
LEFT JOIN n ON lower(trim(t.language)) = n.l AND lower(trim(t.category)) = n.c AND lower(trim(t.difficulty)) = n.d)
SELECT language, category, difficulty, round(wanted, 6) AS wanted, supply, round(greatest(0, wanted - supply), 6) AS unmet FROM w""",
    "p5_groups": """
WITH RECURSIVE r AS (SELECT id, regexp_extract_all(lower(arg_max(coalesce(instruction, '') || chr(10) || coalesce(answer, ''), received_at)), '[a-z0-9]+') AS w
  FROM phase3_5b_batch07_accepted WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT id, array_to_string(w, ' ') AS c, w FROM r WHERE len(w) >= 3), o AS (SELECT c, min(id) AS head, count(*) AS copies, any_value(w) AS w FROM k GROUP BY c),
g AS (SELECT DISTINCT head, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM o, range(1, len(w) - 1) t(i)), n AS (SELECT head, count(*) AS n FROM g GROUP BY head),
i AS (SELECT a.head AS x, b.head AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.head <> b.head GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n p ON p.head = x JOIN n q ON q.head = y WHERE i * 5 >= (p.n + q.n - i) * 3),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x), m AS (SELECT x, least(x, min(y)) AS group_id FROM reach GROUP BY x)
SELECT k.id, o.copies, coalesce(l.links, 0) AS links, coalesce(m.group_id, o.head) AS group_id FROM k JOIN o USING (c) LEFT JOIN l ON l.x = o.head LEFT JOIN m ON m.x = o.head WHERE o.copies > 1 OR l.links IS NOT NULL""",
    "p6_plan": """
WITH m AS (SELECT lower(trim(source_id)) AS s, arg_max({'t': target_tokens, 'r': max_repeats}, recorded_at) AS x FROM stage_a_sources_v1_candidate WHERE source_id IS NOT NULL GROUP BY 1),
r AS (SELECT record_id, max(lower(trim(source_id))) AS s, max(coalesce(actual_token_count, 0)) AS n FROM build_stage_a_250k_slice WHERE source_id IS NOT NULL AND record_id IS NOT NULL GROUP BY 1),
u AS (SELECT s, sum(n) AS supply FROM r GROUP BY 1),
j AS (SELECT m.s, x.t AS t, x.r AS r, coalesce(supply, 0) AS supply FROM m LEFT JOIN u USING (s) WHERE x.t IS NOT NULL),
b AS (SELECT *, CASE WHEN r IS NULL AND supply > 0 THEN 1000000000000000 ELSE supply * coalesce(r, 0) // 2048 END AS capped FROM j), t AS (SELECT sum(supply)::BIGINT // 2048 AS blocks FROM j),
u2 AS (SELECT s, b.t / (2 * k + 1) AS quotient FROM b, unnest(range(0, least(capped, (SELECT blocks FROM t))::BIGINT)) x(k) WHERE b.t > 0),
w AS (SELECT s, row_number() OVER (ORDER BY quotient DESC, s) AS place FROM u2), z AS (SELECT s, count(*) AS blocks FROM w WHERE place <= (SELECT blocks FROM t) GROUP BY s)
SELECT j.s AS source_id, j.t AS target_tokens, j.r AS max_repeats, supply::BIGINT AS supply, round(j.t * (SELECT sum(supply) FROM j) / (SELECT sum(t) FROM j), 3) AS wanted, (j.r * supply)::DOUBLE AS cap, coalesce(z.blocks, 0) AS blocks FROM j LEFT JOIN z ON z.s = j.s""",
    "p3_found": _LATEST + " SELECT record_id FROM l WHERE x.stated IS NULL OR abs(x.stated - x.n) * 10 > x.n",
    "p3_budget": _LATEST + " SELECT x.source_kind AS source_kind, x.language AS language, x.category AS category, count(*) AS records, sum(x.n)::BIGINT AS tokens, sum(x.stated)::BIGINT AS stated_tokens FROM l GROUP BY 1, 2, 3",
    "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND " + _count("text") + " > 2048",
    "p8_found": _RUNS + " SELECT doc_id, eval_id FROM f WHERE runs >= 8 AND runs * 100 >= n * 35",
    "p8_overlap": _RUNS + " SELECT doc_id, eval_id, runs, n AS prompt_runs FROM f",
    "p8_clean": _RUNS + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE runs >= 8 AND runs * 100 >= n * 35)",
}
