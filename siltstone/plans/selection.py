"""Queries of selection and policy: source families and scores, per-source limits, budgets, splits, gates, score joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.operators.ranking import permuted_rank
from siltstone.plans import audit
from siltstone.plans.corpus import DOCS, docs
from siltstone.plans.slices import _RANK, _REC, _SRC, MANIFEST, SEED, latest_sources, records, shared_rank
from siltstone.plans.staging import Stage
from siltstone.sources.tables import label, table

#: Fixed values: (source, pattern on the path without regard to case, kind of family, what names it, rule). `1` is the
#: pattern's group, `stem` the file's name without suffix, `parent` its folder, `parent:stem` both.
FAMILY_RULES = (
    ("cpython_3_14_6", r"^lib/test/test_([^/]+)\.py$", "module", "1", "cpython_test_module"),
    ("cpython_3_14_6", r"^doc/library/([^/.]+)", "module", "1", "cpython_library_doc"),
    ("cpython_3_14_6", r"^lib/([^/]+?)(?:/|\.py)", "module", "1", "cpython_library_module"),
    ("cpython_3_14_6", r"^doc/tutorial/", "tutorial", "stem", "cpython_tutorial"),
    ("node_24_18_0", r"^doc/api/([^/.]+)", "api", "1", "node_api_doc"),
    ("node_24_18_0", r"^lib/([^/.]+)", "api", "1", "node_library_module"),
    ("node_24_18_0", r"^test/parallel/test-([a-z0-9_]+)", "api", "1", "node_parallel_test"),
    ("postgresql_18_4", r"/sql/|^src/test/regress/sql/", "regress", "stem", "postgres_sql_test"),
    ("postgresql_18_4", r"/expected/|^src/test/regress/expected/", "regress", "stem", "postgres_expected_pair"),
    ("postgresql_18_4", r"^doc/src/sgml/", "doc", "stem", "postgres_doc_file"),
    ("powershell_docs_2026", r"^reference/7\.6/", "cmdlet", "stem", "powershell_cmdlet_doc"),
    ("powershell_docs_2026", r"^reference/docs-conceptual/", "concept", "parent", "powershell_concept_section"),
    ("powershell_7_6_3", r"test/powershell/(?:modules|language|engine)/([^/]+)", "area", "1", "powershell_test_area"),
    ("pester_5_7_1", r"^(?:src|tst|docs)/", "feature", "stem", "pester_feature_stem"),
    ("pytest_9_1_1", r"^src/_pytest/([^/]+)/.", "feature", "1", "pytest_source_feature"),
    ("pytest_9_1_1", r"^src/_pytest/", "feature", "stem", "pytest_source_feature"),
    ("pytest_9_1_1", r"^testing/", "feature", "stem", "pytest_test_module"),
    ("pytest_9_1_1", r"^doc/", "doc", "parent", "pytest_doc_section"),
    ("typescript_website_2026", r"^packages/([^/]+)/.", "package", "1:stem", "typescript_website_document"),
    ("typescript_6_0_3", r"^tests/cases/", "test-area", "parent:stem", "typescript_test_case"),
    ("typescript_6_0_3", r"^src/", "source", "parent:stem", "typescript_source_file"),
)
PLAIN_FOLDERS = ("src", "lib", "doc", "docs", "test", "tests")
#: Parts of a path that raise or lower a file's score, and suffixes of code and of documents.
TEST_PARTS, DOC_PARTS = ("/test", "tests/", "testing/", "tst/", "regress/"), ("/doc", "docs/", "documentation/", "tutorial", "handbook", "readme")
MADE_PARTS = ("generated", "baseline", "snapshot", "fixture")
CODE_SUFFIXES, DOC_SUFFIXES = (".py", ".pyi", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".ps1", ".psm1", ".psd1", ".sql"), (".md", ".mdx", ".rst", ".sgml", ".xml", ".html", ".txt")
#: Limits of a source: least and most characters, least tokens, most characters of a line. The empty name is any other source.
POLICIES = {"": (120, 40_000, 30, 4_000), "fernwiki_20260401": (400, 20_000, 80, 8_000), "sedgebooks_20260401": (400, 20_000, 80, 8_000), "cobaltsql_16_2": (60, 60_000, 15, 2_000), "driftwood_forum_2026": (240, 12_000, 45, 2_000)}
#: Most tokens and records of a family for each group, the total wanted, and the most in total.
GROUPS = {"repository_sources": (140_000, 1), "public_corpus": (60_000, 1), "wiki_english": (60_000, 1), "self_notes": (10_000, 2)}
TOTAL, MOST_TOTAL = 250_000, 262_144
#: Token budget of a source and records of a family before review.
BUDGET, FAMILY_LIMIT = 60_000, 4
VALIDATION = 0.1
#: An architecture: width, layers, heads, key heads, inner width.
ARCHITECTURE, VOCABULARIES = (192, 4, 6, 3, 576), (2_000, 4_000, 8_000)


def slug(c: Column) -> Column:
    """Letters and digits in lower case with hyphens between, without a leading or trailing `test` or `tests`."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    bare = F.regexp_replace(F.regexp_replace(plain, "^tests?-", ""), "-tests?$", "")
    return F.when(bare == "", "root").otherwise(bare)


def sql_slug(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '^tests?-', ''), '-tests?$', ''), ''), 'root')"


def source_family(source: str, path: str) -> tuple[Column, Column]:
    """(family, rule) of a file: by the first rule of its source that its path meets, else by its last two telling folders
    and its stem. A null source or path has no family."""
    p, s = F.col(path), F.col(source)
    name = F.regexp_extract(F.lower(p), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), r"\.d$", "")
    folders = F.filter(F.split(F.regexp_replace(p, r"[^/]*/*$", ""), "/"), lambda x: x != "")
    parent = F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit(""))
    told = F.filter(F.transform(F.slice(folders, F.greatest(F.lit(1), F.size(folders) - 1), F.lit(2)), slug), lambda x: ~x.isin(*PLAIN_FOLDERS))
    place = F.when(F.size(told) == 0, "root").otherwise(F.array_join(told, "/"))
    family = rule = None
    for of, pattern, kind, names, title in FAMILY_RULES:
        parts = {"1": slug(F.regexp_extract(p, f"(?i){pattern}", 1)) if "1" in names else None, "stem": slug(stem), "parent": slug(parent)}
        key = F.concat_ws(":", s, F.lit(kind), *[parts[n] for n in names.split(":")])
        hit = (s == of) & p.rlike(f"(?i){pattern}")
        family, rule = (F.when(hit, key), F.when(hit, title)) if family is None else (family.when(hit, key), rule.when(hit, title))
    known = s.isNotNull() & p.isNotNull()
    return F.when(known, family.otherwise(F.concat_ws(":", s, F.lit("path"), place, slug(stem)))), F.when(known, rule.otherwise("path_stem_fallback"))


def sql_family(source: str, path: str) -> str:
    stem = f"regexp_replace(regexp_replace(regexp_extract(lower({path}), '([^/]*)/*$', 1), '^(.+)\\.[^.]*$', '\\1'), '\\.d$', '')"
    folders = f"list_filter(string_split(regexp_replace({path}, '[^/]*/*$', ''), '/'), lambda x: x <> '')"
    told = f"list_filter(list_transform({folders}[-2:], lambda x: {sql_slug('x')}), lambda x: x NOT IN {PLAIN_FOLDERS})"
    cases = []
    for of, pattern, kind, names, _ in FAMILY_RULES:
        parts = {"1": sql_slug(f"regexp_extract({path}, '(?i){pattern}', 1)") if "1" in names else "", "stem": sql_slug(stem), "parent": sql_slug(f"coalesce({folders}[-1], '')")}
        cases.append(f"WHEN {source} = '{of}' AND regexp_matches({path}, '(?i){pattern}') THEN concat_ws(':', {source}, '{kind}', " + ", ".join(parts[n] for n in names.split(":")) + ")")
    return "CASE " + " ".join(cases) + f" ELSE concat_ws(':', {source}, 'path', CASE WHEN len({told}) = 0 THEN 'root' ELSE array_to_string({told}, '/') END, {sql_slug(stem)}) END"


def _files(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.inventory(spark, d, "source_kind", "source_path", "full_record_tokens").where("source_kind is not null and source_path is not null")
    family, rule = source_family("source_kind", "source_path")
    return rows.select("record_id", "source_kind", "source_path", "full_record_tokens", family.alias("family"), rule.alias("rule"))


def source_families(spark, d):
    """Records per family of the inventory's files, and the rule that named it."""
    return _files(spark, d).groupBy("family", "rule").agg(F.count(F.lit(1)).alias("records"))


def repository_scores(spark, d):
    """(record_id, score): a file's worth by its path, suffix, size and whether its family has others. Family sizes are
    a combined aggregate joined back, not a window over a hot family."""
    f = _files(spark, d)
    n = f.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    p, k = F.lower("source_path"), F.coalesce("full_record_tokens", F.lit(0))
    has = lambda parts: F.greatest(*[F.instr(p, x) for x in parts]) > 0
    on = lambda c, v: F.when(c, v).otherwise(0)
    kind = F.regexp_extract(p, r"[^/](\.[^./]*)$", 1)
    score = F.lit(50) + on(F.col("members") >= 2, 12) + on(has(TEST_PARTS), 14) + on(has(DOC_PARTS), 12) + F.when(kind.isin(*CODE_SUFFIXES), 10).when(kind.isin(*DOC_SUFFIXES), 8).otherwise(0) + F.when(k.between(80, 900), 12).when(k <= 1500, 6).otherwise(0) - on(has(MADE_PARTS), 20)
    return f.join(n, "family").select("record_id", score.alias("score"))


def policy_verdicts(spark, d):
    """(source, verdict, documents): each document judged by the limits of its source, others by the common ones. The
    policies are a literal table of fixed size, joined by source."""
    limits = spark.createDataFrame([(k, *v) for k, v in POLICIES.items()], "policy string, least int, most int, least_tokens int, most_line int")
    own = F.when(F.col("source").isin(*[k for k in POLICIES if k]), F.col("source")).otherwise("")
    t = docs(spark, d, "text", "source").select(label("source").alias("source"), F.char_length("text").alias("chars"), T.lexical_size("text").alias("tokens"), F.array_max(F.transform(F.split("text", "\n"), F.char_length)).alias("line"))
    j = t.withColumn("policy", own).join(limits, "policy")
    verdict = F.when((F.col("chars") < F.col("least")) | (F.col("tokens") < F.col("least_tokens")), "too_short").when(F.col("chars") > F.col("most"), "too_large").when(F.col("line") > F.col("most_line"), "long_line").otherwise("pass")
    return j.groupBy("source", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("documents"))


def two_phase_select(rows: DataFrame, targets: list[tuple[str, int]], groups: dict[str, tuple[int, int]], total: int, most_total: int) -> DataFrame:
    """(id, phase): rows taken to fill each source's target in turn, then from all sources up to `total`.

    rows: (id, source, group, family, tokens, score, rank). Order: score from the highest, then tokens, rank and id. A row
    is passed over if its family has its records in the group, or it overruns the group's or the total most; a source is
    filled until it reaches its target, all until `total`. A row whose group has no policy is never taken; a null family
    is the row's own. What is taken depends on all that was, so both phases are one ordered stream, which ends as soon as
    the totals are reached; it holds counters only.
    """
    goal, turn = dict(targets), {s: k for k, (s, _) in enumerate(targets)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[str] = set()
        families: dict[tuple, int] = {}
        of_source: dict[str, int] = {}
        of_group: dict[str, int] = {}
        whole = 0
        for b in batches:
            out = []
            for phase, i, s, g, f, n in zip(b["phase"], b["id"], b["source"], b["group"], b["family"], b["tokens"]):
                if phase == 2 and whole >= total:
                    yield pd.DataFrame(out, columns=["id", "phase"])
                    return
                full = phase == 1 and of_source.get(s, 0) >= goal.get(s, 0)
                most, cap = groups[g]
                if full or i in taken or families.get((g, f), 0) >= cap > 0 or of_group.get(g, 0) + n > most or whole + n > most_total:
                    continue
                taken.add(i)
                out.append((i, phase))
                families[g, f] = families.get((g, f), 0) + 1
                of_source[s], of_group[g], whole = of_source.get(s, 0) + n, of_group.get(g, 0) + n, whole + n
            yield pd.DataFrame(out, columns=["id", "phase"])

    known = rows.where(F.col("group").isin(*groups)).select("id", "source", "group", F.coalesce("family", "id").alias("family"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("rank", F.lit(0)).alias("rank"))
    place = F.create_map(*[F.lit(x) for kv in turn.items() for x in kv])[F.col("source")] if turn else F.lit(None).cast("int")
    both = known.withColumn("phase", F.lit(1)).withColumn("turn", place).where("turn is not null").unionByName(known.withColumn("phase", F.lit(2)).withColumn("turn", F.lit(0)))
    stream = both.repartition(1).sortWithinPartitions("phase", "turn", F.desc("score"), "tokens", "rank", "id")
    return stream.select("phase", "id", "source", "group", "family", "tokens").mapInPandas(run, "id string, phase int")


def slice_selection(spark, d):
    """The two-phase choice over slice records: each source's target is its share of the manifest's tokens."""
    plan = latest_sources(table(spark, d, MANIFEST)).where("target_tokens > 0").select("source_id", "target_tokens").orderBy("source_id").collect()  # a fixed manifest
    whole = sum(r["target_tokens"] for r in plan)
    targets = [(r["source_id"], int(r["target_tokens"] * TOTAL // whole)) for r in plan]
    rank = table(spark, d, "build_stage_a_250k_slice", "record_id", "probe_selection_rank").groupBy("record_id").agg(F.min("probe_selection_rank").alias("rank"))
    r = records(spark, d).where("source_id is not null").join(rank, "record_id")
    rows = r.select(F.col("record_id").alias("id"), F.col("source_id").alias("source"), F.col("group_id").alias("group"), F.col("family_id").alias("family"), F.col("actual_token_count").alias("tokens"), F.col("selection_score").alias("score"), "rank")
    return two_phase_select(Stage(spark, "selection").put(rows, "rows"), targets, GROUPS, TOTAL, MOST_TOTAL)


def budget_select(rows: DataFrame, budget: int, limit: int) -> DataFrame:
    """(id, status) by source in the order of score from the highest and id: `rejected` where the record overruns the
    budget, `review` where its family has its records already (it still uses the budget), else `candidate`.

    rows: (id, source, family, tokens, score). One ordered stream per source that holds family counts; records that alone
    overrun the budget are judged without it. Null tokens and scores count as 0, a null family is the record's own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        families: dict[tuple, int] = {}
        for b in batches:
            out = []
            for i, s, f, n in zip(b["id"], b["source"], b["family"], b["tokens"]):
                if used.get(s, 0) + n > budget:
                    out.append((i, "rejected"))
                    continue
                out.append((i, "review" if families.get((s, f), 0) >= limit else "candidate"))
                used[s] = used.get(s, 0) + n
                families[s, f] = families.get((s, f), 0) + 1
            yield pd.DataFrame(out, columns=["id", "status"])

    small = rows.select("id", "source", F.coalesce("family", "id").alias("family"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("score", F.lit(0)).alias("score"))
    over = small.where(F.col("tokens") > budget).select("id", F.lit("rejected").alias("status"))
    stream = small.where(F.col("tokens") <= budget).repartition("source").sortWithinPartitions("source", F.desc("score"), "id")
    return stream.select("id", "source", "family", "tokens").mapInPandas(run, "id string, status string").union(over)


def source_budgets(spark, d):
    """`budget_select` over slice records."""
    r = records(spark, d).where("source_id is not null")
    return budget_select(r.select(F.col("record_id").alias("id"), F.col("source_id").alias("source"), F.col("family_id").alias("family"), F.col("token_count_proxy").alias("tokens"), F.col("selection_score").alias("score")), BUDGET, FAMILY_LIMIT)


def record_split(spark, d):
    """(id, split): accepted records in seeded order, a tenth to validation, at least one and not all."""
    r = Stage(spark, "split").put(audit.records(spark, d, "language").select("id", shared_rank(str(SEED), F.col("id")).alias("place")), "rows")
    n = r.count()
    most = max(0, min(n - 1, max(1, round(n * VALIDATION))))
    return permuted_rank(r, [], "place", ["id"]).select("id", F.when(F.col("rank") <= most, "validation").otherwise("train").alias("split"))


def exclusion_check(spark, d):
    """What is left of the slice without an exclusion list: records and tokens, how many listed ones are unknown, and
    whether the rest is within the budget. Listed are records without a similarity hash, and one that does not exist."""
    r = records(spark, d).select("record_id", "simhash64", "actual_token_count")
    listed = r.where("simhash64 is null").select("record_id").union(spark.createDataFrame([("no-such-record",)], "record_id string"))
    kept = r.join(listed, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("actual_token_count"), F.lit(0)).alias("tokens"))
    unknown = listed.join(r, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    excluded = listed.join(r, "record_id", "left_semi").agg(F.count(F.lit(1)).alias("excluded"))
    return kept.crossJoin(unknown).crossJoin(excluded).select("kept", "tokens", "excluded", "unknown", (F.col("tokens") <= MOST_TOTAL).alias("within"))


def gated_sources(spark, d):
    """(source, documents) of the sources of which every document has a language; one without lets none of its source by."""
    t = table(spark, d, "documents", "doc_id", "lang", "source").where("source is not null").select(label("source").alias("source"), "lang")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.bool_and(F.col("lang").isNotNull()).alias("safe")).where("safe").select("source", "documents")


def answer_scores(spark, d):
    """(id, expected, said, same_text, correct): the answers cut from rendered texts against the accepted ones, joined on
    the id: by the first standalone choice letter, else by equal normal forms. Records without an output are left out."""
    letter = lambda c: F.nullif(F.regexp_extract(F.upper(T.strip(c)), r"(?:^|[^A-Z0-9])([ABCD])(?:$|[^A-Z0-9])", 1), F.lit(""))
    cut = T.strip(F.regexp_replace(F.regexp_replace("rendered", r"(?s)^.*?<answer>", ""), r"(?s)</answer>.*$", ""))
    out = audit.inventory(spark, d, "rendered").where("rendered is not null").select(F.col("record_id").alias("id"), cut.alias("output"))
    j = audit.records(spark, d, "answer").where("answer is not null").join(out, "id")
    both = j.select("id", letter(F.col("answer")).alias("expected"), letter(F.col("output")).alias("said"), (T.normalize_text("answer") == T.normalize_text("output")).alias("same_text"))
    return both.withColumn("correct", F.coalesce(F.col("expected") == F.col("said"), F.lit(False)) | F.col("same_text"))


def parameter_counts(spark, d):
    """Parameters of one architecture for each vocabulary size."""
    width, layers, heads, keys, inner = ARCHITECTURE
    block = 2 * width + 2 * width * width + 2 * width * keys * (width // heads) + 3 * width * inner
    sizes = spark.createDataFrame([(v,) for v in VOCABULARIES], "vocabulary long")
    return sizes.select("vocabulary", (F.col("vocabulary") * width + layers * block + width).alias("parameters"))


def verify_release(spark, d):
    """(check, bad): how many rows of the inventory, the held-out set and the manifest break a rule of a finished release."""
    i = audit.inventory(spark, d, "rendered", "full_record_tokens", "supervised_tokens", "supervised_percentage", "source_kind")
    ids = audit.records(spark, d, "language").select(F.col("id").alias("record_id"))
    held = table(spark, d, audit.HELDOUT, "id", "training_allowed", "split", "prompt")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
    out = n(ids.join(i, "record_id", "left_anti"), "accepted_without_inventory")
    for df, name in (
        (i.where("full_record_tokens is null"), "record_without_count"), (i.where("supervised_tokens > full_record_tokens"), "more_supervised_than_whole"), (i.where("supervised_percentage < 0 or supervised_percentage > 100"), "percentage_out_of_range"),
        (i.where("rendered is null or instr(rendered, '<answer>') = 0"), "rendered_without_answer"), (held.where("training_allowed is null or training_allowed"), "heldout_allowed_for_training"), (held.where("split is null or split <> 'heldout'"), "heldout_in_other_split"),
        (held.where("id is not null").groupBy("id").count().where("count > 1"), "repeated_heldout_id"), (table(spark, d, MANIFEST, "training_allowed").where("training_allowed is null or training_allowed"), "source_allowed_before_approval"),
    ):
        out = out.unionByName(n(df, name))
    return out


def stored_lengths(spark, d):
    """(source, documents, differing): documents whose stored number of characters is not that of their text."""
    t = docs(spark, d, "text", "source", "n_chars").select(label("source").alias("source"), (F.coalesce(F.col("n_chars"), F.lit(-1)) != F.char_length("text")).alias("off"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("off").alias("differing"))


_FILES = f"(SELECT record_id, source_kind, source_path, full_record_tokens, {sql_family('source_kind', 'source_path')} AS family FROM {audit._inv('source_kind', 'source_path', 'full_record_tokens')} WHERE source_kind IS NOT NULL AND source_path IS NOT NULL)"
_RULE = "CASE " + " ".join(f"WHEN source_kind = '{of}' AND regexp_matches(source_path, '(?i){pattern}') THEN '{title}'" for of, pattern, _, _, title in FAMILY_RULES) + " ELSE 'path_stem_fallback' END"
_HAS = lambda parts: "(" + " OR ".join(f"contains(lower(source_path), '{x}')" for x in parts) + ")"
_ON = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"
_KIND = "regexp_extract(lower(source_path), '[^/](\\.[^./]*)$', 1)"
_CHOICE = lambda c: f"nullif(regexp_extract(upper({T.sql_strip(c)}), '(?:^|[^A-Z0-9])([ABCD])(?:$|[^A-Z0-9])', 1), '')"
_CUT = T.sql_strip("regexp_replace(regexp_replace(rendered, '(?s)^.*?<answer>', ''), '(?s)</answer>.*$', '')")
_INVENTORY = audit._inv("rendered", "full_record_tokens", "supervised_tokens", "supervised_percentage", "source_kind")
SQL = {
    "source_families": f"SELECT family, {_RULE} AS rule, count(*) AS records FROM {_FILES} GROUP BY ALL",
    "repository_scores": f"SELECT record_id, 50 + {_ON('count(*) OVER (PARTITION BY family) >= 2', 12)} + {_ON(_HAS(TEST_PARTS), 14)} + {_ON(_HAS(DOC_PARTS), 12)} + CASE WHEN {_KIND} IN {CODE_SUFFIXES} THEN 10 WHEN {_KIND} IN {DOC_SUFFIXES} THEN 8 ELSE 0 END + CASE WHEN coalesce(full_record_tokens, 0) BETWEEN 80 AND 900 THEN 12 WHEN coalesce(full_record_tokens, 0) <= 1500 THEN 6 ELSE 0 END - {_ON(_HAS(MADE_PARTS), 20)} AS score FROM {_FILES}",
    "policy_verdicts": "WITH p(policy, least, most, least_tokens, most_line) AS (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in POLICIES.items()) + f"), t AS (SELECT lower(trim(source)) AS source, length(text) AS chars, len({T.sql_lexical('text')}) AS tokens, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS line FROM {DOCS}) SELECT source, CASE WHEN chars < least OR tokens < least_tokens THEN 'too_short' WHEN chars > most THEN 'too_large' WHEN line > most_line THEN 'long_line' ELSE 'pass' END AS verdict, count(*) AS documents FROM t JOIN p ON p.policy = CASE WHEN source IN ({', '.join(repr(k) for k in POLICIES if k)}) THEN source ELSE '' END GROUP BY ALL",
    "record_split": f"WITH r AS (SELECT id, row_number() OVER (ORDER BY {_RANK(chr(39) + str(SEED) + chr(39), 'id')}, id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM {audit.ACCEPTED} WHERE id IS NOT NULL)) SELECT id, CASE WHEN rank <= least(n - 1, greatest(1, round_even(n * {VALIDATION}, 0))) THEN 'validation' ELSE 'train' END AS split FROM r",
    "exclusion_check": f"WITH r AS (SELECT record_id, simhash64, actual_token_count FROM {_REC}) SELECT count(*) FILTER (simhash64 IS NOT NULL) AS kept, coalesce(sum(actual_token_count) FILTER (simhash64 IS NOT NULL), 0)::BIGINT AS tokens, count(*) FILTER (simhash64 IS NULL) AS excluded, 1::BIGINT AS unknown, tokens <= {MOST_TOTAL} AS within FROM r",
    "gated_sources": "SELECT lower(trim(source)) AS source, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING bool_and(lang IS NOT NULL)",
    "answer_scores": f"WITH o AS (SELECT record_id AS id, {_CUT} AS output FROM {audit._inv('rendered')} WHERE rendered IS NOT NULL), j AS (SELECT id, {_CHOICE('answer')} AS expected, {_CHOICE('output')} AS said, {T.sql_normalize('answer')} = {T.sql_normalize('output')} AS same_text FROM {audit._REC} JOIN o USING (id) WHERE answer IS NOT NULL) SELECT *, coalesce(expected = said, false) OR same_text AS correct FROM j",
    "parameter_counts": f"SELECT v AS vocabulary, v * {ARCHITECTURE[0]} + {ARCHITECTURE[1]} * (2 * {ARCHITECTURE[0]} + 2 * {ARCHITECTURE[0]} * {ARCHITECTURE[0]} + 2 * {ARCHITECTURE[0]} * {ARCHITECTURE[3]} * ({ARCHITECTURE[0]} // {ARCHITECTURE[2]}) + 3 * {ARCHITECTURE[0]} * {ARCHITECTURE[4]}) + {ARCHITECTURE[0]} AS parameters FROM (SELECT unnest({list(VOCABULARIES)})::BIGINT AS v)",
    "verify_release": f"""SELECT 'accepted_without_inventory' AS "check", count(*) AS bad FROM (SELECT DISTINCT id FROM {audit.ACCEPTED} WHERE id IS NOT NULL AND id NOT IN (SELECT record_id FROM {audit.INVENTORY} WHERE record_id IS NOT NULL))
  UNION ALL SELECT 'record_without_count', count(*) FROM {_INVENTORY} WHERE full_record_tokens IS NULL UNION ALL SELECT 'more_supervised_than_whole', count(*) FROM {_INVENTORY} WHERE supervised_tokens > full_record_tokens UNION ALL SELECT 'percentage_out_of_range', count(*) FROM {_INVENTORY} WHERE supervised_percentage < 0 OR supervised_percentage > 100
  UNION ALL SELECT 'rendered_without_answer', count(*) FROM {_INVENTORY} WHERE rendered IS NULL OR NOT contains(rendered, '<answer>') UNION ALL SELECT 'heldout_allowed_for_training', count(*) FROM {audit.HELDOUT} WHERE training_allowed IS NULL OR training_allowed UNION ALL SELECT 'heldout_in_other_split', count(*) FROM {audit.HELDOUT} WHERE "split" IS NULL OR "split" <> 'heldout'
  UNION ALL SELECT 'repeated_heldout_id', count(*) FROM (SELECT id FROM {audit.HELDOUT} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'source_allowed_before_approval', count(*) FROM {MANIFEST} WHERE training_allowed IS NULL OR training_allowed""",
    "stored_lengths": f"SELECT lower(trim(source)) AS source, count(*) AS documents, count(*) FILTER (coalesce(n_chars, -1) <> length(text)) AS differing FROM {DOCS} GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in SQL} | {"slice_selection": slice_selection, "source_budgets": source_budgets}
