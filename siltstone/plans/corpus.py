"""Queries over documents: normal forms, statistics, quality rules, status and reason counts, exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.sources.tables import label, table

DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
CONTEXTS = (128, 192, 256, 512)
#: Wanted share of each language, and the tolerance of a gap.
SHARES = {"python": 0.30, "typescript": 0.20, "javascript": 0.175, "powershell": 0.125, "sql": 0.125, "text": 0.075}
TOP = 40
#: Columns that hold texts, the preferred one first, and the least length of a text in another column.
PREFERRED, OTHERS, LONG = ("text",), ("family_id", "status", "source"), 240


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", *columns).where("text is not null")


def norm_hash(spark, d):
    """Three fingerprints of each text: as it is, normalised, as template."""
    t = docs(spark, d, "text")
    return t.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"), F.sha2(T.normalize_text("text"), 256).alias("normalized_sha256"), F.sha2(T.normalize_template("text"), 256).alias("template_sha256"))


def lex_token_stats(spark, d):
    t = docs(spark, d, "text").select("doc_id", T.lexical_tokens("text").alias("k"))
    return t.select("doc_id", F.size("k").alias("tokens"), F.size(F.array_distinct("k")).alias("distinct_tokens"), F.sha2(F.array_join("k", " "), 256).alias("tokens_sha256"))


def content_stats(spark, d):
    stats = docs(spark, d, "text").select("doc_id", *T.content_statistics("text"))
    return stats.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in stats.dtypes])


def text_forms(spark, d):
    """The other normal forms, the newline style and the share of control characters."""
    t = docs(spark, d, "text")
    return t.select(
        "doc_id", F.md5(T.normalize_words("text")).alias("words_md5"), F.md5(T.normalize_rows("text")).alias("rows_md5"), F.md5(T.lf("text")).alias("lf_md5"), F.md5(T.canonical_text("text")).alias("canonical_md5"),
        T.newline_style("text").alias("newline_style"), F.round(T.control_ratio("text"), 9).alias("control_ratio"),
    )


def shingle_counts(spark, d):
    """Sizes of the sets of token runs: five and seven lexical tokens, audit trigrams."""
    t = docs(spark, d, "text").select("doc_id", T.lexical_tokens("text").alias("k"), T.trigrams("text").alias("g"))
    return t.select("doc_id", F.size(T.window_hashes(F.col("k"), 5)).alias("runs_5"), F.size(T.window_hashes(F.col("k"), 7)).alias("runs_7"), F.size("g").alias("trigrams"))


def quality_findings(spark, d):
    t = docs(spark, d, "text", "language").withColumn("is_doc", F.coalesce(label("language") == "text", F.lit(True)))
    reject, review = R.quality("text", F.col("is_doc"))
    found = t.select("doc_id", "text", "is_doc", *T.content_statistics("text")).select("doc_id", reject.alias("x"), review.alias("y"))
    return found.select("doc_id", F.array_join("x", ",").alias("reject"), F.array_join("y", ",").alias("review"), R.status(F.col("x"), F.col("y")).alias("status"))


def row_quality(spark, d):
    t = docs(spark, d, "text").select("doc_id", T.normalize_rows("text").alias("t")).withColumn("k", T.lexical_tokens("t"))
    reject, review = R.row_quality("t", "k")
    return t.select("doc_id", F.array_join(reject, ",").alias("reject"), F.array_join(review, ",").alias("review"), R.status(reject, review).alias("status"))


def secret_flags(spark, d):
    """(doc_id, rule) for each secret or injection pattern of either list that a text matches."""
    named = [*[(f"secret:{n}", p) for n, p in R.SECRETS], *[(f"lint:{n}", p) for n, p in R.LINT_SECRETS], *[(f"injection:{i}", p) for i, p in enumerate(R.INJECTION)]]
    flags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in named]))
    return docs(spark, d, "text").select("doc_id", F.explode(flags).alias("rule"))


def status_counts(spark, d):
    """Documents and tokens per source and status, with totals per source and over all."""
    t = docs(spark, d, "text", "source", "status").select(label("source").alias("source"), F.coalesce("status", F.lit("none")).alias("status"), T.lexical_size("text").alias("k"))
    return t.rollup("source", "status").agg(F.count(F.lit(1)).alias("records"), F.sum("k").alias("tokens"), F.grouping_id().alias("level"))


def compact_counts(counts: DataFrame, top: int = TOP) -> DataFrame:
    """(reason, records) of the `top` most frequent reasons, equal ones by name, and the rest as one row."""
    first = counts.orderBy(F.desc("records"), "reason").limit(top).select("reason", F.lit(True).alias("shown"))
    named = counts.join(first, "reason", "left")
    return named.groupBy(F.when(F.col("shown"), F.col("reason")).otherwise("other_reasons_compacted").alias("reason")).agg(F.sum("records").alias("records"))


def reason_counts(spark, d):
    """The most frequent rejection reasons, and the rest as one row."""
    r = row_quality(spark, d).select(F.explode(F.split("reject", ",")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
    return compact_counts(r)


def length_stats(spark, d):
    """Exact distribution of text lengths in tokens per source."""
    t = docs(spark, d, "text", "source").select(label("source").alias("source"), T.lexical_size("text").alias("k"))
    p = F.percentile("k", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    g = t.groupBy("source").agg(F.count("k").alias("records"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 3).alias("mean"), p.alias("p"))
    return g.select("source", "records", "least", "most", "mean", *[F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate(("median", "p90", "p95"))])


def context_fit(spark, d):
    """For each context length, how many texts fit and how many are longer."""
    t = docs(spark, d, "text").select(T.lexical_size("text").alias("k"))
    one = t.agg(*[F.count_if(F.col("k") <= c).alias(f"f{c}") for c in CONTEXTS], F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("context"), F.col(f"f{c}").alias("fits"), (F.col("n") - F.col(f"f{c}")).alias("exceeds")) for c in CONTEXTS]))
    return one.select(rows.alias("r")).select("r.*")


def lang_source_matrix(spark, d):
    return table(spark, d, "documents", "language", "source").groupBy(label("language").alias("language"), label("source").alias("source")).agg(F.count(F.lit(1)).alias("records"))


def share_gaps(spark, d):
    """Actual against wanted share of each language, beyond a tolerance of 2 records or 2 % under or over."""
    counts = table(spark, d, "documents", "language").groupBy(label("language").alias("language")).agg(F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records").alias("total"))
    wanted = spark.createDataFrame(list(SHARES.items()), "language string, share double")
    j = wanted.join(counts, "language", "left").na.fill(0, ["records"]).crossJoin(F.broadcast(total))
    off, tol = F.col("records") - F.col("total") * F.col("share"), F.greatest(F.lit(2.0), F.col("total") * 0.02)
    return j.select("language", "records", F.round(F.col("records") / F.col("total"), 4).alias("actual_share"), "share", F.round(off, 2).alias("delta"), F.when(off < -tol, "under").when(off > tol, "over").otherwise("near_target").alias("gap"))


def exact_dups(spark, d):
    """Copies of a text by normal form: the first id of the group and its size. Only hash and id are shuffled."""
    t = docs(spark, d, "text").select("doc_id", F.sha2(T.normalize_text("text"), 256).alias("h"))
    g = t.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return t.join(g, "h").where("doc_id <> first_id").select("doc_id", "first_id", "copies")


def template_dups(spark, d):
    """Texts of 30 tokens or more that share their template with an earlier one of another normal form."""
    t = docs(spark, d, "text").select("doc_id", F.sha2(T.normalize_template("text"), 256).alias("h"), F.sha2(T.normalize_text("text"), 256).alias("x"), T.lexical_size("text").alias("k"))
    g = t.groupBy("h").agg(F.min_by("x", "doc_id").alias("first_x"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return t.join(g, "h").where("doc_id <> first_id and x <> first_x and k >= 30").select("doc_id", "first_id")


def keep_first_distinct(spark, d):
    """One id per normal form, the least."""
    return docs(spark, d, "text").groupBy(F.sha2(T.normalize_text("text"), 256).alias("normalized_sha256")).agg(F.min("doc_id").alias("doc_id"))


def repetition_diag(spark, d):
    """White-space tokens: how many, share of distinct ones, longest run of one token."""
    k = F.filter(F.split("text", f"[{T.WS}]+"), lambda x: x != "")
    t = docs(spark, d, "text").select("doc_id", k.alias("k"))
    return t.select("doc_id", F.size("k").alias("tokens"), F.round(F.when(F.size("k") == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct("k")) / F.size("k")), 9).alias("unique_ratio"), T.longest_run(F.col("k")).alias("longest_run"))


def choose_text(spark, d):
    """Which column holds a row's text: the first non-blank preferred one, else the first of at least 240 characters."""
    t = table(spark, d, "documents", "doc_id", *PREFERRED, *OTHERS)
    first = [F.when(T.strip(c) != "", F.lit(c)) for c in PREFERRED] + [F.when(F.char_length(T.strip(c)) >= LONG, F.lit(c)) for c in OTHERS]
    return t.select("doc_id", F.coalesce(*first).alias("column"))


_R1, _R2 = R.sql_quality("text", "coalesce(lower(trim(language)) = 'text', true)")
_W1, _W2 = R.sql_row_quality("t", "k")
_NORM = f"sha256({T.sql_normalize('text')})"
_TEMPLATE = f"sha256({T.sql_template('text')})"
_ROWQ = f"(SELECT doc_id, array_to_string({_W1}, ',') AS reject, array_to_string({_W2}, ',') AS review, {R.sql_status(_W1, _W2)} AS status FROM (SELECT doc_id, t, {T.sql_lexical('t')} AS k FROM (SELECT doc_id, {T.sql_rows('text')} AS t FROM {DOCS})))"
_STATS = f"SELECT doc_id, {T.sql_statistics('text')} FROM {DOCS}"


def _flag_sql() -> str:
    named = [*[(f"secret:{n}", p) for n, p in R.SECRETS], *[(f"lint:{n}", p) for n, p in R.LINT_SECRETS], *[(f"injection:{i}", p) for i, p in enumerate(R.INJECTION)]]
    return f"SELECT doc_id, unnest({R.sql_reasons(*[(R._found('text', p), n) for n, p in named])}) AS rule FROM {DOCS}"


SQL = {
    "norm_hash": f"SELECT doc_id, sha256(text) AS decoded_sha256, {_NORM} AS normalized_sha256, {_TEMPLATE} AS template_sha256 FROM {DOCS}",
    "lex_token_stats": f"SELECT doc_id, len(k) AS tokens, len(list_distinct(k)) AS distinct_tokens, sha256(array_to_string(k, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {T.sql_lexical('text')} AS k FROM {DOCS})",
    "content_stats": f"SELECT doc_id, char_count, line_count, nonempty_line_count, token_count_proxy, round(letter_ratio, 9) AS letter_ratio, round(printable_ratio, 9) AS printable_ratio, longest_line, round(repeated_line_ratio, 9) AS repeated_line_ratio, round(top_line_ratio, 9) AS top_line_ratio FROM ({_STATS})",
    "text_forms": f"""SELECT doc_id, md5({T.sql_words('text')}) AS words_md5, md5({T.sql_rows('text')}) AS rows_md5, md5(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')) AS lf_md5, md5({T.sql_canonical('text')}) AS canonical_md5,
  CASE WHEN (c > 0)::INT + (n > c)::INT + (r > c)::INT > 1 THEN 'mixed' WHEN c > 0 THEN 'crlf' WHEN n > 0 THEN 'lf' WHEN r > 0 THEN 'cr' ELSE 'none' END AS newline_style,
  round(CASE WHEN text = '' THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0e}}-\\x{{1f}}]', '', 'g'))) / length(text) END, 9) AS control_ratio
  FROM (SELECT *, len(regexp_extract_all(text, '\\r\\n')) AS c, len(regexp_extract_all(text, '\\n')) AS n, len(regexp_extract_all(text, '\\r')) AS r FROM {DOCS})""",
    "shingle_counts": f"SELECT doc_id, len({T.sql_windows('k', 5)}) AS runs_5, len({T.sql_windows('k', 7)}) AS runs_7, len({T.sql_windows('g', 3)}) AS trigrams FROM (SELECT doc_id, {T.sql_lexical('text')} AS k, list_transform(regexp_extract_all(text, '{T.AUDIT}'), lambda x: lower(x)) AS g FROM {DOCS})",
    "quality_findings": f"SELECT doc_id, array_to_string({_R1}, ',') AS reject, array_to_string({_R2}, ',') AS review, {R.sql_status(_R1, _R2)} AS status FROM (SELECT doc_id, text, language, {T.sql_statistics('text')} FROM {DOCS})",
    "row_quality": f"SELECT * FROM {_ROWQ}",
    "secret_flags": _flag_sql(),
    "status_counts": f"SELECT source, status, count(*) AS records, sum(k)::BIGINT AS tokens, grouping(source, status) AS level FROM (SELECT lower(trim(source)) AS source, coalesce(status, 'none') AS status, {T.sql_lexical_size('text')} AS k FROM {DOCS}) GROUP BY ROLLUP (source, status)",
    "reason_counts": f"SELECT CASE WHEN rank <= {TOP} THEN reason ELSE 'other_reasons_compacted' END AS reason, sum(records)::BIGINT AS records FROM (SELECT reason, records, row_number() OVER (ORDER BY records DESC, reason) AS rank FROM (SELECT reason, count(*) AS records FROM (SELECT unnest(string_split(reject, ',')) AS reason FROM {_ROWQ}) WHERE reason <> '' GROUP BY reason)) GROUP BY 1",
    "length_stats": f"SELECT source, count(*) AS records, min(k) AS least, max(k) AS most, round(avg(k), 3) AS mean, round(quantile_cont(k, 0.5), 3) AS median, round(quantile_cont(k, 0.9), 3) AS p90, round(quantile_cont(k, 0.95), 3) AS p95 FROM (SELECT lower(trim(source)) AS source, {T.sql_lexical_size('text')} AS k FROM {DOCS}) GROUP BY source",
    "context_fit": f"WITH k AS (SELECT {T.sql_lexical_size('text')} AS k FROM {DOCS}) SELECT c AS context, count(*) FILTER (k <= c) AS fits, count(*) FILTER (k > c) AS exceeds FROM k, (SELECT unnest([128, 192, 256, 512]) AS c) GROUP BY c",
    "lang_source_matrix": "SELECT lower(trim(language)) AS language, lower(trim(source)) AS source, count(*) AS records FROM documents GROUP BY 1, 2",
    "share_gaps": "WITH w(language, share) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SHARES.items()) + """), n AS (SELECT lower(trim(language)) AS language, count(*) AS records FROM documents GROUP BY 1), t AS (SELECT count(*) AS total FROM documents)
  SELECT language, coalesce(records, 0) AS records, round(coalesce(records, 0) / total, 4) AS actual_share, share, round(coalesce(records, 0) - total * share, 2) AS delta,
  CASE WHEN coalesce(records, 0) - total * share < -greatest(2.0, total * 0.02) THEN 'under' WHEN coalesce(records, 0) - total * share > greatest(2.0, total * 0.02) THEN 'over' ELSE 'near_target' END AS gap FROM w LEFT JOIN n USING (language) CROSS JOIN t""",
    "exact_dups": f"WITH t AS (SELECT doc_id, {_NORM} AS h FROM {DOCS}), g AS (SELECT h, min(doc_id) AS first_id, count(*) AS copies FROM t GROUP BY h) SELECT doc_id, first_id, copies FROM t JOIN g USING (h) WHERE copies > 1 AND doc_id <> first_id",
    "template_dups": f"WITH t AS (SELECT doc_id, {_TEMPLATE} AS h, {_NORM} AS x, {T.sql_lexical_size('text')} AS k FROM {DOCS}), g AS (SELECT h, min(doc_id) AS first_id, arg_min(x, doc_id) AS first_x FROM t GROUP BY h) SELECT doc_id, first_id FROM t JOIN g USING (h) WHERE doc_id <> first_id AND x <> first_x AND k >= 30",
    "keep_first_distinct": f"SELECT {_NORM} AS normalized_sha256, min(doc_id) AS doc_id FROM {DOCS} GROUP BY 1",
    "repetition_diag": f"""WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[{T.WS}]+'), lambda x: x <> '') AS k FROM {DOCS}),
  e AS (SELECT doc_id, i, k[i] AS w FROM k, range(1, len(k) + 1) t(i)), b AS (SELECT doc_id, i, CASE WHEN w = lag(w) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM e),
  g AS (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b), r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
  SELECT doc_id, len(k) AS tokens, round(CASE WHEN len(k) = 0 THEN 0.0 ELSE len(list_distinct(k)) / len(k) END, 9) AS unique_ratio, coalesce(longest, 0) AS longest_run FROM k LEFT JOIN r USING (doc_id)""",
    "choose_text": "SELECT doc_id, CASE " + " ".join(f"WHEN {T.sql_strip(c)} <> '' THEN '{c}'" for c in PREFERRED) + " " + " ".join(f"WHEN length({T.sql_strip(c)}) >= {LONG} THEN '{c}'" for c in OTHERS) + " END AS \"column\" FROM documents",
}
QUERIES = {k: globals()[k] for k in SQL}
