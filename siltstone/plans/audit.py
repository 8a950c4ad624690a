"""Queries over instruction records: rendering, tags, inference, lint, duplicates, held-out overlap, gaps, reports."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.functions.code import structure
from siltstone.operators.containment import contained
from siltstone.operators.similarity import best_match, similar_sets
from siltstone.plans.staging import Stage
from siltstone.sources.tables import label, table

ACCEPTED, INVENTORY, HELDOUT = "phase3_5b_batch07_accepted", "phase3_5b_record_inventory", "phase3_5b_heldout_v1"
FIELDS = ("language", "category", "difficulty", "instruction", "constraints", "answer", "bad_code", "reasoning", "edge_cases", "quality_notes")
LANGUAGES, DIFFICULTIES = ("python", "typescript", "javascript", "powershell", "sql", "text"), ("basic", "intermediate")

#: Regular expressions of the inference cascades, of the secondary tags and of the counted patterns.
IS_POWERSHELL = r"\b(?:param\s*\(|get-childitem|where-object|foreach-object|write-output)\b"
IS_TYPESCRIPT = r"\b(?:interface|type\s+\w+\s*=|unknown\b|promise<|readonly\s+\w+\[\])"
IS_JAVASCRIPT = r"\b(?:const|let|function)\s+\w+\s*\([^)]*\)\s*\{"
IS_SQL = r"\b(?:select|insert into|update\s+\w+\s+set|create table|with\s+\w+\s+as)\b"
IS_TALK, IS_CODE = r"\b(?:explain|describe the difference|why does)\b", r"\b(?:python|typescript|javascript|powershell|sql)\b"
CATEGORY = (
    ("tests", r"\b(?:test|unittest|pester|assert)\b"), ("database", r"\b(?:database|query|table|transaction)\b"), ("files", r"\b(?:file|path|directory|json|csv|jsonl|utf-8)\b"),
    ("security", r"\b(?:secure|security|authorization|redact|secret|token|traversal|tenant)\b"), ("efficiency", r"\b(?:efficient|complexity|linear time|avoid repeated|optimi[sz])\b"),
    ("explanation", r"\b(?:explain|describe why|difference between)\b"), ("validation", r"\b(?:validate|parse|required|reject|normalize|non-empty|must not)\b"),
)
IS_HARD = r"(?i)\b(?:async|transaction|rollback|authorization|concurrency|idempotent)\b"
TAGS = {
    "validation": r"\bvalidat|\breject|\brequired\b|\bparse\b|\bboundar", "files": r"\bfile|\bpath|\bcsv\b|\bjsonl\b|\bnewline|\bbom\b", "data": r"\bjson\b|\bcsv\b|\bmap\b|\bdict|\bgroup|\btransform",
    "debugging": r"\bfix\b|\bbug\b|\bregression|<bad_code>", "tests": r"\btest|\bunittest\b|\bpester\b|\bassert", "database": r"\bsql\b|\bpostgres|\btransaction|\bselect\b|\binsert\b|\bupdate\b",
    "security": r"\bauthori|\bauthentic|\bsecret|\btoken|\bcsrf|\btenant|\btraversal|\bredact", "efficiency": r"\befficient|\blinear time|\bcomplexity|\bavoid repeated|\bbounded",
    "api": r"\brequest\b|\bresponse\b|\bhttp\b|\bapi\b|\bheader\b", "async": r"\basync\b|\bawait\b|\bpromise\b|\btimeout\b", "explanation": r"\bexplain|\bwhy\b|\bdifference between\b",
    "transactions": r"\btransaction|\bbegin\b|\bcommit\b|\brollback\b",
}
#: capability: (categories, tags, languages) that give it, and its wanted number of records.
CAPABILITIES = {
    "functions_and_data": (("function", "data"), ("data",), (), 90), "validation": (("validation",), ("validation",), (), 55), "debugging": (("debugging",), ("debugging",), (), 55),
    "tests": (("tests",), ("tests",), (), 55), "files_apis_automation": (("files",), ("files", "api"), (), 50), "sql_database": (("database",), ("database",), ("sql",), 45),
    "security": (("security",), ("security",), (), 35), "efficiency": (("efficiency",), ("efficiency",), (), 35), "explanation": (("explanation",), ("explanation",), (), 30),
}
PATTERNS = {
    "value_error": r"\bValueError\b", "type_error": r"\bTypeError\b", "truthiness_guard": r"\bif\s+not\s+[A-Za-z_(]",
    "explicit_none_or_null": r"\b(?:is\s+None|is\s+not\s+None|===\s+null|!==\s+null|===\s+undefined|!==\s+undefined)\b", "object_create_null": r"Object\.create\(null\)", "array_is_array": r"Array\.isArray\(",
    "unittest": r"\bunittest\b", "subtest": r"\bsubTest\b", "pytest": r"\bpytest\b", "pester": r"\b(?:Describe|It|Should)\b", "transaction_begin": r"\bBEGIN\b", "transaction_commit": r"\bCOMMIT\b",
    "transaction_rollback": r"\bROLLBACK\b", "parameter_placeholder": r"(?:\$\d+|%s|\?|:\w+)", "strip_or_trim": r"\.(?:strip|trim)\(", "sort_operation": r"\b(?:sorted\(|\.sort\()",
    "set_membership": r"\bset\(|new\s+Set\(", "async_await": r"\b(?:async|await|Promise<)\b", "pathlib_or_path": r"\b(?:Path|pathlib|Resolve-Path|Join-Path)\b",
    "json_parse": r"\b(?:json\.loads?|JSON\.parse|ConvertFrom-Json)\b", "explicit_size_limit": r"\b(?:max_|limit|length|size|bytes?)\b",
}
#: Terms of held-out rows that are too common to tell anything.
GENERIC_TERMS = (
    "valueerror", "typeerror", "return", "raise", "def", "function", "string", "number", "array", "list", "dict", "set", "true", "false", "null", "undefined", "select", "where", "unittest", "specific", "deterministic", "parameter", "membership", "integration", "exact", "message", "error", "stable", "sorted", "validation", "invalid", "empty", "exception", "input", "output",
)
LINT_TAGS = ("instruction", "constraints", "answer", "bad_code", "reasoning", "file")


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest row of each id: its `columns`, labels trimmed in lower case."""
    rows = table(spark, d, ACCEPTED, "id", "received_at", *columns).where("id is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.coalesce(F.unix_micros("received_at"), F.lit(-1))).alias("r"))  # a row without a time is the oldest
    return last.select("id", *[label(f"r.{c}").alias(c) if c in ("language", "category", "difficulty") else F.col(f"r.{c}").alias(c) for c in columns])


def inventory(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest row of each record of the inventory, in the same way."""
    rows = table(spark, d, INVENTORY, "record_id", "audited_at", *columns).where("record_id is not null")
    last = rows.groupBy("record_id").agg(F.max(F.struct("audited_at", *columns)).alias("r"))
    return last.select("record_id", *[label(f"r.{c}").alias(c) if c in ("language", "category", "difficulty", "source_kind") else F.col(f"r.{c}").alias(c) for c in columns])


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _block(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>"))


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def rendered() -> Column:
    """A record as tagged text; edge cases and notes are a second <reasoning>."""
    items = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), T.strip), lambda x: F.coalesce(x, F.lit("")) != "")
    notes = [F.when(F.size(items(c)) > 0, F.concat(F.lit(f"{head}:\n"), _bullets(items(c)))) for c, head in (("edge_cases", "Edge cases"), ("quality_notes", "Quality notes"))]
    note = F.concat_ws("\n", *notes)
    full = lambda c: T.strip(_text(c))
    return F.concat_ws(
        "\n", _block("instruction", full("instruction")), _block("constraints", _bullets(F.coalesce("constraints", F.array().cast("array<string>")))), F.when(full("bad_code") != "", _block("bad_code", full("bad_code"))),
        F.when(full("reasoning") != "", _block("reasoning", full("reasoning"))), _block("answer", full("answer")), F.when(note != "", _block("reasoning", note)),
    )


def infer_language() -> Column:
    low, ask = F.lower(F.concat(_text("instruction"), F.lit("\n"), _text("answer"))), F.lower(_text("instruction"))
    out = None
    for name, pattern in (("powershell", IS_POWERSHELL), ("typescript", IS_TYPESCRIPT), ("javascript", IS_JAVASCRIPT), ("sql", IS_SQL)):
        hit = low.contains(name) | low.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(ask.rlike(IS_TALK) & ~ask.rlike(IS_CODE), "text").otherwise("python")


def infer_category(language: Column) -> Column:
    low, out = F.lower(F.concat(_text("instruction"), F.lit("\n"), _text("answer"))), F.when(_text("bad_code") != "", "debugging")
    for name, pattern in CATEGORY:
        hit = (F.lower(_text("instruction")) if name == "explanation" else low).rlike(pattern)
        hit = hit | (language == "sql") if name == "database" else hit | (language == "text") if name == "explanation" else hit
        out = out.when(hit, name)
    return out.otherwise("function")


def infer_difficulty() -> Column:
    signs = ((F.size(F.coalesce("constraints", F.array().cast("array<string>"))) >= 4), (F.regexp_count(_text("answer"), F.lit(T.AUDIT)) >= 110), (_text("bad_code") != ""), F.concat(_text("instruction"), F.lit("\n"), _text("answer")).rlike(IS_HARD))
    return F.when(sum(s.cast("int") for s in signs) >= 2, "intermediate").otherwise("basic")


def instruction_render(spark, d):
    return records(spark, d, *FIELDS).select("id", F.md5(rendered()).alias("rendered_md5"), F.char_length(rendered()).alias("chars"))


def inferred_fields(spark, d):
    r = records(spark, d, "instruction", "answer", "bad_code", "constraints").withColumn("language", infer_language())
    return r.select("id", "language", infer_category(F.col("language")).alias("category"), infer_difficulty().alias("difficulty"))


def inference_accuracy(spark, d):
    """Scores of inferred against stated languages: joined on id, per stated category and over all."""
    stated = records(spark, d, "language", "category").where("language is not null")
    j = inferred_fields(spark, d).select("id", F.col("language").alias("said")).join(stated, "id")
    return j.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("said") == F.col("language")).alias("correct"), F.grouping_id().alias("level")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 9))


def choice_scores(spark, d):
    """First standalone choice letter in each answer, or null; it is not compared with an expected one."""
    letter = F.regexp_extract(F.upper(T.strip(_text("answer"))), r"(?:^|[^A-Z0-9])([ABCD])(?:$|[^A-Z0-9])", 1)
    return records(spark, d, "answer", "category").select("id", F.when(letter != "", letter).alias("choice"))


def tag_parts(spark, d):
    """Bodies of the tags of the inventory's rendered texts: number of blocks and hash of the joined bodies."""
    r = inventory(spark, d, "rendered")
    out = [F.col("record_id")]
    for tag in LINT_TAGS[:5]:
        bodies = F.filter(F.transform(F.regexp_extract_all(_text("rendered"), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), T.strip), lambda x: x != "")
        out += [F.size(bodies).alias(f"{tag}_blocks"), F.md5(F.array_join(bodies, "\n\n")).alias(f"{tag}_md5")]
    return r.select(*out)


def tag_lint(spark, d):
    """(record_id, finding) for each break of the tag protocol in the rendered texts."""
    t = _text("rendered")
    opens, closes = (lambda tag: F.regexp_count(t, F.lit(rf"<{tag}(?:\s[^>]*)?>"))), (lambda tag: F.regexp_count(t, F.lit(f"</{tag}>")))
    body = F.regexp_extract(t, r"(?s)<answer>(.*?)</answer>", 1)
    ask = F.regexp_extract(t, r"(?s)<instruction>(.*?)</instruction>", 1)
    has, closed = t.contains("<instruction>"), t.rlike(r"(?s)<answer>.*?</answer>")
    rules = [*[(opens(x) != closes(x), f"unbalanced <{x}>") for x in LINT_TAGS], (has & (T.strip(ask) == ""), "empty or malformed instruction"), (has & ~closed, "no answer"), (closed & (T.strip(body) == ""), "empty answer"),
             (F.char_length(T.strip(body)) > 5000, "answer over 5000 characters"), (closed & (F.instr(t, "<answer>") < F.instr(t, "</instruction>")), "answer before instruction closes"), (t.contains("<bad_code>") & ~t.contains("<reasoning>"), "bad code without reasoning")]
    return inventory(spark, d, "rendered").select("record_id", F.explode(R.reasons(*rules)).alias("finding"))


def row_validation(spark, d):
    """(id, finding) for each constraint that an accepted row breaks; repeated ids count as a finding."""
    rows = table(spark, d, ACCEPTED, "id", "received_at", "language", "difficulty", "category", "instruction", "answer")
    n = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    blank = lambda c: T.strip(_text(c)) == ""
    rules = [*[(blank(c), f"empty {c}") for c in ("language", "category", "difficulty", "instruction", "answer")], (~blank("language") & ~label("language").isin(*LANGUAGES), "unknown language"),
             (~blank("difficulty") & ~label("difficulty").isin(*DIFFICULTIES), "unknown difficulty"), (F.col("n") > 1, "repeated id"), (F.col("id") != F.regexp_replace(F.regexp_replace(F.lower(T.strip("id")), "[^a-z0-9_]+", "_"), "_+", "_"), "id is not clean")]
    return rows.join(n, "id").select("id", F.explode(R.reasons(*rules)).alias("finding")).distinct()


def secondary_tags(spark, d):
    low = F.lower(_text("rendered"))
    return inventory(spark, d, "rendered").select("record_id", F.explode(R.reasons(*[(low.rlike(p), tag) for tag, p in TAGS.items()])).alias("tag"))


def capability_gaps(spark, d):
    """Records with each capability, by category, language or secondary tag, against the wanted number."""
    low = F.lower(_text("rendered"))
    r = inventory(spark, d, "rendered", "language", "category").select("language", "category", *[low.rlike(p).alias(f"t_{t}") for t, p in TAGS.items()])
    hits = []
    for name, (categories, tags, languages, _) in CAPABILITIES.items():
        hit = F.coalesce(F.col("category").isin(*categories), F.lit(False))
        for t in tags:
            hit = hit | F.col(f"t_{t}")
        if languages:
            hit = hit | F.coalesce(F.col("language").isin(*languages), F.lit(False))
        hits.append(F.count_if(hit).alias(name))
    one = r.agg(*hits)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("capability"), F.col(n).alias("records"), F.lit(c[3]).alias("wanted")) for n, c in CAPABILITIES.items()]))
    return one.select(rows.alias("x")).select("x.capability", "x.records", "x.wanted", F.round(F.col("x.records") / F.col("x.wanted"), 4).alias("progress"), F.greatest(F.lit(0), F.col("x.wanted") - F.col("x.records")).alias("remaining"))


def pattern_counts(spark, d):
    """Records and places with each pattern, in one pass."""
    r = inventory(spark, d, "rendered").select(*[F.regexp_count(_text("rendered"), F.lit(f"(?im){p}")).alias(n) for n, p in PATTERNS.items()])
    one = r.agg(*[F.count_if(F.col(n) > 0).alias(f"r_{n}") for n in PATTERNS], *[F.sum(n).alias(f"o_{n}") for n in PATTERNS])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"r_{n}").alias("records"), F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("occurrences")) for n in PATTERNS]))
    return one.select(rows.alias("x")).select("x.*")


def record_lengths(spark, d):
    """Audit-token length profile of each accepted record."""
    size = lambda c: F.regexp_count(c, F.lit(T.AUDIT))
    r = records(spark, d, *FIELDS).withColumn("rendered", rendered())
    parts = r.select("id", size(_text("instruction")).alias("instruction_tokens"), size(F.array_join(F.coalesce("constraints", F.array().cast("array<string>")), "\n")).alias("constraints_tokens"), size(_text("bad_code")).alias("bad_code_tokens"), size(_text("reasoning")).alias("reasoning_tokens"),
                     size(_text("answer")).alias("answer_tokens"), size("rendered").alias("full_record_tokens"), F.char_length("rendered").alias("characters"), (F.regexp_count("rendered", F.lit("\n")) + 1).alias("lines"))
    return parts.withColumn("supervised_percentage", F.round(F.when(F.col("full_record_tokens") > 0, F.col("answer_tokens") / F.col("full_record_tokens") * 100).otherwise(F.lit(0.0)), 3))


def length_outliers(spark, d, context: int = 256):
    """Records over the context, with an over-long answer, or with under a tenth of supervised tokens."""
    return record_lengths(spark, d).where((F.col("full_record_tokens") > context) | (F.col("answer_tokens") > max(96, context // 2)) | (F.col("supervised_percentage") < 10)).select("id", "full_record_tokens", "answer_tokens", "supervised_percentage")


def _folded(stage: Stage, d, field: str) -> DataFrame:
    """(key, id, runs): one row for each normal form of a field of the latest records, with its least id; written.

    Texts are shuffled once, by normal form; ids travel with hashes only."""
    rows = table(stage.spark, d, ACCEPTED, "id", "received_at", *(FIELDS if field == "rendered" else (field,))).where("id is not null")
    value = rendered() if field == "rendered" else _text(field)
    rows = rows.select("id", "received_at", value.alias("raw")).withColumn("v", T.normalize_text("raw")).withColumn("h", F.when(F.col("v") != "", F.xxhash64("v")))
    last = F.max_by(F.struct("h"), F.coalesce(F.unix_micros("received_at"), F.lit(-1)))  # as in `records`
    first = stage.put_each([lambda: rows.groupBy("id").agg(last.alias("l")).where("l.h is not null").groupBy("l.h").agg(F.min("id").alias("id"))], f"{field}_first")
    one = rows.where("h is not null").groupBy("h").agg(F.min("raw").alias("raw")).join(first, "h").select("id", T.trigrams("raw").alias("runs"))
    return stage.put_each([lambda: one.withColumn("key", F.monotonically_increasing_id())], f"{field}_classes").select("key", "id", "runs")


DUPLICATE_FIELDS = {"instruction": Fraction(1, 2), "answer": Fraction(17, 25), "rendered": Fraction(14, 25)}


def duplicate_links(spark, d):
    """(field, class_a, class_b, score): distinct normal forms of a field whose trigram sets are alike, by their least ids.

    The fields are done one after another, and the tables of one are gone before the next, so the disk holds one field's."""
    found = Stage(spark, "links")

    def links(field: str, t: Fraction) -> DataFrame:
        stage = Stage(spark, f"dup_{field}")
        classes = _folded(stage, d, field)
        s = similar_sets(stage, classes.select("key", "runs"), t, field)
        j = s.join(classes.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(classes.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
        one = j.select(F.lit(field).alias("field"), F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), F.round("score", 6).alias("score"))
        one = found.put_each([lambda: one], field)
        stage.drop_all()
        return one

    return reduce(DataFrame.unionByName, [links(field, t) for field, t in DUPLICATE_FIELDS.items()])


def duplicate_classes(spark, d):
    """(field, id, class_id, copies): records whose field has the same normal form as another's."""
    r = records(spark, d, *FIELDS)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), T.normalize_text(rendered() if f == "rendered" else _text(f)).alias("v")) for f in DUPLICATE_FIELDS])
    rows = r.select("id", F.explode(fields).alias("x")).where("x.v <> ''").select("id", "x.field", F.sha2("x.v", 256).alias("h"))
    many = rows.groupBy("field", "h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(many, ["field", "h"]).select("field", "id", "class_id", "copies")


def structure_classes(spark, d):
    """(id, class_id, members): answers of one code structure (names, literals and comments masked) but other texts."""
    r = records(spark, d, "answer", "language").where(F.coalesce(F.col("language"), F.lit("")) != "text").where(F.regexp_count(_text("answer"), F.lit(T.AUDIT)) >= 12)
    rows = r.select("id", F.sha2(T.normalize_text(_text("answer")), 256).alias("v"), structure(_text("answer"), F.coalesce(F.col("language"), F.lit(""))).alias("s")).where("s <> ''")
    g = rows.groupBy("s").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").drop("a", "b")
    return rows.join(g, "s").select("id", "class_id", "members")


def _terms() -> Column:
    """Distinctive terms of a held-out row."""
    every = F.filter(F.transform(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("required_terms", "forbidden_terms")]), T.strip), lambda x: x.isNotNull())

    def kept(x: Column) -> Column:
        n, k = T.normalize_text(x), F.regexp_count(x, F.lit(T.AUDIT))
        return (n != "") & ~n.isin(*GENERIC_TERMS) & ((x.rlike(r"""[.()$:<>=\[\]{}'"]""") & (F.char_length(n) >= 6)) | ((k >= 1) & (F.char_length(n) >= 12)))

    return F.filter(every, kept)


def heldout_contained(spark, d):
    """(record_id, eval_id, field) where a record's canonical text contains a prompt, test code, test line or term of a
    held-out item. All strings are searched at once by automata of bounded size."""
    h = table(spark, d, HELDOUT, "id", "prompt", "test_code", "required_terms", "forbidden_terms").where("id is not null")
    canon = lambda c: T.canonical_text(c)
    lines = F.transform(T.lines(_text("test_code")), lambda x: F.struct(F.lit("test_fixture_line").alias("field"), canon(x).alias("s"), F.lit(24).alias("least")))
    terms = F.transform(_terms(), lambda x: F.struct(F.lit("required_or_forbidden_term").alias("field"), canon(x).alias("s"), F.lit(1).alias("least")))
    whole = F.array(F.struct(F.lit("prompt").alias("field"), canon(_text("prompt")).alias("s"), F.lit(1).alias("least")), F.struct(F.lit("test_code").alias("field"), canon(_text("test_code")).alias("s"), F.lit(30).alias("least")))
    needles = h.select("id", F.explode(F.concat(whole, lines, terms)).alias("x")).where("char_length(x.s) >= x.least").select("id", "x.field", "x.s").distinct()
    texts = inventory(spark, d, "rendered").select(F.col("record_id").alias("key"), canon(_text("rendered")).alias("t"))
    return contained(spark, texts, needles.select(F.col("id").alias("eval_id"), "field", "s")).select(F.col("key").alias("record_id"), "eval_id", "field").distinct()


#: Trigrams of held-out items that are sent to all executors at once; more of them take more passes over the records.
GRAMS_AT_ONCE = 500_000
#: (held-out column, least Jaccard, record fields of which the better one counts).
SIMILAR = (("prompt", 0.42, ("instruction",)), ("expected_behavior_notes", 0.55, ("instruction", "answer")))


def heldout_similar(spark, d):
    """(id, eval_id, field, score): instructions whose trigrams are like those of a held-out prompt (0.42 or more), and records
    of which instruction or answer is like its behaviour notes (0.55 or more); one row for each of the two."""
    h = table(spark, d, HELDOUT, "id", *[c for c, _, _ in SIMILAR]).where("id is not null")
    items = F.array(*[F.struct(F.lit(c).alias("what"), F.lit(least).alias("least"), F.array(*map(F.lit, fields)).alias("fields"), T.trigrams(_text(c)).alias("p")) for c, least, fields in SIMILAR])
    stage = Stage(spark, "heldout")
    q = stage.put(h.select(F.col("id").alias("eval_id"), F.explode(items).alias("x")).select("eval_id", "x.*"), "items")
    grams = stage.put(q.select("eval_id", "what", "least", F.size("p").alias("m"), F.explode("fields").alias("field"), "p").withColumn("g", F.explode("p")).drop("p"), "grams")
    passes = max(1, -(-grams.count() // GRAMS_AT_ONCE))
    sides = F.array(*[F.struct(F.lit(c).alias("field"), T.trigrams(_text(c)).alias("runs")) for c in ("instruction", "answer")])
    r = records(spark, d, "instruction", "answer").select("id", F.explode(sides).alias("x")).select("id", "x.field", F.size("x.runs").alias("n"), F.explode("x.runs").alias("g"))
    score = F.col("i") / (F.col("n") + F.col("m") - F.col("i"))

    def met(k: int) -> DataFrame:
        """Of the items of one part, with all their grams; only texts are shuffled, by id, where their grams are met too."""
        part = F.broadcast(grams.where(F.pmod(F.xxhash64("eval_id"), F.lit(passes)) == k))
        near = r.join(part, ["field", "g"]).where(F.least("n", "m") / F.greatest("n", "m") >= F.col("least"))
        shared = near.groupBy("id", "eval_id", "what", "least", "field", "n", "m").agg(F.count(F.lit(1)).alias("i"))
        return shared.where(score >= F.col("least")).groupBy("id", "eval_id", F.col("what").alias("field")).agg(F.max(score).alias("score"))

    return stage.put_each([lambda k=k: met(k) for k in range(passes)], "met").select("id", "eval_id", "field", F.round("score", 6).alias("score"))


def nearest_heldout(spark, d):
    """For each held-out prompt the most similar instruction by word trigrams, and whether one is equal."""
    grams = lambda c: T.window_hashes(F.split(T.normalize_words(c), " "), 3)
    stage = Stage(spark, "nearest")
    q = stage.put(table(spark, d, HELDOUT, "id", "prompt").where("id is not null").select(F.col("id").alias("key"), grams(_text("prompt")).alias("runs"), T.normalize_words(_text("prompt")).alias("v")), "prompts")
    r = stage.put(records(spark, d, "instruction").select(F.col("id").alias("key"), grams(_text("instruction")).alias("runs"), T.normalize_words(_text("instruction")).alias("v")), "records")
    same = q.join(r.select("v").distinct(), "v", "left_semi").select("key", F.lit(True).alias("exact"))
    best = best_match(q.select("key", "runs"), r.select("key", "runs"))
    return q.select("key").join(best, "key", "left").join(same, "key", "left").select(F.col("key").alias("eval_id"), F.col("best").alias("id"), F.round("score", 9).alias("score"), F.coalesce("exact", F.lit(False)).alias("exact"))


def inventory_match(spark, d):
    """Ids of one side only: accepted ids that the inventory lacks, and inventory records that are not accepted."""
    a = records(spark, d, "language").select("id").withColumn("a", F.lit(True))
    b = inventory(spark, d, "source_kind").select(F.col("record_id").alias("id")).withColumn("b", F.lit(True))
    return a.join(b, "id", "full_outer").where("a is null or b is null").select("id", F.when(F.col("a").isNull(), "inventory_only").otherwise("accepted_only").alias("side"))


#: Limits of the queue for sizes in lexical tokens, which overestimate: a quarter over the context, three quarters of it for answers.
QUEUE_RECORD, QUEUE_ANSWER, QUEUE_SHARE = 320, 192, 10


def review_findings(spark, d):
    """(finding, priority, record_id, related_id, field, score, reason): duplicates, held-out overlap and severe sizes.

    Equal normal forms and contained prompts or test code are critical, all else is for review; informational terms are
    left out. A class of copies points to its least id, so copies are rows, not pairs."""
    none = F.lit(None).cast("string")
    row = lambda df, finding, priority, record, related, field, score, reason: df.select(F.lit(finding).alias("finding"), F.lit(priority).alias("priority") if isinstance(priority, str) else priority.alias("priority"), F.col(record).alias("record_id"), (F.col(related) if isinstance(related, str) else related).alias("related_id"), field.alias("field"), score.cast("double").alias("score"), reason.alias("reason"))
    rules = R.reasons((F.col("full_record_tokens") > QUEUE_RECORD, "long record"), (F.col("answer_tokens") > QUEUE_ANSWER, "long answer"), (F.col("supervised_percentage") < QUEUE_SHARE, "little supervision"))

    def same():
        return row(duplicate_classes(spark, d).where("id <> class_id"), "duplicate", "critical", "id", "class_id", F.col("field"), F.lit(1.0), F.lit("equal normal form"))

    def near():
        return row(duplicate_links(spark, d), "duplicate", "review", "class_a", "class_b", F.col("field"), F.col("score"), F.lit("similar trigrams"))

    def leak():
        found = heldout_contained(spark, d).where("field <> 'required_or_forbidden_term'")
        return row(found, "eval_leakage", F.when(F.col("field") == "test_fixture_line", "review").otherwise("critical"), "record_id", "eval_id", F.col("field"), F.lit(1.0), F.lit("contained"))

    def alike():
        return row(heldout_similar(spark, d), "eval_leakage", "review", "id", "eval_id", F.col("field"), F.col("score"), F.lit("similar trigrams"))

    def long():
        found = record_lengths(spark, d).select("id", "full_record_tokens", F.array_join(rules, "; ").alias("why")).where("why <> ''")
        return row(found, "context_or_supervision", "review", "id", none, F.lit("full_record_tokens"), F.col("full_record_tokens"), F.col("why"))

    # One kind after another, so the disk holds the shuffled texts of one.
    return Stage(spark, "findings").put_each([same, near, leak, alike, long], "rows")


def review_queue(spark, d):
    """`review_findings` with answers of one code structure, blank reviewer columns and an id for each finding, in the
    order of priority, kind and ids."""
    shape = lambda: structure_classes(spark, d).where("id <> class_id").select(F.lit("duplicate").alias("finding"), F.lit("review").alias("priority"), F.col("id").alias("record_id"), F.col("class_id").alias("related_id"), F.lit("answer").alias("field"), F.lit(1.0).alias("score"), F.lit("equal code structure").alias("reason"))
    rows = review_findings(spark, d).unionByName(Stage(spark, "findings").put_each([shape], "shape"))
    blank = [F.lit("").alias(c) for c in ("reviewer_decision", "action", "notes")]
    return rows.select(F.concat_ws(":", "finding", "record_id", "related_id", "field", "reason").alias("finding_id"), *rows.columns, *blank).orderBy(F.when(F.col("priority") == "critical", 0).otherwise(1), "finding", "record_id", "related_id", "field")


#: Paths that are let in: a folder and a pattern.
PATH_GLOBS = ("data/incoming/", "*.txt")


def path_profile(spark, d):
    """Suffix, language, family and path rule of each distinct source path of the inventory."""
    p = table(spark, d, INVENTORY, "source_path", "source_kind").where("source_path is not null").select("source_path", label("source_kind").alias("source_kind")).distinct()
    return p.select("source_path", "source_kind", R.suffix("source_path").alias("suffix"), R.language_hint("source_path").alias("language_hint"), R.family_hint("source_kind", "source_path").alias("family_hint"), R.path_reason("source_path").alias("refused"), R.matches_any(F.col("source_path"), PATH_GLOBS).alias("allowed"))


def _latest(table_: str, key: str, at: str, columns: tuple) -> str:
    pack = ", ".join(f"'{c}': {c}" for c in columns)
    return f"(SELECT {key}, " + ", ".join(f"r.{c} AS {c}" for c in columns) + f" FROM (SELECT {key}, arg_max({{{pack}}}, coalesce(epoch_us({at}), -1)) AS r FROM {table_} WHERE {key} IS NOT NULL GROUP BY {key}))"


def _inv(*columns: str) -> str:
    pack = ", ".join(["'at': audited_at", *[f"'{c}': {c}" for c in columns]])
    return "(SELECT record_id, " + ", ".join(f"{'lower(trim(r.' + c + '))' if c in ('language', 'category', 'source_kind') else 'r.' + c} AS {c}" for c in columns) + f" FROM (SELECT record_id, max({{{pack}}}) AS r FROM {INVENTORY} WHERE record_id IS NOT NULL GROUP BY record_id))"


_N = lambda c: f"coalesce({c}, '')"
_REC = _latest(ACCEPTED, "id", "received_at", FIELDS)
_ITEMS = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {T.sql_strip('x')}), lambda x: coalesce(x, '') <> '')"
_BUL = lambda items: f"array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10))"
_NOTE = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN len({_ITEMS(c)}) > 0 THEN '{h}:' || chr(10) || {_BUL(_ITEMS(c))} END" for c, h in (("edge_cases", "Edge cases"), ("quality_notes", "Quality notes"))) + ")"
_BLK = lambda tag, body: f"'<{tag}>' || chr(10) || {body} || chr(10) || '</{tag}>'"
_FULL = lambda c: T.sql_strip(_N(c))
_RENDER = f"concat_ws(chr(10), {_BLK('instruction', _FULL('instruction'))}, {_BLK('constraints', _BUL('coalesce(constraints, [])'))}, CASE WHEN {_FULL('bad_code')} <> '' THEN {_BLK('bad_code', _FULL('bad_code'))} END, CASE WHEN {_FULL('reasoning')} <> '' THEN {_BLK('reasoning', _FULL('reasoning'))} END, {_BLK('answer', _FULL('answer'))}, CASE WHEN {_NOTE} <> '' THEN {_BLK('reasoning', _NOTE)} END)"
_LOW, _ASK = f"lower({_N('instruction')} || chr(10) || {_N('answer')})", f"lower({_N('instruction')})"
_HIT = lambda c, p: R._found(c, p)
_LANG = "CASE " + " ".join(f"WHEN contains({_LOW}, '{n}') OR {_HIT(_LOW, p)} THEN '{n}'" for n, p in (("powershell", IS_POWERSHELL), ("typescript", IS_TYPESCRIPT), ("javascript", IS_JAVASCRIPT), ("sql", IS_SQL))) + f" WHEN {_HIT(_ASK, IS_TALK)} AND NOT {_HIT(_ASK, IS_CODE)} THEN 'text' ELSE 'python' END"
_CAT = f"CASE WHEN {_N('bad_code')} <> '' THEN 'debugging' " + " ".join(f"WHEN {_HIT(_ASK if n == 'explanation' else _LOW, p)}{' OR inferred = ' + chr(39) + 'sql' + chr(39) if n == 'database' else ' OR inferred = ' + chr(39) + 'text' + chr(39) if n == 'explanation' else ''} THEN '{n}'" for n, p in CATEGORY) + " ELSE 'function' END"
_AUD = lambda c: f"len(regexp_extract_all({c}, '{T.AUDIT}'))"
_DIF = f"CASE WHEN (len(coalesce(constraints, [])) >= 4)::INT + ({_AUD(_N('answer'))} >= 110)::INT + ({_N('bad_code')} <> '')::INT + ({_HIT(_N('instruction') + ' || chr(10) || ' + _N('answer'), IS_HARD)})::INT >= 2 THEN 'intermediate' ELSE 'basic' END"
_INF = f"(SELECT id, inferred AS language, {_CAT} AS category, {_DIF} AS difficulty FROM (SELECT *, {_LANG} AS inferred FROM {_REC}))"
_CLOSED = r"regexp_matches(rendered, '(?s)<answer>.*?</answer>')"
_LINT = R.sql_reasons(
    *[(f"len(regexp_extract_all(rendered, '<{x}(?:\\s[^>]*)?>')) <> len(regexp_extract_all(rendered, '</{x}>'))", f"unbalanced <{x}>") for x in LINT_TAGS],
    ("contains(rendered, '<instruction>') AND " + T.sql_strip("regexp_extract(rendered, '(?s)<instruction>(.*?)</instruction>', 1)") + " = ''", "empty or malformed instruction"), (f"contains(rendered, '<instruction>') AND NOT {_CLOSED}", "no answer"),
    (f"{_CLOSED} AND " + T.sql_strip("regexp_extract(rendered, '(?s)<answer>(.*?)</answer>', 1)") + " = ''", "empty answer"), ("length(" + T.sql_strip("regexp_extract(rendered, '(?s)<answer>(.*?)</answer>', 1)") + ") > 5000", "answer over 5000 characters"),
    (f"{_CLOSED} AND instr(rendered, '<answer>') < instr(rendered, '</instruction>')", "answer before instruction closes"), ("contains(rendered, '<bad_code>') AND NOT contains(rendered, '<reasoning>')", "bad code without reasoning"),
)
_BLANK = lambda c: f"{T.sql_strip(_N(c))} = ''"
_VALID = R.sql_reasons(
    *[(_BLANK(c), f"empty {c}") for c in ("language", "category", "difficulty", "instruction", "answer")], (f"NOT {_BLANK('language')} AND lower(trim(language)) NOT IN {LANGUAGES}", "unknown language"),
    (f"NOT {_BLANK('difficulty')} AND lower(trim(difficulty)) NOT IN {DIFFICULTIES}", "unknown difficulty"), ("n > 1", "repeated id"), (f"id <> regexp_replace(regexp_replace(lower({T.sql_strip('id')}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g')", "id is not clean"),
)
_LENGTHS = f"""(SELECT *, round(CASE WHEN full_record_tokens > 0 THEN answer_tokens / full_record_tokens * 100 ELSE 0.0 END, 3) AS supervised_percentage FROM (SELECT id, {_AUD(_N('instruction'))} AS instruction_tokens, {_AUD("array_to_string(coalesce(constraints, []), chr(10))")} AS constraints_tokens, {_AUD(_N('bad_code'))} AS bad_code_tokens,
  {_AUD(_N('reasoning'))} AS reasoning_tokens, {_AUD(_N('answer'))} AS answer_tokens, {_AUD('rendered')} AS full_record_tokens, length(rendered) AS characters, len(regexp_extract_all(rendered, '\\n')) + 1 AS lines FROM (SELECT *, {_RENDER} AS rendered FROM {_REC})))"""
_OUTLIER = f"SELECT id, full_record_tokens, answer_tokens, supervised_percentage FROM {_LENGTHS} WHERE full_record_tokens > 256 OR answer_tokens > 128 OR supervised_percentage < 10"
_CLASSES = f"""WITH f AS (SELECT id, unnest([{{'f': 'instruction', 'v': {T.sql_normalize(_N('instruction'))}}}, {{'f': 'answer', 'v': {T.sql_normalize(_N('answer'))}}}, {{'f': 'rendered', 'v': {T.sql_normalize(_RENDER)}}}]) AS x FROM {_REC}),
  t AS (SELECT id, x.f AS field, x.v AS v FROM f WHERE x.v <> ''), g AS (SELECT field, v, min(id) AS class_id, count(*) AS copies FROM t GROUP BY field, v HAVING count(*) > 1) SELECT field, id, class_id, copies FROM t JOIN g USING (field, v)"""
_GRAM = lambda c: f"list_transform(regexp_extract_all({c}, '{T.AUDIT}'), lambda x: lower(x))"
_TERM = f"""list_filter(list_transform(list_concat(coalesce(required_terms, []), coalesce(forbidden_terms, [])), lambda x: {T.sql_strip('x')}), lambda x: {T.sql_normalize('x')} <> '' AND {T.sql_normalize('x')} NOT IN {GENERIC_TERMS} AND ((regexp_matches(x, '[.()$:<>=\\[\\]{{}}''"]') AND length({T.sql_normalize('x')}) >= 6) OR ({_AUD('x')} >= 1 AND length({T.sql_normalize('x')}) >= 12)))"""
_CONTAINED = f"""WITH h AS (SELECT id, coalesce(prompt, '') AS prompt, coalesce(test_code, '') AS test_code, required_terms, forbidden_terms FROM {HELDOUT} WHERE id IS NOT NULL),
  s AS (SELECT id, 'prompt' AS field, {T.sql_canonical('prompt')} AS s, 1 AS least FROM h UNION SELECT id, 'test_code', {T.sql_canonical('test_code')}, 30 FROM h UNION SELECT id, 'test_fixture_line', {T.sql_canonical('x')}, 24 FROM (SELECT id, unnest({T.sql_lines('test_code')}) AS x FROM h)
  UNION SELECT id, 'required_or_forbidden_term', {T.sql_canonical('x')}, 1 FROM (SELECT id, unnest({_TERM}) AS x FROM h)),
  t AS (SELECT record_id, {T.sql_canonical(_N('rendered'))} AS t FROM {_inv('rendered')}) SELECT DISTINCT record_id, id AS eval_id, field FROM t JOIN s ON contains(t.t, s.s) AND length(s.s) >= least"""


def _pairs_sql() -> str:
    parts = []
    for field, t in DUPLICATE_FIELDS.items():
        value = _RENDER if field == "rendered" else _N(field)
        parts.append(f"""SELECT '{field}' AS field, least(p.id, q.id) AS class_a, greatest(p.id, q.id) AS class_b, round(i / (p.n + q.n - i), 6) AS score FROM (
  WITH c AS (SELECT {T.sql_normalize('raw')} AS v, min(id) AS id, any_value(raw) AS raw FROM (SELECT id, {value} AS raw FROM {_REC}) GROUP BY 1 HAVING v <> ''), k AS (SELECT id, {_GRAM('raw')} AS k FROM c),
  g AS (SELECT id, unnest({T.sql_windows('k', 3)}) AS g FROM k), n AS (SELECT id, count(*) AS n FROM g GROUP BY id)
  SELECT {{'id': a.id, 'n': any_value(na.n)}} AS p, {{'id': b.id, 'n': any_value(nb.n)}} AS q, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY a.id, b.id) WHERE i * {t.denominator} >= (p.n + q.n - i) * {t.numerator}""")
    return " UNION ALL ".join(parts)


_SIDE = lambda what, fields, least: f"""SELECT id, eval_id, '{what}' AS field, round(max(score), 6) AS score FROM (
  WITH q AS (SELECT id AS eval_id, unnest({T.sql_windows(_GRAM(_N(what)), 3)}) AS g FROM {HELDOUT} WHERE id IS NOT NULL), r AS ({" UNION ALL ".join(f"SELECT id, '{f}' AS f, unnest({T.sql_windows(_GRAM(_N(f)), 3)}) AS g FROM {_REC}" for f in fields)}),
  m AS (SELECT eval_id, count(*) AS m FROM q GROUP BY 1), n AS (SELECT id, f, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT id, f, eval_id, count(*) AS i FROM r JOIN q USING (g) GROUP BY ALL)
  SELECT id, eval_id, i / (n + m - i) AS score FROM i JOIN n USING (id, f) JOIN m USING (eval_id)) WHERE score >= {least} GROUP BY id, eval_id"""  # noqa: E731
_SIMILAR = " UNION ALL ".join(_SIDE(what, fields, least) for what, least, fields in SIMILAR)
_QUEUE = R.sql_reasons((f"full_record_tokens > {QUEUE_RECORD}", "long record"), (f"answer_tokens > {QUEUE_ANSWER}", "long answer"), (f"supervised_percentage < {QUEUE_SHARE}", "little supervision"))
_NAME = "regexp_extract(lower(source_path), '([^/]*)/*$', 1)"
_SUFFIX = f"CASE WHEN {_NAME} IN ('makefile', 'readme', 'license', 'copying', 'copyright') THEN {_NAME} WHEN regexp_matches({_NAME}, '^.+\\.d\\.ts$') THEN '.d.ts' ELSE regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1) END"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"
_FOLDERS = lambda c: f"list_filter(string_split({c}, '/'), lambda x: x <> '')"
_BAD = f"list_filter({_FOLDERS('lower(source_path)')}, lambda x: x IN {_IN(R.PATH_PARTS)})[1]"
_LAST = f"{_FOLDERS('lower(source_path)')}[-1]"
_PATHS = f"""WITH p AS (SELECT DISTINCT source_path, lower(trim(source_kind)) AS source_kind FROM {INVENTORY} WHERE source_path IS NOT NULL), q AS (SELECT *, {_SUFFIX} AS suffix, {_FOLDERS('source_path')} AS parts FROM p)
  SELECT source_path, source_kind, suffix, CASE {" ".join(f"WHEN suffix IN {_IN(ends)} THEN '{n}'" for n, ends in R.LANGUAGE_OF.items())} ELSE 'other_text' END AS language_hint, source_kind || ':' || CASE WHEN len(parts) = 0 THEN 'root' ELSE array_to_string(parts[1:least(3, greatest(1, len(parts) - 1))], '/') END AS family_hint,
  CASE WHEN {_BAD} IS NOT NULL THEN 'path marker rejected: ' || {_BAD} WHEN {_LAST} IN {_IN(R.FILE_NAMES)} THEN 'low-value filename rejected: ' || {_LAST} END AS refused, {" OR ".join(f"regexp_matches(regexp_replace(replace(source_path, chr(92), '/'), '^/+', ''), '{R.glob_pattern(g)}')" for g in PATH_GLOBS)} AS allowed FROM q"""
_WG = lambda c: T.sql_windows(f"string_split({T.sql_words(c)}, ' ')", 3)
SQL = {
    "instruction_render": f"SELECT id, md5(r) AS rendered_md5, length(r) AS chars FROM (SELECT id, {_RENDER} AS r FROM {_REC})",
    "inferred_fields": f"SELECT * FROM {_INF}",
    "inference_accuracy": f"SELECT category, count(*) AS total, count(*) FILTER (said = language) AS correct, grouping(category) AS level, round(correct / total, 9) AS accuracy FROM (SELECT i.language AS said, lower(trim(r.language)) AS language, lower(trim(r.category)) AS category FROM {_INF} i JOIN {_REC} r USING (id) WHERE r.language IS NOT NULL) GROUP BY ROLLUP (category)",
    "choice_scores": f"SELECT id, nullif(regexp_extract(upper({_FULL('answer')}), '(?:^|[^A-Z0-9])([ABCD])(?:$|[^A-Z0-9])', 1), '') AS choice FROM {_REC}",
    "tag_parts": "SELECT record_id, " + ", ".join(f"len(b_{t}) AS {t}_blocks, md5(array_to_string(b_{t}, chr(10) || chr(10))) AS {t}_md5" for t in LINT_TAGS[:5]) + " FROM (SELECT record_id, " + ", ".join(f"list_filter(list_transform(regexp_extract_all(coalesce(rendered, ''), '(?is)<{t}(?:\\s[^>]*)?>(.*?)</{t}>', 1), lambda x: {T.sql_strip('x')}), lambda x: x <> '') AS b_{t}" for t in LINT_TAGS[:5]) + f" FROM {_inv('rendered')})",
    "tag_lint": f"SELECT record_id, unnest({_LINT}) AS finding FROM (SELECT record_id, coalesce(rendered, '') AS rendered FROM {_inv('rendered')})",
    "row_validation": f"SELECT DISTINCT id, unnest({_VALID}) AS finding FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {ACCEPTED} WHERE id IS NOT NULL)",
    "secondary_tags": f"SELECT record_id, unnest({R.sql_reasons(*[(_HIT('r', p), t) for t, p in TAGS.items()])}) AS tag FROM (SELECT record_id, lower(coalesce(rendered, '')) AS r FROM {_inv('rendered')})",
    "capability_gaps": "WITH t AS (SELECT language, category, " + ", ".join(f"{_HIT('r', p)} AS t_{t}" for t, p in TAGS.items()) + f" FROM (SELECT *, lower(coalesce(rendered, '')) AS r FROM {_inv('rendered', 'language', 'category')})), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS capability, count(*) FILTER (coalesce(category IN ({', '.join(repr(x) for x in cs)}), false)" + "".join(f" OR t_{t}" for t in ts) + "".join(f" OR coalesce(language = '{x}', false)" for x in ls) + f") AS records, {w} AS wanted FROM t" for n, (cs, ts, ls, w) in CAPABILITIES.items())
    + ") SELECT capability, records, wanted, round(records / wanted, 4) AS progress, greatest(0, wanted - records) AS remaining FROM c",
    "pattern_counts": " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) FILTER (len(m) > 0) AS records, coalesce(sum(len(m)), 0)::BIGINT AS occurrences FROM (SELECT regexp_extract_all(coalesce(rendered, ''), '(?im){p}') AS m FROM {_inv('rendered')})" for n, p in PATTERNS.items()),
    "record_lengths": f"SELECT * FROM {_LENGTHS}",
    "length_outliers": _OUTLIER,
    "duplicate_links": _pairs_sql(),
    "duplicate_classes": _CLASSES,
    "heldout_contained": _CONTAINED,
    "heldout_similar": _SIMILAR,
    "nearest_heldout": f"""WITH p AS (SELECT id AS eval_id, {T.sql_words(_N('prompt'))} AS v, {_WG(_N('prompt'))} AS w FROM {HELDOUT} WHERE id IS NOT NULL), a AS (SELECT id, {T.sql_words(_N('instruction'))} AS v, {_WG(_N('instruction'))} AS w FROM {_REC}), q AS (SELECT eval_id, len(w) AS m, unnest(w) AS g FROM p), r AS (SELECT id, len(w) AS n, unnest(w) AS g FROM a),
  s AS (SELECT eval_id, id, count(*) / (any_value(n) + any_value(m) - count(*)) AS score FROM r JOIN q USING (g) GROUP BY ALL), b AS (SELECT eval_id, max(score) AS score FROM s GROUP BY 1), t AS (SELECT eval_id, score, min(id) AS id FROM s JOIN b USING (eval_id, score) GROUP BY ALL) SELECT p.eval_id, t.id, round(t.score, 9) AS score, p.v IN (SELECT v FROM a) AS exact FROM p LEFT JOIN t USING (eval_id)""",
    "inventory_match": f"WITH a AS (SELECT DISTINCT id FROM {ACCEPTED} WHERE id IS NOT NULL), b AS (SELECT DISTINCT record_id AS id FROM {INVENTORY} WHERE record_id IS NOT NULL) SELECT id, 'accepted_only' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'inventory_only' FROM b WHERE id NOT IN (SELECT id FROM a)",
    "path_profile": _PATHS,
    "review_findings": f"SELECT 'duplicate' AS finding, 'critical' AS priority, id AS record_id, class_id AS related_id, field, 1.0::DOUBLE AS score, 'equal normal form' AS reason FROM ({_CLASSES}) WHERE id <> class_id UNION ALL SELECT 'duplicate', 'review', class_a, class_b, field, score::DOUBLE, 'similar trigrams' FROM ({_pairs_sql()}) UNION ALL SELECT 'eval_leakage', CASE WHEN field = 'test_fixture_line' THEN 'review' ELSE 'critical' END, record_id, eval_id, field, 1.0, 'contained' FROM ({_CONTAINED}) WHERE field <> 'required_or_forbidden_term' UNION ALL SELECT 'eval_leakage', 'review', id, eval_id, field, score, 'similar trigrams' FROM ({_SIMILAR}) UNION ALL SELECT 'context_or_supervision', 'review', id, NULL, 'full_record_tokens', full_record_tokens::DOUBLE, why FROM (SELECT id, full_record_tokens, array_to_string({_QUEUE}, '; ') AS why FROM {_LENGTHS}) WHERE why <> \'\'",
}
QUERIES = {k: globals()[k] for k in SQL} | {"structure_classes": structure_classes, "review_queue": review_queue}
