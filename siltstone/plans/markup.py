"""Queries of the markup pipeline and of tokenizer profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markup as M
from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.functions.fingerprint import simhash64
from siltstone.operators.containment import contained
from siltstone.plans import audit
from siltstone.plans.corpus import DOCS, docs
from siltstone.plans.staging import Stage
from siltstone.sources.readers import protected_items
from siltstone.sources.tables import label, table

LEAST, MOST, SEGMENTS = 90, 420, 4
TOKENIZERS = "/opt/tokenizers"
#: Fixed values of the segment rules.
CODE_MARK = r"(?i)(?:#include|</?\w+>|[{};]{2,}|\b(?:function|return|var|let|const|def|class|public|private|namespace|printf|scanf)\b)"
WEAK_TITLE, LIST_TITLE = r"^(?:[A-Za-z]|[0-9]{1,4}|[IVXLCDM]+)$", r"(?i)(?:^|/)(?:list of|index of|glossary of|outline of)\b"
MARKERS = ("because", "therefore", "however", "if ", "when ", "before ", "after ", "unless ", "example")
TECHNICAL = ("function", "data", "program", "method", "test", "system", "logic")
OWNER_RUN, OWNED = 7, 0.86


def markup_segments(spark, d):
    """(doc_id, segment, tokens, text_sha256) of the cleaned pages, and how each page was cleaned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                plain, _ = M.clean(t)
                out += [(i, k, s) for k, s in enumerate(M.segments(M.paragraphs(plain), LEAST, MOST, SEGMENTS), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "segment", "text"])

    s = docs(spark, d, "text").mapInPandas(run, "doc_id long, segment int, text string")
    return s.select("doc_id", "segment", T.lexical_size("text").alias("tokens"), F.sha2("text", 256).alias("text_sha256"))


def page_reasons(spark, d):
    """(doc_id, reasons) for pages that the page rules refuse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [M.clean(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "raw": b["text"], "clean": [c for c, _ in got], "cleanup": [r for _, r in got], "parts": [len(M.paragraphs(c)) for c, _ in got]})

    p = docs(spark, d, "text").mapInPandas(run, "doc_id long, raw string, clean string, cleanup array<string>, parts int")
    n, chars = T.lexical_size("clean"), F.greatest(F.lit(1), F.char_length("clean"))
    residue = F.char_length("clean") - F.char_length(F.regexp_replace("clean", r"[{}\[\]|]", ""))
    own = R.reasons((F.col("raw").rlike(r"(?i)\b(stub|short description|authority control)\b") & (n < 180), "stub_or_metadata_dominated"), (F.col("parts") < 2, "too_few_coherent_paragraphs"), (n < 80, "too_short_after_cleaning"), (residue / chars > 0.015, "markup_residue"), *[(F.col("clean").rlike(x), f"possible_secret:{k}") for k, x in R.SECRETS])
    return p.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.concat(own, "cleanup"))), ",").alias("reasons")).where("reasons <> ''")


def _count(c: Column, chars: str) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, chars, ""))


def segment_rules(spark, d):
    """(doc_id, reasons): segment rules over each text as one segment."""
    t = docs(spark, d, "text").select("doc_id", T.strip("text").alias("t"))
    k = T.lexical_tokens("t", lower=False)
    s = t.select("doc_id", "t", F.greatest(F.lit(1), F.size(k)).alias("n"), F.size(F.filter(k, lambda x: x.rlike("^[0-9]+$"))).alias("digits"), F.regexp_count("t", F.lit(CODE_MARK)).alias("marks"))
    c = F.col("t")
    rules = R.reasons((c == "", "empty_segment"), (c.rlike(r"^\p{Ll}"), "starts_with_lowercase_fragment"), (_count(c, r"\$") >= 3, "currency_or_budget_fragment"), (F.col("marks") / F.col("n") > 0.035, "code_fragment_dominated"),
                      (_count(c, r"[{}\[\]|]") / F.greatest(F.lit(1), F.char_length(c)) > 0.01, "markup_or_code_residue"), (F.col("digits") / F.col("n") > 0.14, "number_table_or_date_heavy"))
    return s.select("doc_id", F.array_join(rules, ",").alias("reasons"))


def segment_score(spark, d):
    """(doc_id, score): additive quality of each text as one segment; the family id stands for its title."""
    t = docs(spark, d, "text", "family_id").withColumn("title", F.coalesce("family_id", F.lit("")))
    k = T.lexical_tokens("text", lower=False)
    parts = F.filter(F.split("text", "\n\n"), lambda x: T.strip(x) != "")
    ended = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"([.!?])[" + T.WS + r"]+", "$1\x02")), "\x02")
    sentences = F.size(F.filter(F.split(ended, "\x02"), lambda s: T.strip(s).rlike(r"""[.!?]['")\]]?$""")))
    s = t.select("doc_id", "title", F.lower("text").alias("low"), F.size(k).alias("n"), F.size(F.filter(k, lambda x: x.rlike("^[0-9]+$"))).alias("digits"), F.size(parts).alias("parts"), sentences.alias("sentences"))
    low = F.col("low")
    on = lambda c, v: F.when(c, v).otherwise(0)
    technical = F.lit(False)
    for x in TECHNICAL:
        technical = technical | low.contains(x)
    score = on(F.col("n").between(140, 420), 20) + on(F.col("parts") >= 2, 15) + on(F.col("sentences") >= 3, 15) + on(technical, 12) + on(F.col("title").rlike(LIST_TITLE), -30) + on(F.col("digits") / F.greatest(F.lit(1), F.col("n")) > 0.12, -15)
    for m in MARKERS:
        score = score + on(low.contains(m), 4)
    return s.select("doc_id", score.alias("score"))


def title_families(spark, d):
    """Documents per slug of the family's root before `/`, and of its file-name form."""
    t = docs(spark, d, "family_id", "source").where("family_id is not null").withColumn("source", label("source"))
    root = F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.element_at(F.split("family_id", "/"), 1))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return t.groupBy("source", F.when(root == "", "root").otherwise(root).alias("family")).agg(F.count(F.lit(1)).alias("documents"))


def corpus_contains_prompt(spark, d):
    """(eval_id, documents): held-out prompts whose normal form stands in a document's."""
    h = table(spark, d, audit.HELDOUT, "id", "prompt").where("id is not null and prompt is not null").select(F.col("id").alias("eval_id"), T.normalize_text("prompt").alias("s"))
    texts = docs(spark, d, "text").select(F.col("doc_id").cast("string").alias("key"), T.normalize_text("text").alias("t"))
    return contained(spark, texts, h).groupBy("eval_id").agg(F.count(F.lit(1)).alias("documents"))


#: Text columns of the held-out rows and of accepted records, and their lists of texts.
EVAL_TEXTS, EVAL_LISTS = ("id", "language", "category", "difficulty", "prompt", "test_code", "expected_behavior_notes", "suite", "split"), ("required_terms", "forbidden_terms")
RECORD_TEXTS, RECORD_LISTS = ("instruction", "answer", "bad_code", "reasoning"), ("constraints", "edge_cases")


def _strings(rows: DataFrame, kind: str, texts, lists) -> DataFrame:
    """(protected_id, text) of every text and list item of rows with an id."""
    named = [F.array(F.struct(F.lit(c).alias("field"), F.col(c).alias("text"))) for c in texts]
    items = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("field"), x.alias("text")))
    named += map(items, lists)
    return rows.select("id", F.explode(F.concat(*named)).alias("x")).select(F.concat_ws(":", F.lit(kind), "id", "x.field").alias("protected_id"), "x.text").where("text is not null")


def leak_findings(spark, d):
    """(doc_id, protected_id, source_kind, severity, overlap, containment): protected texts in documents, by their runs of
    five tokens and by containment.

    Protected are all strings of held-out rows from 24 characters on and the fields of accepted records from 60 on, each
    normal form once. A held-out text that is contained, or whose runs are there to 80 % (8 at least), is critical; from
    35 % on it is for review. A record's field is for review if contained (from 120 characters on) or there to 80 % (10
    runs at least). Texts without runs are searched for by automata. Held-out runs meet all documents that have them; a
    record's field meets documents through its rarest runs only, of which any such document has one.
    """
    stage = Stage(spark, "leaks")
    grams = lambda c: T.window_hashes(T.lexical_tokens(c), 5)
    held = table(spark, d, audit.HELDOUT, *EVAL_TEXTS, *EVAL_LISTS).where("id is not null")
    mine = audit.records(spark, d, *RECORD_TEXTS, *RECORD_LISTS)
    items = stage.put(protected_items(_strings(held, "evaluation", EVAL_TEXTS, EVAL_LISTS), _strings(mine, "instruction", RECORD_TEXTS, RECORD_LISTS)).withColumn("p", grams("text")).drop("text"), "items")
    pages = stage.put(docs(spark, d, "text").select("doc_id", T.normalize_text("text").alias("t"), grams("text").alias("g")), "pages")
    runs = pages.select("doc_id", F.explode("g").alias("run"))
    exam, field = items.where("source_kind = 'evaluation'"), items.where("source_kind = 'instruction'")
    met = runs.join(exam.select("protected_id", F.explode("p").alias("run")), "run").select("doc_id", "protected_id").distinct()
    # Of a field's runs, in the order of how many documents have them, one of the first fifth and two must be in any match.
    own = field.select("protected_id", F.size("p").alias("m"), F.explode("p").alias("run"))
    often = runs.join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    ordered = own.join(often, "run", "left").groupBy("protected_id", "m").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run"))).alias("c"))
    first = F.slice("c", F.lit(1), F.greatest(F.lit(3), F.floor(F.col("m") / 5) + 1).cast("int"))
    probes = ordered.select("protected_id", F.explode(first).alias("x")).where("x.df > 0").select("protected_id", F.col("x.run").alias("run"))
    met = met.union(runs.join(probes, "run").select("doc_id", "protected_id").distinct())
    short = contained(spark, pages.select(F.col("doc_id").cast("string").alias("key"), "t"), items.where("size(p) = 0").select("protected_id", F.col("normalized").alias("s")))
    met = stage.put(met.union(short.select(F.col("key").cast("long").alias("doc_id"), "protected_id")).distinct(), "met")
    full = met.join(items, "protected_id").join(pages, "doc_id").withColumn("overlap", F.size(F.array_intersect("g", "p")).cast("long")).withColumn("exact", F.col("t").contains(F.col("normalized")))
    part = F.coalesce(F.try_divide("overlap", F.size("p")), F.lit(0.0))
    exam_rule = F.when(F.col("exact") | (F.col("overlap") >= 8) & (part >= 0.8), "critical").when((F.col("overlap") >= 8) & (part >= 0.35), "review")
    field_rule = F.when(F.col("exact") & (F.char_length("normalized") >= 120) | (F.col("overlap") >= 10) & (part >= 0.8), "review")
    severity = F.when(F.col("source_kind") == "evaluation", exam_rule).otherwise(field_rule)
    return full.select("doc_id", "protected_id", "source_kind", severity.alias("severity"), "overlap", F.round(part, 6).alias("containment")).where("severity is not null")


def leak_free(spark, d):
    """Ids of the documents without a finding."""
    return docs(spark, d, "text").select("doc_id").join(leak_findings(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


#: Characters of texts that are encoded at once, as encodings take about a hundred bytes a token; a longer text is encoded
#: by itself. Sources whose sums and used tokens a task holds at once.
AT_ONCE, HELD = 500_000, 200


def _encoded(tokenizer, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Each text with its token ids, encoded in groups of at most AT_ONCE characters."""
    group, size = [], 0
    for x in [*texts, None]:
        if group and (x is None or size + len(x) > AT_ONCE):
            yield from ((y, e.ids) for y, e in zip(group, tokenizer.encode_batch_fast(group, add_special_tokens=False)))
            group, size = [], 0
        if x is not None:
            group.append(x)
            size += len(x)


def profiled(tokenizer, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, id, texts, bytes, tokens, failed) from (source, text): a row of sums with id -1 for each source, and a row of
    zeros for each token it uses. Ids of texts are folded as they come; a source held again gives rows again."""
    sums: dict[str | None, list[int]] = {}
    used: dict[str | None, np.ndarray] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for s, n in sums.items():
            ids = np.flatnonzero(used[s])
            out = pd.DataFrame(np.zeros((len(ids) + 1, 5), dtype=np.int64), columns=["id", "texts", "bytes", "tokens", "failed"])
            out["id"], out.loc[0, ["texts", "bytes", "tokens", "failed"]] = [-1, *ids], n
            out.insert(0, "source", pd.Series([s] * len(out), dtype=object))
            yield out
        sums.clear()
        used.clear()

    for b in batches:
        for s, (x, ids) in zip(b["source"], _encoded(tokenizer, list(b["text"]))):
            if s not in sums:
                if len(sums) >= HELD:
                    yield from rows()
                sums[s], used[s] = [0, 0, 0, 0], np.zeros(tokenizer.get_vocab_size(), dtype=bool)
            used[s][ids] = True
            sums[s] = [a + c for a, c in zip(sums[s], (1, len(x.encode()), len(ids), tokenizer.decode(ids, skip_special_tokens=False) != x))]
    yield from rows()


def bpe_profile(spark, d, path: str = TOKENIZERS, name: str = "byte_bpe_50k.json"):
    """Per source: texts, bytes, tokens and bytes a token under a public tokenizer, tokens used, and round-trip failures.

    Each text is encoded once. A source without any token has no bytes a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{path}/{name}")
        t.encode_special_tokens = True
        yield from profiled(t, batches)

    e = docs(spark, d, "text", "source").select(label("source").alias("source"), "text").mapInPandas(run, "source string, id long, texts long, bytes long, tokens long, failed long")
    sums = [F.sum(c).alias(a) for c, a in (("texts", "texts"), ("bytes", "bytes"), ("tokens", "tokens"), ("failed", "failures"))]
    r = e.groupBy("source").agg(*sums, F.countDistinct(F.when(F.col("id") >= 0, F.col("id"))).alias("used_tokens"))
    return r.withColumn("bytes_per_token", F.round(F.try_divide("bytes", "tokens"), 6))


def settle_owners(spark, common, links):
    """(id, of): texts whose runs an earlier kept text owns to 86 % or more, and that owner.

    common: (id, n, run), the runs that more than one text holds; links: (u, v), each text with an earlier one that holds
    86 % of its runs. The owner of a run is the least kept text that holds it, of all texts. Texts without a link are
    always kept, so of those only the least per run counts. The verdicts of the linked ones are computed again from
    the last ones until none changes; each round settles at least the least unsettled text, so it ends with the
    result of the ordered rule.
    """
    stage = Stage(spark, "settle")
    able = stage.put(links.select(F.col("u").alias("id")).distinct(), "able")
    held = common.join(able, "id").select("id", "n", "run")
    free = common.join(held.select("run").distinct(), "run", "left_semi").join(able, "id", "left_anti").groupBy("run").agg(F.min("id").alias("free"))
    held = stage.put(held.join(free, "run", "left"), "held")
    out, name, before = able, "able", None
    turn = 0
    while True:
        sign = tuple(out.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id")), F.sum(F.xxhash64(F.lit(7), "id").cast("decimal(38,0)"))).first())
        if sign == before:
            return out
        before, turn = sign, turn + 1
        gone = out.select("id", F.lit(True).alias("gone"))
        owners = held.join(gone, "id", "left").groupBy("run").agg(F.least(F.min(F.when(F.col("gone").isNull(), F.col("id"))), F.min("free")).alias("of"))
        owned = held.join(owners, "run").where("of < id").groupBy("id", "n", "of").agg(F.count(F.lit(1)).alias("k"))
        out = stage.put(owned.where(F.col("k") / F.col("n") >= OWNED).select("id", "of"), f"round{turn}")
        stage.drop(name)
        name = f"round{turn}"


def owner_dedup(spark, d):
    """(doc_id, verdict, of): in the order of ids, copies and texts of whose seven-token runs an earlier kept text owns
    86 % or more are rejected. Owners are settled over all texts."""
    stage = Stage(spark, "owner")
    rows = stage.put(docs(spark, d, "text").select("doc_id", F.sha2(T.normalize_text("text"), 256).alias("h"), T.window_hashes(T.lexical_tokens("text"), OWNER_RUN).alias("runs")), "rows")
    heads = stage.put(rows.groupBy("h").agg(F.min("doc_id").alias("id"), F.min_by("runs", "doc_id").alias("runs")).where("size(runs) > 0"), "heads")
    n = F.size("runs")
    ones = heads.select("id", n.alias("n"), F.explode("runs").alias("run"))
    often = ones.groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = stage.put(ones.join(often, "run"), "common")
    own = common.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("c"))
    spare = F.size("c") - F.ceil(F.col("n") * OWNED)
    probe = own.withColumn("spare", spare).where("spare >= 0").select("id", F.explode(F.slice("c", F.lit(1), (F.col("spare") + 1).cast("int"))).alias("x")).select("id", "x.run")
    near = probe.alias("a").join(common.select("run", F.col("id").alias("other")).alias("b"), "run").where(F.col("other") < F.col("id")).select("id", "other").distinct()
    full = near.join(heads.select("id", "runs"), "id").join(heads.select(F.col("id").alias("other"), F.col("runs").alias("theirs")), "other")
    links = stage.put(full.where(F.size(F.array_intersect("runs", "theirs")) / n >= OWNED).select(F.col("id").alias("u"), F.col("other").alias("v")), "links")
    owned = settle_owners(spark, common, links).select(F.col("id").alias("head"), "of", F.lit("reject").alias("verdict"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("head"))
    judged = first.join(owned, "head", "left").select("h", "head", F.coalesce("verdict", F.lit("keep")).alias("v"), "of")
    copy = F.col("doc_id") != F.col("head")
    return rows.select("doc_id", "h").join(judged, "h").select("doc_id", F.when(copy, "reject").otherwise(F.col("v")).alias("verdict"), F.when(copy & (F.col("v") == "keep"), F.col("head")).otherwise(F.col("of")).alias("of"))


def doc_simhash(spark, d):
    """(doc_id, simhash64) of each text, as 16 hex digits."""
    return docs(spark, d, "text").select("doc_id", simhash64("text").alias("simhash64"))


_T = T.sql_strip("text")
_K = lambda c: f"regexp_extract_all({c}, '{T.LEXICAL}')"
_CHARS = lambda c, p: f"(length({c}) - length(regexp_replace({c}, '{p}', '', 'g')))"
_SEG = R.sql_reasons(
    ("t = ''", "empty_segment"), (r"regexp_matches(t, '^\p{Ll}')", "starts_with_lowercase_fragment"), (_CHARS("t", r"\$") + " >= 3", "currency_or_budget_fragment"), (f"len(regexp_extract_all(t, '{CODE_MARK}')) / n > 0.035", "code_fragment_dominated"),
    (_CHARS("t", r"[{}\[\]|]") + " / greatest(1, length(t)) > 0.01", "markup_or_code_residue"), ("digits / n > 0.14", "number_table_or_date_heavy"),
)
_DIGITS = "len(list_filter(k, lambda x: regexp_full_match(x, '[0-9]+')))"
_SENT = "len(list_filter(string_split(regexp_replace(array_to_string(parts, chr(2)), '([.!?])[" + T.WS + "]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: regexp_matches(" + T.sql_strip("s") + ", '[.!?][''\")\\]]?$')))"
_RUNS5 = lambda c: T.sql_windows(T.sql_lexical(c), 5)
_EACH = lambda kind, texts, lists, source: " UNION ALL ".join([f"SELECT '{kind}' AS source_kind, '{kind}:' || id || ':{c}' AS protected_id, {c} AS text FROM {source} WHERE {c} IS NOT NULL" for c in texts] + [f"SELECT '{kind}', '{kind}:' || id || ':{c}', x FROM (SELECT id, unnest({c}) AS x FROM {source}) WHERE x IS NOT NULL" for c in lists])
_LEAKS = f"""WITH e AS ({_EACH('evaluation', EVAL_TEXTS, EVAL_LISTS, f"(SELECT * FROM {audit.HELDOUT} WHERE id IS NOT NULL)")} UNION ALL {_EACH('instruction', RECORD_TEXTS, RECORD_LISTS, audit._REC)}),
  i AS (SELECT source_kind, v, min(protected_id) AS protected_id, arg_min(text, protected_id) AS text FROM (SELECT *, {T.sql_normalize('text')} AS v FROM e) WHERE length(v) >= CASE source_kind WHEN 'evaluation' THEN 24 ELSE 60 END GROUP BY ALL),
  q AS (SELECT source_kind, protected_id, v, {_RUNS5('text')} AS p FROM i), x AS (SELECT protected_id, source_kind, v, len(p) AS m, unnest(p) AS g FROM q), k AS (SELECT doc_id, {T.sql_normalize('text')} AS t, {T.sql_lexical('text')} AS k FROM {DOCS}),
  r AS (SELECT doc_id, unnest({T.sql_windows('k', 5)}) AS g FROM k), h AS (SELECT doc_id, protected_id, source_kind, v, m, count(*) AS overlap FROM r JOIN x USING (g) GROUP BY ALL UNION ALL SELECT doc_id, protected_id, source_kind, v, 1, 0 FROM q JOIN k ON contains(k.t, q.v) WHERE len(p) = 0),
  j AS (SELECT doc_id, protected_id, source_kind, length(v) AS chars, overlap, overlap / m AS part, contains(t, v) AS exact FROM h JOIN k USING (doc_id)),
  f AS (SELECT doc_id, protected_id, source_kind, CASE WHEN source_kind = 'evaluation' THEN CASE WHEN exact OR overlap >= 8 AND part >= 0.8 THEN 'critical' WHEN overlap >= 8 AND part >= 0.35 THEN 'review' END WHEN exact AND chars >= 120 OR overlap >= 10 AND part >= 0.8 THEN 'review' END AS severity, overlap, round(part, 6) AS containment FROM j)"""
SQL = {
    "segment_rules": f"SELECT doc_id, array_to_string({_SEG}, ',') AS reasons FROM (SELECT doc_id, t, greatest(1, len(k)) AS n, {_DIGITS} AS digits FROM (SELECT doc_id, t, {_K('t')} AS k FROM (SELECT doc_id, {_T} AS t FROM {DOCS})))",
    "segment_score": "SELECT doc_id, (CASE WHEN len(k) BETWEEN 140 AND 420 THEN 20 ELSE 0 END) + (CASE WHEN len(parts) >= 2 THEN 15 ELSE 0 END) + (CASE WHEN " + _SENT + " >= 3 THEN 15 ELSE 0 END) + (CASE WHEN " + " OR ".join(f"contains(low, '{x}')" for x in TECHNICAL) + f" THEN 12 ELSE 0 END) + (CASE WHEN regexp_matches(title, '{LIST_TITLE}') THEN -30 ELSE 0 END) + (CASE WHEN {_DIGITS} / greatest(1, len(k)) > 0.12 THEN -15 ELSE 0 END) + "
    + " + ".join(f"(CASE WHEN contains(low, '{m}') THEN 4 ELSE 0 END)" for m in MARKERS) + f" AS score FROM (SELECT doc_id, coalesce(family_id, '') AS title, lower(text) AS low, {_K('text')} AS k, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {T.sql_strip('x')} <> '') AS parts FROM {DOCS})",
    "title_families": f"SELECT source, CASE WHEN f = '' THEN 'root' ELSE f END AS family, count(*) AS documents FROM (SELECT lower(trim(source)) AS source, regexp_replace(regexp_replace(lower({T.sql_strip('string_split(family_id, chr(47))[1]')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS f FROM {DOCS} WHERE family_id IS NOT NULL) GROUP BY ALL",
    "corpus_contains_prompt": f"WITH q AS (SELECT id AS eval_id, {T.sql_normalize('prompt')} AS v FROM phase3_5b_heldout_v1 WHERE id IS NOT NULL AND prompt IS NOT NULL), t AS (SELECT {T.sql_normalize('text')} AS t FROM {DOCS}) SELECT eval_id, count(*) AS documents FROM t JOIN q ON contains(t, v) AND v <> '' GROUP BY 1",
    "leak_findings": _LEAKS + " SELECT * FROM f WHERE severity IS NOT NULL",
    "leak_free": _LEAKS + f" SELECT doc_id FROM {DOCS} WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE severity IS NOT NULL)",
}
QUERIES = {k: globals()[k] for k in SQL} | {f.__name__: f for f in (markup_segments, page_reasons, bpe_profile, owner_dedup, doc_simhash)}
