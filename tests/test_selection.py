import random

from siltstone.operators.containment import contained
from siltstone.plans import corpus, markup
from siltstone.plans import selection as S

ROWS = "id string, source string, `group` string, family string, tokens int, score int, rank int, phase int, turn int"


def fixture(seed):
    r = random.Random(seed)
    return [(f"r{k:03}", r.choice("abcz"), r.choice(["g", "h", "none"]), r.choice([None, *"uvwxyz"]), r.choice([None, 5, 20, 60, 200]), r.choice([None, 1, 5, 9]), r.choice([None, 1, 2, 3])) for k in range(120)]


def replay(rows, targets, groups, total, most_total):
    key = lambda x: (-(x[5] or 0), x[4] or 0, x[6] or 0, x[0])
    taken, fams, src, grp = {}, {}, {}, {}

    def able(x):
        n, g = x[4] or 0, x[2]
        return x[0] not in taken and not fams.get((g, x[3] or x[0]), 0) >= groups[g][1] and grp.get(g, 0) + n <= groups[g][0] and sum(grp.values()) + n <= most_total

    def add(x, phase):
        n, g = x[4] or 0, x[2]
        taken[x[0]] = phase
        fams[g, x[3] or x[0]] = fams.get((g, x[3] or x[0]), 0) + 1
        src[x[1]], grp[g] = src.get(x[1], 0) + n, grp.get(g, 0) + n

    rows = [x for x in rows if x[2] in groups]
    for s, goal in targets:
        for x in sorted((x for x in rows if x[1] == s), key=key):
            if src.get(s, 0) >= goal:
                break
            if able(x):
                add(x, 1)
    for x in sorted((x for x in rows if x[0] not in taken), key=key):
        if sum(grp.values()) >= total:
            break
        if able(x):
            add(x, 2)
    return taken


def test_two_phases_match_the_plain_rule(spark):
    for seed, total in ((1, 700), (2, 90), (3, 5000)):
        rows = fixture(seed)
        args = ([("b", 200), ("a", 90), ("c", 0), ("missing", 50)], {"g": (500, 1), "h": (900, 2)}, total, total + 40)
        got = S.two_phase_select(spark.createDataFrame([(*x, 7, 7) for x in rows], ROWS), *args)
        assert {x["id"]: x["phase"] for x in got.collect()} == replay(rows, *args)
    assert S.two_phase_select(spark.createDataFrame([], ROWS), *args).count() == 0


def test_budget_and_family_limit(spark):
    rows = fixture(4)
    got = {x["id"]: x["status"] for x in S.budget_select(spark.createDataFrame([(*x, 7, 7) for x in rows], ROWS), 400, 2).collect()}
    want, used, fams = {}, {}, {}
    for i, s, _, f, n, score, _ in sorted(rows, key=lambda x: (-(x[5] or 0), x[0])):
        n, f = n or 0, f or i
        if used.get(s, 0) + n > 400:
            want[i] = "rejected"
            continue
        want[i] = "review" if fams.get((s, f), 0) >= 2 else "candidate"
        used[s], fams[s, f] = used.get(s, 0) + n, fams.get((s, f), 0) + 1
    assert got == want and set(want.values()) == {"rejected", "review", "candidate"}
    assert S.budget_select(spark.createDataFrame([], ROWS), 400, 2).count() == 0


def test_source_families(spark):
    cases = {
        ("cpython_3_14_6", "Lib/test/test_Json.py"): ("cpython_3_14_6:module:json", "cpython_test_module"), ("cpython_3_14_6", "Lib/json/decoder.py"): ("cpython_3_14_6:module:json", "cpython_library_module"),
        ("node_24_18_0", "test/parallel/test-fs-open.js"): ("node_24_18_0:api:fs", "node_parallel_test"), ("postgresql_18_4", "src/test/regress/expected/join.out"): ("postgresql_18_4:regress:join", "postgres_expected_pair"),
        ("powershell_docs_2026", "reference/docs-conceptual/Learn it/x.md"): ("powershell_docs_2026:concept:learn-it", "powershell_concept_section"), ("pytest_9_1_1", "src/_pytest/config/argparsing.py"): ("pytest_9_1_1:feature:config", "pytest_source_feature"),
        ("pytest_9_1_1", "src/_pytest/nodes.py"): ("pytest_9_1_1:feature:nodes", "pytest_source_feature"), ("typescript_website_2026", "packages/docs/a/Intro.d.ts"): ("typescript_website_2026:package:docs:intro", "typescript_website_document"),
        ("other", "lib/A b/tests/test_it.py"): ("other:path:a-b:it", "path_stem_fallback"), ("other", "x"): ("other:path:root:x", "path_stem_fallback"), ("other", ".env"): ("other:path:root:env", "path_stem_fallback"),
    }
    df = spark.createDataFrame([*cases, (None, "a"), ("a", None)], "s string, p string")
    got = {(r["s"], r["p"]): (r["f"], r["r"]) for r in df.select("s", "p", S.source_family("s", "p")[0].alias("f"), S.source_family("s", "p")[1].alias("r")).collect()}
    assert {k: got[k] for k in cases} == cases and got[None, "a"] == got["a", None] == (None, None)


def test_sql_families_agree(spark):
    import duckdb

    paths = ["Lib/test/test_a.py", "doc/api/fs.md", "a/b/c/test-d.tar.gz", "tests/x.d.ts", "src/_pytest/a/b.py", "packages/p/q.md", ".hidden", "docs/Read Me.md"]
    sources = sorted({r[0] for r in S.FAMILY_RULES} | {"x"})
    df = spark.createDataFrame([(s, p) for s in sources for p in paths], "s string, p string")
    mine = {(r["s"], r["p"]): r["f"] for r in df.select("s", "p", S.source_family("s", "p")[0].alias("f")).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE t (s VARCHAR, p VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(mine))
    assert {(s, p): f for s, p, f in c.execute(f"SELECT s, p, {S.sql_family('s', 'p')} FROM t").fetchall()} == mine


def test_contained_in_passes(spark):
    texts = spark.createDataFrame([("a", "the red lamp"), ("b", "a lamp, the red lamp"), ("c", None), ("d", "")], "key string, t string")
    needles = spark.createDataFrame([("n1", "red lamp"), ("n2", "lamp"), ("n3", "red lamp"), ("n4", ""), ("n5", None), ("n6", "blue")], "name string, s string")
    want = {(k, n) for k in "ab" for n in ("n1", "n2", "n3")}
    for at_once in (1, 100):
        got = [tuple(r) for r in contained(spark, texts, needles, at_once).select("key", "name").collect()]
        assert set(got) == want and len(got) == len(want)
    assert contained(spark, texts, needles.limit(0)).count() == 0


def test_leak_ladders(spark, tmp_path):
    """Prompts under five tokens, test code, long and short fields of records, near-complete and partial overlap."""
    words = [f"word{k}" for k in range(60)]
    prompt, code, answer = " ".join(words[:25]), "assert lamp_of(harbour) == keeper_of(harbour, winter)", " ".join(f"term{k}" for k in range(40))
    held = [("e1", prompt, code), ("e2", "SupercalifragilisticHarbour lamps", None), ("e3", "tiny", None)]
    empty = "cast(null as array<string>)"
    base = spark.createDataFrame(held, "id string, prompt string, test_code string").selectExpr("id", "'en' as language", "'c' as category", "'d' as difficulty", "prompt", f"{empty} as required_terms", f"{empty} as forbidden_terms", "test_code", "cast(null as string) as expected_behavior_notes", "'s' as suite", "'h' as split")
    base.write.parquet(f"{tmp_path}/phase3_5b_heldout_v1.parquet")
    rec = spark.createDataFrame([("r1", "short ask", answer)], "id string, instruction string, answer string").selectExpr("id", "'en' as language", "'c' as category", "'d' as difficulty", "instruction", f"{empty} as constraints", "answer", "cast(null as string) as bad_code", "cast(null as string) as reasoning", f"{empty} as edge_cases", f"{empty} as quality_notes", "current_timestamp() as received_at")
    rec.write.parquet(f"{tmp_path}/phase3_5b_batch07_accepted.parquet")
    texts = [
        (1, f"before {prompt} after"), (2, " ".join(words[:22])), (3, " ".join(words[:14])), (4, " ".join(words[:9])), (5, f"x {code} y"), (6, "see SupercalifragilisticHarbour   lamps here"),
        (7, f"as it says: {answer}."), (8, " ".join(answer.split()[:36])), (9, " ".join(answer.split()[:20])), (10, "tiny"), (11, None), (12, ""),
    ]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["protected_id"]): r["severity"] for r in markup.leak_findings(spark, str(tmp_path)).collect()}
    p, a = "evaluation:e1:prompt", "instruction:r1:answer"
    assert got == {(1, p): "critical", (2, p): "critical", (3, p): "review", (5, "evaluation:e1:test_code"): "critical", (6, "evaluation:e2:prompt"): "critical", (7, a): "review", (8, a): "review"}
    assert {r[0] for r in markup.leak_free(spark, str(tmp_path)).collect()} == {4, 9, 10, 12}


def test_reasons_fold_beyond_forty(spark):
    rows = [(f"reason{k:02}", 100 - k) for k in range(45)]
    got = {r["reason"]: r["records"] for r in corpus.compact_counts(spark.createDataFrame(rows, "reason string, records long")).collect()}
    assert len(got) == 41 and got["other_reasons_compacted"] == sum(n for _, n in rows[40:]) and all(got[k] == n for k, n in rows[:40])
    assert "other_reasons_compacted" not in {r["reason"] for r in corpus.compact_counts(spark.createDataFrame(rows[:40], "reason string, records long")).collect()}
