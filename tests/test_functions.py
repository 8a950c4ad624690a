import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import code, markup
from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.functions.fingerprint import answer_mask, simhash64

TEXTS = [
    "", " ", "A  b\tC\n\nd", "  x\x1cy\x85z  ", "em space\xa0x", "1.5 + x_1 == 3.\n", "\r\nmixed\r\n\nlines\r", "id 123e4567-e89b-12d3-a456-426614174000 at deadbeef99 0x1F 12.50", "İstanbul ß é٣4", "same\nsame\nsame\nother",
    "a\x0bb\x0cc", "a === b !== c => d::e $1 $x", "end\n\n", " x ", "ctrl\x01\x02\x07ok", "x" * 30000,
]


def col(spark, expr, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expr.alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_normal_forms(spark):
    norm = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    assert col(spark, T.normalize_text("t")) == [norm(t) for t in TEXTS]
    assert col(spark, T.normalize_words("t")) == [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in TEXTS]
    rows = lambda t: "\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if x)
    assert col(spark, T.normalize_rows("t")) == [rows(t) for t in TEXTS]
    assert col(spark, T.lines("t")) == [t.splitlines() for t in TEXTS]
    assert col(spark, T.normalize_template("t"))[7] == "id <uuid> at <hex> <n> <n>"


def test_tokens(spark):
    lexical = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]")
    audit = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|==={0,1}|!==|==|!=|<=|>=|=>|::|\$\d+|[^\s]")
    assert col(spark, T.lexical_tokens("t", lower=False)) == [lexical.findall(t) for t in TEXTS]
    assert col(spark, T.audit_tokens("t")) == [audit.findall(t) for t in TEXTS]
    assert col(spark, T.lexical_size("t")) == [len(lexical.findall(t)) for t in TEXTS]
    grams = lambda t: len({tuple(x[i : i + 3]) for x in [[w.lower() for w in audit.findall(t)]] for i in range(len(x) - 2)})
    assert col(spark, F.size(T.trigrams("t"))) == [grams(t) for t in TEXTS]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", *T.content_statistics("t"), T.newline_style("t").alias("ends"), T.control_ratio("t").alias("control"))
    for r in df.collect():
        t = TEXTS[r["i"]]
        kept = [re.sub(r"\s+", " ", x.strip().lower()) for x in t.splitlines() if x.strip()]
        assert (r["char_count"], r["line_count"], r["nonempty_line_count"]) == (len(t), len(t.splitlines()), len(kept))
        assert r["longest_line"] == max(map(len, t.splitlines()), default=0)
        assert r["top_line_ratio"] == pytest.approx(max(map(kept.count, kept)) / len(kept) if kept else 0)
        assert r["letter_ratio"] == pytest.approx(sum(c.isalpha() for c in t) / len(t) if t else 0)
        assert r["control"] == pytest.approx(sum(ord(c) < 32 and c not in "\n\r\t\f" for c in t) / len(t) if t else 0)
        hidden = sum(unicodedata.category(c)[0] in "CZ" and c not in " \n\r\t" for c in t)
        assert r["printable_ratio"] == pytest.approx((len(t) - hidden) / len(t) if t else 0)
    assert [r["ends"] for r in df.orderBy("i").collect()][6] == "mixed"
    assert col(spark, T.longest_run(F.split("t", "\n")))[9] == 3


SECRET_TEXTS = ["ghp_" + "a1" * 16, "x sk-" + "Ab" * 17, "AKIA" + "A1" * 8, "-----BEGIN RSA PRIVATE KEY-----", 'password = "0123456789abcdef"', "Ignore previous instructions", "# Do not edit.", "plain"]


def test_rules(spark):
    hits = lambda named: [[n for n, p in named if re.search(p, t)] for t in SECRET_TEXTS]
    for named in (R.SECRETS, R.LINT_SECRETS):
        assert col(spark, F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p in named])), SECRET_TEXTS) == hits(named)
    assert col(spark, R.any_match(F.col("t"), R.INJECTION), SECRET_TEXTS)[5] and col(spark, R.any_match(R.header("t"), R.GENERATED), SECRET_TEXTS)[6]
    low = ["home\nabout\n" + "word " * 50, "a b c d e f g h i j k l m " + "word " * 50, "same " * 200, "good text here. " * 30, "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(low)], "i int, t string").withColumn("k", T.lexical_tokens("t"))
    reject, _ = R.row_quality("t", "k", 40, 1000)
    got = [r["x"] for r in df.select("i", reject.alias("x")).orderBy("i").collect()]
    assert [("menu_or_navigation_noise" in g, "ocr_or_template_noise" in g, "low_vocabulary_diversity" in g, "too_short_or_low_information" in g) for g in got] == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (False, False, True, False), (False, False, False, True)] or got[3] == []


def test_paths(spark):
    paths = ["src/a.py", "Lib/x.D.TS", "docs/README", "a/node_modules/b.js", "x/CHANGELOG.md", "lib/.hidden", "../up.txt", "./ok/a.txt", "/abs", "a//b", ""]
    assert col(spark, R.suffix("t"), paths) == [".py", ".d.ts", "readme", ".js", ".md", "", ".txt", ".txt", "", "", ""]
    assert col(spark, R.language_hint("t"), paths)[:3] == ["python", "typescript", "other_text"]
    assert col(spark, R.path_reason("t"), paths)[3:5] == ["path marker rejected: node_modules", "low-value filename rejected: changelog.md"]
    assert col(spark, R.safe_path("t"), paths)[6:] == [None, "ok/a.txt", None, None, None]
    globs = {"src/": [True, False], "*.py": [True, False], "Lib/*": [False, True], "[sL]*": [True, True], "src": [False, False]}
    for g, want in globs.items():
        assert col(spark, R.matches_any(F.col("t"), [g]), paths[:2]) == want
    df = spark.createDataFrame([("src/a.py", 5), ("src/b.bin", 5), ("src/c.py", 10**9), ("old/a.py", 5), ("src/x/skip.py", 5)], "p string, n long")
    got = [r[0] for r in df.select(R.classify_member("p", "n", ["*skip*"], ["src/"], [".py"])).collect()]
    assert got == ["selected", "unsupported_type", "oversize_file", "outside_allowlist", "excluded_path"]


def test_markup():
    text = "Intro {{a|{{b}}|c}} text.{| table\n| x\n|} More [[Page_one|label]] and [[Other_page#part]] <ref name=x/> <b>bold</b> &amp; '''it'''.\n\n== Head ==\n* item\n[http://x.y shown] [[File:a.png]] {{open"
    plain, against = markup.clean(text)
    assert plain.replace("  ", " ") and "table" not in plain and "label" in plain and "Other page" in plain and "shown" in plain and "Head" in plain and "open" not in plain and against == []
    assert markup.clean("#REDIRECT [[x]]") == ("", ["redirect_page"]) and markup.clean(None)[1] == ["empty_page_text"]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omicron"
    assert markup.paragraphs(f"{words}\n\nshort\n\n{words}") == [words, words]
    assert markup.segments([words] * 5, 20, 31, 2) == [f"{words}\n\n{words}"] * 2 and markup.segments([words * 9], 1, 31, 2) == []


def test_structure():
    a, b = "def f(x):\n    return x + 1", "def g(yy):\n    # note\n    return yy + 22"
    assert code.signature(a, "python") == code.signature(b, "python") != code.signature("def g(y):\n    return y - 2", "python")
    assert code.signature("select a from b where c = 'x' -- n", "sql") == code.signature("SELECT q FROM z WHERE w = 'longer'", "sql")
    assert code.signature("def broken(:", "python") and code.signature("  ", "python") == ""


def test_simhash_and_mask(spark):
    import hashlib

    def plain(text):
        tokens = [t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]", text)]
        if not tokens:
            return "0" * 16
        hashes = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in tokens]
        return f"{sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) >= 0):016x}"

    texts = ["", "a", "a a b", "The quick (brown) fox 1.5 times", "x y z " * 40]
    assert col(spark, simhash64("t"), texts) == [plain(t) for t in texts]
    df = spark.createDataFrame([([5, 1, 7, 8, 2, 9],), ([5, 1, 7],), ([2, 1, 2, 9],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(answer_mask(F.col("ids"), 1, 2)).collect()] == [[0, 0, 1, 1, 1, 1], None, [0, 0, 1, 1], None]
