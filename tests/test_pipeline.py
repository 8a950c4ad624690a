import io
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dedup as D
from siltstone.sources import readers, sinks
from siltstone.streaming.status import SCHEMA, run_status_stream

PRINT = "id string, exact string, template string, sim long, tokens int"


def plain_rule(rows):
    """The ordered rule, row after row, in plain Python."""
    exact, templates, kept, out = {}, {}, [], {}
    for i, e, t, s, n in sorted(rows):
        prior = exact.get(e) or templates.get(t)
        verdict, of = "keep", None
        if prior:
            of = prior[0]
            verdict = "reject" if prior[1] == e or n >= 30 else "review"
        else:
            for p in sorted(kept):
                x = (s ^ p[3]) & (2**64 - 1)
                if all((x >> 16 * b) & 0xFFFF for b in range(4)):
                    continue
                ratio = max(n, p[4]) / max(1, min(n, p[4]))
                v = "reject" if n >= 60 and ratio <= 1.2 and x.bit_count() <= 3 else "review" if n >= 40 and ratio <= 1.35 and x.bit_count() <= 6 else "keep"
                if v != "keep":
                    verdict, of = v, p[0]
                    break
        out[i] = (verdict, of)
        if verdict != "reject":
            exact.setdefault(e, (i, e))
            templates.setdefault(t, (i, e))
            kept.append((i, e, t, s, n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first_matches_the_plain_rule(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(25):
        sim, n = r.getrandbits(64), r.choice([10, 29, 30, 45, 70, 90])
        for j in range(r.randint(1, 4)):
            s = sim
            for b in r.sample(range(64), r.choice([0, 1, 3, 5, 7])):
                s ^= 1 << b
            s = s - 2**64 if s >= 2**63 else s
            rows.append((f"{r.randint(0, 999):03}-{k}-{j}", f"e{k}-{j}", f"t{k}-{r.choice([0, 0, j])}", s, n + r.choice([0, 3])))
    got = {x["id"]: (x["verdict"], x["of"]) for x in D.keep_first(spark, spark.createDataFrame(rows, PRINT)).collect()}
    assert got == plain_rule(rows)


def test_keep_first_folds_copies_and_nulls(spark):
    rows = [("a", "e", "t", 1, 90), ("b", "e", "t", 1, 90), ("c", None, None, None, 90), ("d", None, None, None, None or 0), ("f", "e", "t", 1, 90)]
    got = {x["id"]: (x["verdict"], x["of"]) for x in D.keep_first(spark, spark.createDataFrame(rows, PRINT)).collect()}
    assert got == {"a": ("keep", None), "b": ("reject", "a"), "f": ("reject", "a"), "c": ("keep", None), "d": ("keep", None)}
    assert D.keep_first(spark, spark.createDataFrame([], PRINT)).count() == 0


def test_greedy_select_skips_and_goes_on(spark):
    rows = [("s", "a", "f1", 60), ("s", "b", "f2", 50), ("s", "c", "f3", 40), ("s", "d", "f1", 1), ("s", "e", None, None), ("q", "z", "f", 5), ("s", "h", "f9", 1000)]
    df = spark.createDataFrame(rows, "src string, id string, family string, tokens int")
    got = D.greedy_select(df, "src", [F.col("id")], {"s": 100}, 1)
    assert {r[0] for r in got.collect()} == {"a", "c", "e"}


def test_decoding(spark):
    cases = [(b"", ("", "utf-8", False, "none")), ("é\n".encode(), ("é\n", "utf-8", False, "lf")), (b"\xef\xbb\xbfx\r\n", ("x\r\n", "utf-8-sig", True, "crlf")), ("a\r".encode("utf-16"), ("a\r", "utf-16", True, None)), (b"caf\xe9", ("caf\xe9", "cp1252", False, "none")),
             (b"a\x00b", None), (b"\x81\x8d", None), (b"x\x01", None), (None, ("", "utf-8", False, "none"))]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, (p, _) in enumerate(cases)], "i int, p binary").select("i", readers.decoded("p").alias("d"))
    for r in df.collect():
        want = cases[r["i"]][1]
        assert (r["d"]["text"] is None) == (want is None) and (r["d"]["error"] is None) == (want is not None)
        if want:
            assert (r["d"]["text"], r["d"]["encoding"], r["d"]["had_bom"]) == want[:3]


def test_readers(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("lead\n<instruction>one</instruction><answer>x</answer>\n<instruction>two</instruction>")
    (tmp_path / "t/sub/b.md").write_text("only text")
    (tmp_path / "t/c.bin").write_text("no")
    rows = readers.tagged_records(spark, str(tmp_path / "t")).collect()
    assert sorted((r["index"], r["is_instruction"]) for r in rows) == [(0, False), (0, False), (1, True), (2, True)]
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int").count() == 2
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as t:
        for name, data in (("root/a.py", b"print(1)"), ("root/sub/b.txt", b"x" * 50), ("../evil", b"e")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("root/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc"
        t.addfile(link)
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("one/a.txt", "A")
        z.writestr("two/b.txt", "B")
    members = readers.archive_members(spark, str(tmp_path / "*.{tar.gz,zip}"))
    counts = {r["path"].split("/")[-1]: (r["members"], r["regular"], r["special"], r["unsafe"]) for r in readers.archive_counts(members).collect()}
    assert counts == {"p.tar.gz": (4, 3, 1, 1), "q.zip": (2, 2, 0, 0)}
    assert {r["path"].split("/")[-1]: r["root"] for r in readers.common_root(members).collect()} == {"p.tar.gz": "root", "q.zip": None}
    files = {r["member"]: bytes(r["content"]) for r in readers.archive_files(spark, str(tmp_path / "p.tar.gz"), 20).collect()}
    assert files == {"root/a.py": b"print(1)"}
    (tmp_path / "d.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>T</title><ns>0</ns><id>7</id><revision><id>9</id><timestamp>2026-01-01</timestamp><text bytes="3">abc</text></revision></page></mediawiki>')
    assert tuple(readers.wiki_pages(spark, str(tmp_path / "d.xml")).first()) == ("T", "0", "7", "9", "2026-01-01", "abc")
    (tmp_path / "sums").write_text("da39a3ee5e6b4b0d3255bfef95601890afd80709  file.bz2\nnoise\n")
    assert readers.sha1_sums(spark, str(tmp_path / "sums")).first()["file"] == "file.bz2"
    leaves = spark.createDataFrame([('{"a": ["x", {"b": " y "}], "c": 1}',), ("[broken",), (None,)], "j string").select(readers.string_leaves("j")).collect()
    assert [r[0] for r in leaves] == [["x", "y"], [], []]
    (tmp_path / "code/node_modules").mkdir(parents=True)
    for name, data in (("code/a.py", b"x"), ("code/b.txt", b"x"), ("code/node_modules/c.py", b"x"), ("code/d.py", b"\0x"), ("code/e_gen.py", b"x")):
        (tmp_path / name).write_bytes(data)
    state = {r["path"].split("/")[-1]: r["state"] for r in readers.code_files(spark, str(tmp_path / "code"), (".py",), ignore=("*_gen.py",)).collect()}
    assert state == {"a.py": "kept", "b.txt": "bad_extension", "c.py": "skipped", "d.py": "binary", "e_gen.py": "ignored"}
    e, i = spark.createDataFrame([("e1", "x" * 30), ("e2", "X" * 30), ("e3", "short")], "protected_id string, text string"), spark.createDataFrame([("i1", "y" * 59), ("i2", "y" * 60)], "protected_id string, text string")
    assert sorted(r["protected_id"] for r in readers.protected_items(e, i).collect()) == ["e1", "i2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, [1, 2], "kept"), ("a", 1, [3], "gone")], "id string, n int, ids array<int>, status string")
    sinks.write_json_lines(df, str(tmp_path / "j"), ["id"])
    assert [r["id"] for r in readers.json_lines(spark, str(tmp_path / "j"), "id string, n int").orderBy("id").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.append(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "id", "missing"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["n", "id", "missing"]
    sinks.write_by_status(df, str(tmp_path / "s"), ("status",))
    assert spark.read.parquet(str(tmp_path / "s")).where("status = 'kept'").count() == 1
    sinks.write_tagged(df.withColumn("rendered", F.col("id")).coalesce(1), str(tmp_path / "t"))
    assert "\n\n" in next((tmp_path / "t").glob("*.txt")).read_text()
    assert sinks.markdown_table(df.select("id", "n").orderBy("id")) == "| id | n |\n| --- | --- |\n| a | 1 |\n| b | 2 |\n"
    with pytest.raises(ValueError):
        sinks.markdown_table(df, 1)
    assert sinks.write_tokens(df, str(tmp_path / "w"), ["id"]) == 3
    assert np.fromfile(tmp_path / "w.bin", "<u2").tolist() == [3, 1, 2] and sinks.canonical_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'.encode()


def test_stream_drops_copies_across_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp")).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    long = "A good text that says something of the world in many words. " * 8
    make([(1, long, "A"), (2, long.upper(), "a"), (3, "short", "a")]).coalesce(1).write.parquet(source)
    run_status_stream(spark, source, out, state)
    make([(4, long + " ", "b"), (5, long + "more", "b"), (6, None, "b")]).coalesce(1).write.mode("append").parquet(source)
    run_status_stream(spark, source, out, state)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 3 and {r["status"] for r in rows if r["doc_id"] in (3,)} == {"rejected_not_admitted"} and {5} <= {r["doc_id"] for r in rows}
