import random

import numpy as np

from siltstone.llm import packing as P

SCHEMA = "doc_id long, text string, tokens int, key int, part int, container_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_hilbert_index_is_a_curve():
    bits = 3
    n = 1 << bits
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = P.hilbert_index(cells, bits)
    assert sorted(key.tolist()) == list(range(n**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_containers(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["apple", "pear", "plum", "fig"], k=r.choice([1, 30, 90, 400])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "w " * 950), (903, "x " * 400), (904, "y " * 401), (905, "v" * 50000), (3, rows[3][1])]
    got = [x.asDict() for x in P.packed(spark, docs(spark, rows), 400).collect()]
    size = {}
    for x in got:
        size[x["container_id"]] = size.get(x["container_id"], 0) + x["tokens"]
    assert max(size.values()) <= 400
    want = sorted((i, len((t or "").split())) for i, t in rows)
    total = {}
    for x in got:
        total.setdefault(x["doc_id"], []).append(x["tokens"])
    assert sorted({i for i, _ in want}) == sorted(total) and sum(map(sum, total.values())) == sum(n for _, n in want)
    assert sorted(total[902]) == [150, 400, 400] and total[903] == [400] and sorted(total[904]) == [1, 400]
    assert {x[0] for x in P.split_texts(spark, docs(spark, rows), 400).collect()} == {902, 904}
    assert P.container_fill(spark, docs(spark, rows), 400).first()["fill"] > 0.95


def test_empty_table(spark):
    assert P.packed(spark, docs(spark, [])).count() == 0 and P.split_texts(spark, docs(spark, [])).count() == 0
    assert P.container_fill(spark, docs(spark, [])).first()["containers"] == 0


def test_containers_hold_neighbours_and_fill(spark):
    """On the test documents: containers are nearly full, and their texts stand close together on the curve."""
    r = P.container_fill(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).first()
    assert r["fill"] >= 0.97 and r["span"] < 0.15


def test_batch_size_does_not_change_the_packing(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows.append(sorted(map(tuple, P.packed(spark, d).collect())))
    assert rows[0] == rows[1]
