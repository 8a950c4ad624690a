import random
import time
from collections import Counter
from datetime import datetime

import pytest

from siltstone.llm import mixing as M
from siltstone.llm import sampling as S

AT = datetime(2026, 1, 1)
ACCEPTED = "id string, received_at timestamp, language string, category string, difficulty string, rank int, quota int, _h long, supply long"
TARGETS = "language string, category string, difficulty string, target_share double, min_records int, supply int"


def test_allocation_goes_to_siblings_then_cousins():
    cells = [(("p", "x", "1"), 0.4, 1, 10), (("p", "x", "2"), 0.2, 1, 100), (("p", "y", "1"), 0.2, 1, 100), (("q", "z", "1"), 0.2, 1, 100)]
    got = S.allocate(cells, 100)
    assert got == {("p", "x", "1"): 10, ("p", "x", "2"): 50, ("p", "y", "1"): 20, ("q", "z", "1"): 20}
    cells[1] = (("p", "x", "2"), 0.2, 1, 25)
    got = S.allocate(cells, 100)
    assert got == {("p", "x", "1"): 10, ("p", "x", "2"): 25, ("p", "y", "1"): 45, ("q", "z", "1"): 20}
    assert S.allocate([], 10) == {(): 10} or S.allocate([], 10) == {}


@pytest.mark.parametrize("seed", range(5))
def test_allocation_is_whole(seed):
    r = random.Random(seed)
    cells = [((a, b, c), r.random() / 12, r.randint(0, 3), r.choice([0, 2, 40, 900])) for a in "ab" for b in "cd" for c in "efg"]
    got = S.allocate(cells, 300)
    assert sum(got.values()) == min(300, sum(c[3] for c in cells))
    assert all(min(c[2], c[3]) <= got[c[0]] <= c[3] for c in cells)


def test_sample(spark):
    rows = [(f"i{k}", AT, " Python" if k % 2 else "python", "Data", "basic" if k % 5 else "hard", 1, 2, 3, 4) for k in range(200)] + [("i1", AT, "python", "data", "basic", 0, 0, 0, 0), (None, AT, "python", "data", "basic", 0, 0, 0, 0), ("n", None, None, None, None, 0, 0, 0, 0)]
    acc = spark.createDataFrame(rows, ACCEPTED)
    targets = spark.createDataFrame([("python", "data ", "basic", 0.5, 2, 9), ("Python", "data", "hard", 0.4, 2, 9), ("sql", "data", "basic", 0.1, 3, 9), (None, None, None, None, None, 9)], TARGETS)
    report = {(r["language"], r["difficulty"]): r for r in S.cell_report(spark, acc, targets).collect()}
    assert report["sql", "basic"]["unmet"] == 4.0 and report["sql", "basic"]["supply"] == 0
    sample = S.sample_by_targets(spark, acc, targets).collect()
    assert len(sample) == 40 and len({r["id"] for r in sample}) == 40
    count = Counter(r["difficulty"] for r in sample)
    assert count["basic"] >= 20 and count["hard"] >= 16
    assert sorted(map(tuple, sample)) == sorted(map(tuple, S.sample_by_targets(spark, acc, targets).collect()))


def test_sample_of_empty_tables(spark):
    acc, targets = spark.createDataFrame([], ACCEPTED), spark.createDataFrame([], TARGETS)
    assert S.cell_report(spark, acc, targets).count() == 0 and S.sample_by_targets(spark, acc, targets).count() == 0


def naive_seats(weights, blocks, caps):
    seats = dict.fromkeys(weights, 0)
    for _ in range(blocks):
        able = [s for s in weights if weights[s] > 0 and seats[s] < caps[s]]
        if not able:
            break
        seats[min(able, key=lambda s: (-weights[s] / (2 * seats[s] + 1), s))] += 1
    return seats


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague(seed):
    r = random.Random(seed)
    weights = {f"s{i}": float(r.choice([0, 1, 5, 30, 300])) for i in range(6)}
    caps = {s: r.choice([0, 2, 50, 10**9]) for s in weights}
    assert M.sainte_lague(weights, 240, caps) == naive_seats(weights, 240, caps)


def test_sainte_lague_of_many_blocks_is_quick():
    """A thousand million blocks, a capped source of most of the weight: exact, and in far less than a second."""
    weights, caps = {"a": 9e9, "b": 7.0e8, "c": 3e8, "d": 1.0}, {"a": 1000, "b": 10**12, "c": 10**12, "d": 10**12}
    began = time.time()
    got = M.sainte_lague(weights, 10**9, caps)
    assert time.time() - began < 1
    assert sum(got.values()) == 10**9 and got["a"] == 1000
    last = min(weights[s] / (2 * got[s] - 1) for s in got if got[s] and s != "a")
    assert all(weights[s] / (2 * got[s] + 1) <= last for s in got if got[s] < caps[s])


SLICE = "record_id string, source_id string, actual_token_count int, supply long, blocks long, pass int, block int, _before long"
MANIFEST = "source_id string, target_tokens long, max_repeats int, recorded_at timestamp, supply long"


def test_mixture(spark):
    rows = [(f"a{i}", "A ", 100, 0, 0, 0, 0, 0) for i in range(300)] + [(f"b{i}", "b", 50, 0, 0, 0, 0, 0) for i in range(40)] + [("a1", "a", 100, 0, 0, 0, 0, 0), ("n", None, 9, 0, 0, 0, 0, 0), ("z", "b", None, 0, 0, 0, 0, 0)]
    man = [("a", 10, 1, AT, 5), ("b", 90, 1, AT, 5), ("B", 10, 3, datetime(2026, 2, 1), 5), ("c", 5, 2, AT, 5), ("d", None, 2, AT, 5)]
    s, m = spark.createDataFrame(rows, SLICE), spark.createDataFrame(man, MANIFEST)
    plan = {r["source_id"]: r for r in M.mix_plan(spark, s, m, 500).collect()}
    assert set(plan) == {"a", "b", "c"} and plan["b"]["supply"] == 2000 and plan["b"]["cap"] == 6000.0 and plan["c"]["blocks"] == 0
    assert plan["b"]["blocks"] == 12 and plan["a"]["blocks"] == 52
    got = M.mix_sources(spark, s, m, 500, shards=4).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source_id"]] += r["tokens"]
    assert abs(tokens["a"] - 26000) <= 500 and tokens["b"] == 6000
    copies = Counter((r["source_id"], r["record_id"]) for r in got)
    assert max(n for (x, _), n in copies.items() if x == "b") == 3 and max(n for (x, _), n in copies.items() if x == "a") == 1
    shards = Counter((r["source_id"], r["shard"]) for r in got if r["source_id"] == "b")
    assert set(k for _, k in shards) == {0, 1, 2, 3}
    shares = {r["source_id"]: r["actual_share"] for r in M.mix_report(spark, s, m, 500).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9


def test_mixture_of_empty_tables(spark):
    s, m = spark.createDataFrame([], SLICE), spark.createDataFrame([], MANIFEST)
    assert M.mix_plan(spark, s, m).count() == 0 and M.mix_sources(spark, s, m).count() == 0
    full = spark.createDataFrame([("a", 10, None, None, 1)], MANIFEST)
    assert M.mix_plan(spark, s, full).first()["blocks"] == 0
