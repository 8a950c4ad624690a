import random
import re
from datetime import datetime

from siltstone.llm import neardup as N

AT = datetime(2026, 1, 1)
SCHEMA = "id string, instruction string, answer string, received_at timestamp, fp long, n int, runs string, run int"


def table(spark, rows):
    return spark.createDataFrame([(i, a, b, AT, 1, 2, "x", 3) for i, a, b in rows], SCHEMA)


def runs(a, b):
    w = re.findall("[a-z0-9]+", ((a or "") + "\n" + (b or "")).lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    sets = {i: runs(a, b) for i, a, b in rows if i is not None}
    return {(x, y) for x in sets for y in sets if x < y and (u := sets[x] | sets[y]) and 5 * len(sets[x] & sets[y]) >= 3 * len(u)}


def fixture(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, stock = [], "please write the code for this task and explain"
    for k in range(60):
        base = r.choices(words, k=r.choice([3, 4, 5, 8, 20, 60, 200]))
        for j in range(r.randint(1, 4)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(text) // 8))):
                at = r.randrange(len(text))
                r.choice([lambda: text.pop(at) if len(text) > 3 else None, lambda: text.insert(at, r.choice(words)), lambda: text.__setitem__(at, r.choice(words))])()
            rows.append((f"d{k:03}{j}", stock if k % 3 else None, " ".join(text)))
    rows += [(f"c{i}", "a copy that is the same", "as all the others here") for i in range(30)]
    rows += [("e1", None, None), ("e2", "", ""), ("e3", "one two", ""), (None, "x y z", "x y z"), ("é1", "A b c", "D"), ("long", "k " * 5000, "v w " * 9000)]
    return rows


def test_pairs_match_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        got = [tuple(r) for r in N.similar_ids(spark, table(spark, rows)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_groups(spark):
    rows = fixture(3)
    got = {r["id"]: r for r in N.similar_groups(spark, table(spark, rows)).collect()}
    pairs = brute(rows)
    assert set(got) == {x for p in pairs for x in p}
    assert all(got[a]["group_id"] == got[b]["group_id"] for a, b in pairs)
    assert got["c0"]["copies"] == 30 and got["c0"]["links"] == 0 and got["c0"]["group_id"] == "c0"


def test_repeated_and_empty(spark):
    rows = [("a", "x y z q", "w")] * 3 + [("b", "x y z q", "w")]
    assert [tuple(r) for r in N.similar_ids(spark, table(spark, rows)).collect()] == [("a", "b")]
    assert N.similar_ids(spark, table(spark, [])).count() == 0 and N.similar_groups(spark, table(spark, [])).count() == 0
