import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import dedup as D

ROW = "src string, id string, family string, score int, tokens int, exact string, template string, sim long"


def plain_rule(rows, quotas, cap):
    """Family, quota, then every record taken so far, record after record, in plain Python."""
    taken, used, families = [], {}, {}
    for src, i, family, _, n, e, t, s in sorted(rows, key=lambda r: (r[0], -r[3], r[4], r[1])):
        family = family or i
        if families.get((src, family), 0) >= cap > 0 or used.get(src, 0) + n > quotas.get(src, -1):
            continue

        def copy(p):
            x = None if s is None or p[7] is None else (s ^ p[7]) & (2**64 - 1)
            near = x is not None and n >= 40 and max(n, p[4]) / max(1, min(n, p[4])) <= 1.35 and x.bit_count() <= 6 and any((x >> 16 * b) & 0xFFFF == 0 for b in range(4))
            return (e is not None and e == p[5]) or (t is not None and t == p[6] and n >= 30) or near

        if any(copy(p) for p in taken):
            continue
        taken.append((src, i, family, _, n, e, t, s))
        used[src] = used.get(src, 0) + n
        families[src, family] = families.get((src, family), 0) + 1
    return {r[1] for r in taken}


def unique(spark, rows, quotas, cap=1):
    got = D.greedy_unique(spark, spark.createDataFrame(rows, ROW), "src", [-F.col("score"), F.col("tokens"), F.col("id")], quotas, cap).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0] for r in got}


def test_copies_of_other_groups_and_families_leave_their_quota_to_the_next(spark):
    rows = [("a", "1", "f1", 9, 50, "e1", "t1", 0), ("a", "2", "f2", 8, 50, "e1", "t2", -1), ("a", "3", "f3", 7, 20, "e3", "t1", None), ("b", "4", "f4", 9, 60, "e4", "t1", None), ("b", "5", "f5", 8, 60, "e5", "t5", 7), ("b", "6", "f6", 7, 60, "e6", "t6", 0x0FFFFFFFFFFFFFFF), ("b", "7", None, 6, 60, None, None, None), ("c", "8", "f", 1, 1, "e8", "t8", 1)]
    quotas = {"a": 100, "b": 120}
    assert unique(spark, rows, quotas) == plain_rule(rows, quotas, 1) == {"1", "3", "6", "7"}


def test_a_longer_record_is_near_a_taken_one_under_forty_tokens(spark):
    assert unique(spark, [("a", "1", "f", 2, 33, "e1", "t1", 5), ("a", "2", "g", 1, 40, "e2", "t2", 4), ("a", "3", "h", 1, 39, "e3", "t3", 4)], {"a": 1000}) == {"1", "3"}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_unique_matches_the_plain_rule(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(60):
        sim, n = r.getrandbits(64), r.choice([10, 29, 30, 33, 45, 70, 90])
        for j in range(r.randint(1, 5)):
            s = sim
            for b in r.sample(range(64), r.choice([0, 1, 3, 5, 7])):
                s ^= 1 << b
            s = None if r.random() < 0.05 else s - 2**64 if s >= 2**63 else s
            rows.append((r.choice("abcd"), f"{k}-{j}", r.choice([None, f"f{k % 9}", f"f{k}-{j}"]), r.randint(0, 3), n + r.choice([0, 3, 12]), f"e{k}-{r.choice([0, j])}", r.choice([None, f"t{k}-{r.choice([0, j])}"]), s))
    quotas = {"a": 600, "b": 10**12, "c": 300}
    for cap in (0, 1):
        assert unique(spark, rows, quotas, cap) == plain_rule(rows, quotas, cap)
