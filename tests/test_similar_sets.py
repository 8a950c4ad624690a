import glob
import os
import random
from fractions import Fraction

import pytest

from siltstone.operators import similarity as S
from siltstone.plans import audit as A
from siltstone.plans.staging import Stage, shared_dir
from tests.compare import SF


def size(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(17, 25), Fraction(14, 25)])
def test_all_pairs_in_passes(spark, monkeypatch, t):
    """As by comparing every two sets, whatever the number of passes."""
    rng = random.Random(5)
    sets = [{rng.randrange(60) if rng.random() < 0.9 else 0 for _ in range(rng.randint(1, 12))} for _ in range(60)]
    sets += [s - {rng.choice(sorted(s))} | {rng.randrange(60)} for s in sets] + [set(), {1000 + k for k in range(9)}]
    want = {(i, j, round(len(a & b) / len(a | b), 9)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b and len(a & b) * t.denominator >= len(a | b) * t.numerator}
    rows = Stage(spark, "sets").put(spark.createDataFrame([*[(k, sorted(s)) for k, s in enumerate(sets)], (None, [1, 2])], "key long, runs array<long>"), "rows")
    for least, keys in ((1, 7), (1_000_000, 1_000_000)):
        monkeypatch.setattr(S, "LEAST_RUNS", least)
        monkeypatch.setattr(S, "KEYS_AT_ONCE", keys)
        got = [(r["a"], r["b"], round(r["score"], 9)) for r in S.similar_sets(Stage(spark, "sim"), rows, t).collect()]
        assert len(got) == len(set(got)) > 20 and set(got) == want


def test_links_leave_only_themselves(spark):
    """What a field's links were found with is gone when they are there."""
    folder = shared_dir(spark).removeprefix("file://")
    before = size(folder)
    assert A.duplicate_links(spark, SF).count() >= 0
    assert size(folder) - before < 0.2 * os.path.getsize(f"{SF}/{A.ACCEPTED}.parquet")
