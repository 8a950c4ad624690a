import random

import pytest

from siltstone.functions import text as T
from siltstone.plans import markup as M


def plain_rule(rows):
    """One owner map over all kept texts, text after text, in plain Python. rows: (id, normal form, set of runs)."""
    normal, owner, out = {}, {}, {}
    for i, h, runs in sorted(rows):
        if h in normal:
            out[i] = ("reject", normal[h])
            continue
        held = {}
        for g in runs:
            if g in owner:
                held[owner[g]] = held.get(owner[g], 0) + 1
        top = max(held, key=held.get, default=None)
        if top is not None and held[top] / len(runs) >= M.OWNED:
            out[i] = ("reject", top)
            continue
        out[i] = ("keep", None)
        normal[h] = i
        for g in runs:
            owner.setdefault(g, i)
    return out


def both(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", T.normalize_text("text").alias("h"), T.window_hashes(T.lexical_tokens("text"), M.OWNER_RUN).alias("runs"))
    want = plain_rule([(r["doc_id"], r["h"], frozenset(r["runs"])) for r in df.collect()])
    return {r["doc_id"]: (r["verdict"], r["of"]) for r in M.owner_dedup(spark, str(folder)).collect()}, want


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def test_runs_of_an_unlinked_owner_do_not_count(spark, tmp_path):
    shared = words("s", 30)
    texts = {1: words("a", 100) + shared, 2: shared + words("b", 70), 3: shared + words("b", 70) + ["end"], 4: words("c", 60), 5: [*words("c", 60), "end"], 6: words("c", 60)}
    got, want = both(spark, tmp_path, {i: " ".join(w) for i, w in texts.items()})
    assert got == want
    assert got[3] == ("keep", None) and got[5] == ("reject", 4) and got[6] == ("reject", 4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_owners_match_the_plain_global_rule(spark, tmp_path, seed):
    r = random.Random(seed)
    blocks = [words(f"k{b}x", r.randint(8, 40)) for b in range(12)]
    texts = {}
    for i in r.sample(range(1, 1000), 120):
        if texts and r.random() < 0.6:
            w = list(r.choice(list(texts.values())))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 6)] = words(f"n{i}y", r.randint(0, 4)) if r.random() < 0.5 else r.choice(blocks)[:10]
        else:
            w = sum(r.sample(blocks, r.randint(1, 4)), [])
        texts[i] = w
    got, want = both(spark, tmp_path, {i: " ".join(w) for i, w in texts.items()})
    assert got == want and {v for v, _ in got.values()} == {"keep", "reject"}
