import random
import re

from siltstone.llm import leaks as L

DOCS = "doc_id long, text string, id string, eval_id string, runs int, longest int"


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def runs(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def longest(a, b):
    a, b = words(a), words(b)
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = last[j - 1] + 1
                best = max(best, row[j])
        last = row
    return best


def tables(spark, docs, prompts):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in docs], DOCS), spark.createDataFrame(prompts, "id string, prompt string")


def fixture(seed):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    stock = " ".join(r.choices(vocabulary, k=9))
    prompts = [(f"e{i}", " ".join(r.choices(vocabulary, k=r.choice([3, 5, 20, 60]))) + " " + stock * (i % 2)) for i in range(20)] + [("none", None), ("blank", ""), (None, "a b c d e f")]
    docs = []
    for i in range(120):
        text = r.choices([*vocabulary, "other", "foreign"], k=r.choice([0, 4, 50, 300]))
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(prompts[:20])[1])
            a = r.randrange(len(w))
            text[len(text) // 2 : len(text) // 2] = w[a : a + r.choice([4, 12, 30, 80])]
        docs.append((i, " ".join(text).upper() if i % 3 else ", ".join(text)))
    return docs + [(500, None), (501, ""), (502, "z " * 250_000 + prompts[3][1]), (7, docs[7][1]), (None, "x")], prompts


def test_findings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_WORDS", 900)
    docs, prompts = fixture(6)
    d, h = tables(spark, docs, prompts)
    got = {(r["doc_id"], r["eval_id"]): r for r in L.shared_runs(spark, d, h).collect()}
    want = {(i, e): len(runs(t) & runs(p)) for i, t in docs if i is not None for e, p in prompts if e is not None and runs(t) & runs(p)}
    assert {k: r["runs"] for k, r in got.items()} == want
    for (i, e), r in list(got.items())[:80]:
        if i != 502:
            text, prompt = dict(docs)[i], dict(prompts)[e]
            assert r["longest"] == longest(text, prompt) and r["prompt_runs"] == len(runs(prompt))
            w = words(text)[r["at_word"] : r["at_word"] + r["longest"]]
            assert " ".join(w) in " ".join(words(prompt))
    leaked = {k for k in want if want[k] >= 8 and want[k] * 100 >= 35 * len(runs(dict(prompts)[k[1]]))}
    assert {(r["doc_id"], r["eval_id"]) for r in L.leaks(spark, d, h).collect()} == leaked
    clean = {r["doc_id"] for r in L.clean_documents(spark, d, h).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in leaked}


def test_empty_tables(spark):
    docs, prompts = fixture(1)
    d, h = tables(spark, docs, prompts)
    none = tables(spark, [], [])
    assert L.leaks(spark, none[0], h).count() == 0 and L.leaks(spark, d, none[1]).count() == 0
    assert L.clean_documents(spark, d, none[1]).count() == len(docs)


def test_passes_and_small_blocks_change_nothing(spark, monkeypatch):
    docs, prompts = fixture(3)
    d, h = tables(spark, docs, prompts)
    whole = sorted(map(tuple, L.shared_runs(spark, d, h).collect()))
    assert len(L._parts(h, 700)) > 1
    assert sorted(map(tuple, L.shared_runs(spark, d, h, pass_chars=700).collect())) == whole
    import numpy as np

    prompt = L.Prompts([(i, p) for i, p in prompts if i])
    shard = [(i, np.array([prompt.number.get(w, 0) for w in words(t)], dtype=np.int64)) for i, t in docs[:60]]
    rows = sorted(L.search_shard(prompt, shard))
    monkeypatch.setattr(L, "MOST_AT_ONCE", 20)
    assert sorted(L.search_shard(prompt, shard)) == rows and rows


def test_suffix_array_is_sorted():
    import numpy as np

    r = random.Random(2)
    for _ in range(20):
        sequence = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(60)], dtype=np.int64)
        order = L.suffix_array(sequence)

        def after(i):
            out = []
            while i < len(sequence) and sequence[i]:
                out.append(int(sequence[i]))
                i += 1
            return out

        assert sorted(order) == np.flatnonzero(sequence).tolist()
        assert [after(i) for i in order] == sorted(after(i) for i in order)


def test_one_very_long_prompt_takes_linear_memory():
    """A prompt of 50,000 words, varied or of one word only, against a shard that holds it."""
    import tracemalloc

    import numpy as np

    for text in (" ".join(f"w{i * 7919 % 9001}" for i in range(50_000)), "same " * 6_000):
        tracemalloc.start()
        prompt = L.Prompts([("long", text), ("other", "w1 w2 w3 w4 w5 w6")])
        shard = [(k, np.array([prompt.number[w] for w in words(text)], dtype=np.int64)) for k in range(3)]
        rows = L.search_shard(prompt, shard)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(r[0], r[4], r[5]) for r in rows if r[1] == "long"] == [(k, len(words(text)), 0) for k in range(3)]
        assert peak < 300e6
