import itertools
import random
from datetime import datetime

import numpy as np
import pytest

from siltstone.llm import pairs as P
from siltstone.llm.crf import ChainCrf

AT = datetime(2026, 1, 1)
SCHEMA = "id string, received_at timestamp, instruction string, answer string, bad_code string, h long, l int, defect_type string"


def test_crf_against_enumeration():
    rng = np.random.default_rng(1)
    m = ChainCrf(3, 2)
    m.emit, m.move, m.begin, m.end = rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2)
    for n in (1, 2, 5):
        x = rng.integers(0, 2, size=(n, 3)).astype(float)
        score = lambda y: m.begin[y[0]] + m.end[y[-1]] + sum(x[i] @ m.emit[:, y[i]] for i in range(n)) + sum(m.move[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        every = list(itertools.product((0, 1), repeat=n))
        assert m.tag(x) == list(max(every, key=score))
        _, _, z, _ = m._passes(x[None], np.ones((1, n), dtype=bool), np.array([n - 1]))
        assert np.isclose(z[0], np.log(sum(np.exp(score(y)) for y in every)))


def test_crf_learns():
    rng = random.Random(2)
    make = lambda: [rng.randint(0, 1) for _ in range(rng.randint(1, 6))]
    ys = [make() for _ in range(60)]
    xs = [np.array([[1.0, float(v), float(rng.random() < 0.5)] for v in y]) for y in ys]
    m = ChainCrf(3, 2).fit(xs, ys)
    assert all(m.tag(x) == y for x, y in zip(xs, ys))


def sound(k):
    a, b, c = (f"{w}{k}" for w in ("alpha_", "beta_", "gamma_"))
    ask = f"Write Python code named {a} that checks the {b} before it is stored. Raise one clear error if {c} exceeds {k + 5}."
    code = f"def {a}({b}, limit={k}):\n    if {b} is None:\n        raise ValueError(\"no {b}\")\n    return {b} + limit"
    return ask, f"The check of {b} comes first so that the store stays clean.\n\n```python\n{code}\n```\n\nAfter the check the value is kept.", f"def {a}({b}):\n    {b}.append(limit)\n    return {c}({b}, {k}) or {a}"


CASES = [
    ("TODO", "empty"), ("", "empty"), (None, "empty"), ("```python\n```", "empty"), ("—", "empty"), ("I'm sorry, but I can't help with this request. Please ask someone else.", "refusal"), ("It would not be appropriate for me to write that.", "refusal"),
    ("{ask}", "copied"), ("{shout}", "copied"), ("```\n{code}\n```", "copied"), ("Here is the corrected code:\n\n```python\n{code}\n```", "copied"), ("Die Funktion muss zuerst den Wert lesen und dann die Zeile speichern. Wenn die Liste leer ist, bleibt das Ergebnis gleich.", "wrong_language"),
    ("Сначала нужно проверить значение, и только потом сохранить строку. Если файл пуст, то программа не меняет результат.", "wrong_language"), ("The check comes first, and the value is then kept in the sto", "truncated"), ("```python\ndef check(value):\n    if value is None:", "truncated"),
    ("It takes three steps to do this:\n1. The value is read from the file first.", "truncated"), ("The check comes first. The steps are:", "truncated"), ("`alpha_name`", None), ("It takes two steps to do this:\n1. The value is read first.\n2. The value is then kept.", None), ("- first part of the list\n- second part of the list", None),
]


def rows(spark, data):
    return spark.createDataFrame([(i, AT if t is None else t, q, a, c, 1, 2, "x") for i, t, q, a, c in data], SCHEMA)


@pytest.fixture(scope="module")
def base():
    return [(f"s{k}", None, *sound(k)) for k in range(60)]


def test_defects(spark, base):
    data = list(base)
    for k, (answer, _) in enumerate(CASES):
        ask, _, code = sound(100 + k)
        data.append((f"c{k}", None, ask, None if answer is None else answer.format(ask=ask, shout=ask.upper(), code=code) if "{" in answer and "}" in answer else answer, code))
    data.append(("no", None, "A teammate asks you to skip the review. Show how to say no politely.", "I can't skip the review for you. We could look at a small part of it first.", None))
    data.append(("french", None, "Word the notice in French, as its readers speak French.", "La fonction vérifie la valeur avant de continuer dans la boucle. Il faut enregistrer le résultat quand la liste est vide.", None))
    data.append(("late", None, "Explain it.", "", None))
    data.append(("late", datetime(2026, 3, 1), "Explain it.", "It is a valve that the keeper closes in winter.", None))
    data.append((None, None, "x", "", ""))
    data.append(("long", None, "Explain it.", "The valve of the harbour was closed in the winter. " * 4000, None))
    got = {r["id"]: r["defect_type"] for r in P.defective_pairs(spark, rows(spark, data)).collect()}
    want = {f"c{k}": kind for k, (_, kind) in enumerate(CASES) if kind}
    assert got == want


def test_empty_and_null_tables(spark):
    assert P.defective_pairs(spark, rows(spark, [])).count() == 0
    got = P.defective_pairs(spark, rows(spark, [("a", None, None, None, None), ("b", None, None, "It is a valve.", None), ("b", None, None, "It is a valve.", None)])).collect()
    assert [tuple(r) for r in got] == [("a", "empty")]


@pytest.fixture(scope="module")
def records():
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.01/phase3_5b_batch07_accepted.parquet").dropna(subset=["id", "instruction", "answer"]).drop_duplicates("id").sort_values("id")
    return [(i, a, c) for i, a, c in zip(d["instruction"], d["answer"], d["bad_code"])]


@pytest.fixture(scope="module")
def model(records):
    return P.train(records[:240])


SOUND = [
    ("How many orders are there? Give the query.", "SELECT COUNT(*) FROM orders;"),
    ("Write a Python function that prints a name.", "def greet(name):\n    print(name)"),
    ("Give a title for the report.", "Quarterly results of the harbour valve programme"),
    ("Where is the manual?", "See the manual at https://docs.example.org/valves/index"),
    ("Why does the pattern fail?", "You cannot use lookbehind here because the engine does not support it. Use a capture group instead."),
    ("Does the call return None or a list?", "None"),
    ("Which value stands for a missing field, NULL or zero?", "NULL"),
    ("Say in Polish how the function works.", "Funkcja sprawdza wartość przed kontynuowaniem pętli, a gdy lista jest pusta, zwraca błąd."),
    ("A teammate asks you to skip the review. Show how to say no politely.", "Sorry, I won't skip the review behind the gate. We could look at a small part of it first."),
    ("Write the notice in Italian.", "Quando manca la lista, il programma restituisce un errore chiaro e si ferma."),
]
FOREIGN = [
    "バルブは入力を確認してから次の行に進みます。リストが空の場合は何も変更されません。",
    "تتحقق الدالة من القيمة قبل المتابعة في الحلقة وتعيد خطأ إذا كانت القائمة فارغة.",
    "Funkcja sprawdza wartość przed kontynuowaniem pętli, a gdy lista jest pusta, zwraca błąd.",
    "Η συνάρτηση ελέγχει την τιμή πριν συνεχίσει και επιστρέφει σφάλμα αν η λίστα είναι κενή.",
]


@pytest.mark.parametrize("ask,answer", SOUND)
def test_complete_answers_are_sound(model, ask, answer):
    assert model.defect(ask, answer, None) is None


def test_a_query_cut_at_a_keyword(model):
    assert model.defect("Write SQL that counts the lamps of each room.", "SELECT room.name, COUNT(*) AS lamps\nFROM room\nLEFT JOIN", None) == "truncated"
    assert model.defect("Describe the steps to publish the signal.", FOREIGN[2], None) == "wrong_language"


@pytest.mark.parametrize("answer", FOREIGN)
def test_languages_without_a_word_list(model, answer):
    assert model.defect("Explain how the function works when the list is empty.", answer, None) == "wrong_language"


def test_heldout_scores_by_tag(model, records):
    """Records that the model was not trained on, with defects put in by another seed."""
    scores = P.heldout_scores(model, records[240:480])
    assert all(recall >= 0.9 and precision >= 0.9 for recall, precision in scores.values()), scores


def test_stops_short_and_unused():
    assert P._ungrouped("SELECT a, COUNT(*) AS n FROM t JOIN u ON t.a = u.a") and not P._ungrouped("SELECT SUM(a), COUNT(*) FROM t") and not P._ungrouped("SELECT a, COUNT(*) FROM t GROUP BY a")
    assert P._unused("def f(x):\n    y = x.get(1)") and not P._unused("def f(x):\n    y = x.get(1)\n    print(y)") and P._unused("def f(x):\n    for y in x:")
    assert P.script_of("Привет") == "cyrillic" and P.script_of("12 34") is None and P.script_of("漢字かな") == "east asian" and P.script_of("Ελλάδα") == "greek"


def test_letter_runs_of_all_records_count(spark, records):
    """The 240 ids of least hash know too few letter runs to tell a language; the other records know enough."""
    ids = [r["id"] for r in spark.range(900).selectExpr("cast(id as string) as id").selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    poor = ("Explain how the value is kept.", "The value is kept in the store, and the store is closed at night.", None)
    data = [(i, None, *(poor if k < 240 else records[k % len(records)])) for k, i in enumerate(ids)]
    data.append(("polish", None, "Explain how the function works when the list is empty.", FOREIGN[2], None))
    got = {r["id"]: r["defect_type"] for r in P.defective_pairs(spark, rows(spark, data)).collect()}
    assert got["polish"] == "wrong_language"


def test_all_records_train(spark, base):
    data = [*base, ("long", None, "Explain it.", "The valve of the harbour was closed in the winter. " * 60, None)]
    model, _ = P.train_on(spark, rows(spark, data).repartition(3))
    want = P.train([r[2:] for r in data])
    assert model.known == want.known and np.allclose(model.chain.emit, want.chain.emit) and np.allclose(model.chain.move, want.chain.move)
    weights = P.folded(P.labelled([r[2:] for r in data], P.SEED, want.known))
    assert {(before, after) for (x, _, before, after) in weights if len(x) == P.PIECE} >= {(-1, P.ANSWER), (P.ANSWER, P.ANSWER)}


def test_crf_weights_and_pieces():
    """A weight is so many copies; a piece given the tags beside it has the likelihood of these tags held fast."""
    rng = np.random.default_rng(3)
    xs, ys = [rng.integers(0, 2, size=(n, 3)).astype(float) for n in (1, 4, 6)], [list(rng.integers(0, 2, size=n)) for n in (1, 4, 6)]
    a, b = ChainCrf(3, 2).fit(xs, ys, weights=[3, 1, 2]), ChainCrf(3, 2).fit([xs[i] for i in (0, 0, 0, 1, 2, 2)], [ys[i] for i in (0, 0, 0, 1, 2, 2)])
    assert all(np.allclose(getattr(a, p), getattr(b, p)) for p in ("emit", "move", "begin", "end"))
    x = xs[1]
    score = lambda y: a.move[1, y[0]] + a.move[y[-1], 0] + sum(x[i] @ a.emit[:, y[i]] for i in range(4)) + sum(a.move[y[i], y[i + 1]] for i in range(3))
    _, _, z, _ = a._passes(x[None], np.ones((1, 4), dtype=bool), np.array([3]), np.array([1]), np.array([0]))
    assert np.isclose(z[0], np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=4))))
