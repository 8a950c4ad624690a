import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tokens as K

RX = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]")
AT = datetime(2026, 1, 1)
TRIE = K.PieceTrie(most_nodes=60)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab_Z019..  \t\n\x1c\x85 ٣é-()\U0001f600")) | st.characters(), max_size=120))
def test_trie_counts_as_the_pattern(text):
    assert TRIE.count(text) == len(RX.findall(text))


def test_long_pieces_and_resets():
    for text in ("a" * 5000, "1.2.3" * 500, "x." * 900 + "7", None, "", "   "):
        assert TRIE.count(text) == len(RX.findall(text or ""))


SCHEMA = "record_id string, audited_at timestamp, full_record_tokens int, rendered string, source_kind string, language string, category string, stated int, tokens int, l int"


def rows(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in data], SCHEMA)


def test_wrong_counts_and_budget(spark):
    late = datetime(2026, 5, 1)
    data = [
        ("a", AT, 1, "x y z", "K ", "Python", "c"), ("a", late, 3, "x y z", "k", "python", "c"), ("b", AT, None, "x", "k", "python", "c"), ("c", AT, 11, "w " * 10, "k", None, None), ("d", AT, 12, "w " * 10, "k", None, None),
        ("e", AT, 9, "w " * 10, "k", None, None), ("f", None, 0, None, None, None, None), ("g", AT, 1, None, None, None, None), (None, AT, 7, "q", "k", "k", "k"), ("b", AT, None, "x", "k", "python", "c"), ("h", AT, 8, "w " * 10, "k", None, None),
    ]
    df = rows(spark, data)
    assert {r[0] for r in K.wrong_counts(df).collect()} == {"b", "d", "g", "h"}
    budget = {(r["source_kind"], r["language"]): (r["records"], r["tokens"], r["stated_tokens"]) for r in K.token_budget(df).collect()}
    assert budget == {("k", "python"): (2, 4, 3), ("k", None): (4, 40, 40), (None, None): (2, 0, 1)}


def test_empty_table(spark):
    assert K.wrong_counts(rows(spark, [])).count() == 0 and K.token_budget(rows(spark, [])).count() == 0
