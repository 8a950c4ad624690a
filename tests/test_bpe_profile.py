from types import SimpleNamespace

import pandas as pd
import pytest

from siltstone.plans import markup as M


class Letters:
    """A tokenizer of single characters that remembers how many it was given at once."""

    def __init__(self):
        self.most = 0

    def get_vocab_size(self):
        return 128

    def encode_batch_fast(self, texts, add_special_tokens):
        self.most = max(self.most, sum(map(len, texts)))
        return [SimpleNamespace(ids=[ord(c) for c in x]) for x in texts]

    def decode(self, ids, skip_special_tokens):
        return "".join(map(chr, ids)).replace("~", "")


def test_encodings_are_bounded(monkeypatch):
    """The texts of a batch are not all encoded at once; ids leave as the set of a source."""
    monkeypatch.setattr(M, "AT_ONCE", 10)
    monkeypatch.setattr(M, "HELD", 2)
    t = Letters()
    frames = list(M.profiled(t, iter([pd.DataFrame({"source": ["a", None, "a", "b", "a"], "text": ["abc", "", "abcabc~", "x" * 12, "cd"]})] * 3)))
    assert t.most == 12
    out = pd.concat(frames)
    assert len(frames) > 3 and not out.duplicated(["source", "id"]).all()
    sums = out[out["id"] < 0].groupby("source", dropna=False)[["texts", "bytes", "tokens", "failed"]].sum()
    assert {s if isinstance(s, str) else None: tuple(r) for s, *r in sums.itertuples()} == {"a": (9, 36, 36, 3), "b": (3, 36, 36, 0), None: (3, 0, 0, 0)}
    assert {(s, chr(i)) for s, i in zip(out["source"], out["id"]) if i >= 0} == {("a", c) for c in "abcd~"} | {("b", "x")}


def test_source_without_tokens_stays(spark, tmp_path):
    spark.createDataFrame([(1, "red lamp", "A"), (2, "red", " a "), (3, "", "b"), (4, "x", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r for r in M.bpe_profile(spark, str(tmp_path)).collect()}
    assert {s: (r["texts"], r["bytes"], r["failures"]) for s, r in got.items()} == {"a": (2, 11, 0), "b": (1, 0, 0), None: (1, 1, 0)}
    assert got["b"]["used_tokens"] == got["b"]["tokens"] == 0 and got["b"]["bytes_per_token"] is None
    assert got["a"]["bytes_per_token"] == pytest.approx(11 / got["a"]["tokens"], abs=1e-6) and got["a"]["used_tokens"] == 2
