"""64-bit similarity hashes of token multisets, and answer masks of token lists."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]")
#: Longer token lists are strided to at most so many, as the value is defined.
MOST_TOKENS = 50_000


class TokenBits:
    """The ±1 bit vector of each token, remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        self.known: dict[str, np.ndarray] = {}
        self.most = most

    def of(self, token: str) -> np.ndarray:
        v = self.known.get(token)
        if v is None:
            if len(self.known) >= self.most:
                self.known.clear()
            raw = np.frombuffer(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), dtype=np.uint8)
            v = self.known[token] = np.unpackbits(raw).astype(np.int64) * 2 - 1
        return v

    def simhash(self, text: str | None) -> str:
        """16 hex digits: a bit is set where the tokens' votes do not sum below 0; all zeros for no tokens."""
        tokens = [t.lower() for t in _TOKEN.findall(text or "")]
        tokens = tokens[:: -(-len(tokens) // MOST_TOKENS)] if len(tokens) > MOST_TOKENS else tokens
        if not tokens:
            return "0" * 16
        names, counts = np.unique(np.array(tokens, dtype=object), return_counts=True)
        votes = np.stack([self.of(t) for t in names])
        return np.packbits((counts @ votes >= 0).astype(np.uint8)).tobytes().hex()


def _simhashes(batch: pd.Series) -> pd.Series:
    bits = TokenBits()
    return pd.Series([bits.simhash(t) for t in batch], dtype=object)


def simhash64(text: str | Column) -> Column:
    return F.pandas_udf(_simhashes, StringType())(F.col(text) if isinstance(text, str) else text)


def answer_mask(ids: Column, opening: int, closing: int) -> Column:
    """A 0/1 array over token ids ending in an end mark: ones from after the first `opening` through the next `closing`,
    and for the end mark; null where there is no complete answer."""
    start = F.array_position(ids, opening)
    rest = F.slice(ids, start.cast("int") + 1, F.size(ids))
    stop = start + F.array_position(rest, closing)
    whole = (start > 0) & (F.array_position(rest, closing) > 0)
    return F.when(whole, F.transform(ids, lambda _, i: ((i >= start) & (i < stop) | (i == F.size(ids) - 1)).cast("int")))
