"""Exact lexical token counts through prefix tries, and token budgets per slice.

A text is the join of its pieces, the maximal runs without white space, and no token crosses white space. So a text's
count is the sum over its pieces. Each partition of the text table keeps a prefix trie of the distinct pieces it has
met; a trie node carries the state of the tokenizer after its prefix: how many tokens have begun, and what the last
one can still become. A new piece starts from the state of its longest known prefix, and a piece's terminal count is
joined to every occurrence in place. Nothing is shuffled, and memory is bounded by the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siltstone.sources.tables import label

#: A trie is started anew when it has so many nodes; counts do not depend on it.
MOST_NODES = 400_000
#: Beyond this depth a piece goes on without nodes of its own.
DEEPEST = 64

#: The lexical token pattern, with the white space of Python's `\s` written out for other engines.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEXICAL = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?|[^" + WHITE + "]"

_OPEN, _NAME, _WHOLE, _POINT, _FRACTION = range(5)


def step(tokens: int, mode: int, c: str) -> tuple[int, int]:
    """State after one more character. A point after digits counts as a token until a digit makes it a fraction."""
    if c.isdecimal():
        if mode == _POINT:
            return tokens - 1, _FRACTION
        if mode in (_WHOLE, _FRACTION) or mode == _NAME and c <= "9":
            return tokens, mode
        return tokens + 1, _WHOLE
    if c == "_" or "a" <= c <= "z" or "A" <= c <= "Z":
        return (tokens, _NAME) if mode == _NAME else (tokens + 1, _NAME)
    return tokens + 1, _POINT if c == "." and mode == _WHOLE else _OPEN


class PieceTrie:
    """Prefix trie of pieces with a tokenizer state at each node."""

    def __init__(self, most_nodes: int = MOST_NODES):
        self.most_nodes = most_nodes
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.state: list[tuple[int, int]] = [(0, _OPEN)]
        self.terminal: dict[str, int] = {}

    def _add(self, piece: str) -> int:
        if len(self.state) > self.most_nodes:
            self._clear()
        node, child, state = 0, self.child, self.state
        for c in piece[:DEEPEST]:
            at = child.get((node, c))
            if at is None:
                at = child[node, c] = len(state)
                state.append(step(*state[node], c))
            node = at
        tokens, mode = state[node]
        if len(piece) > DEEPEST:
            for c in piece[DEEPEST:]:
                tokens, mode = step(tokens, mode, c)
            return tokens
        self.terminal[piece] = tokens
        return tokens

    def count(self, text: str | None) -> int:
        """Lexical tokens of a text; 0 for null."""
        if not text:
            return 0
        total, known = 0, self.terminal.get
        for piece in text.split():
            n = known(piece)
            if n is None:
                n = self._add(piece)
                known = self.terminal.get
            total += n
        return total


def _counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    trie = PieceTrie()
    for batch in texts:
        yield pd.Series([trie.count(t) for t in batch], dtype="int64")


def lexical_count(text: str | Column) -> Column:
    """The number of lexical tokens of a text column; 0 for null and empty texts."""
    return F.pandas_udf(_counts, LongType())(F.col(text) if isinstance(text, str) else text)


def token_counts(inventory: DataFrame) -> DataFrame:
    """(record_id, source_kind, language, category, stated, tokens): the latest row of each record, counted.

    Texts are counted where they are read and dropped before the shuffle. Of rows with one `audited_at` the larger
    statement holds. Labels are trimmed in lower case; null ids are left out; null texts have 0 tokens.
    """
    rows = inventory.where("record_id is not null").select(
        "record_id", "audited_at", F.col("full_record_tokens").alias("stated"), lexical_count("rendered").alias("tokens"),
        *[label(c).alias(c) for c in ("source_kind", "language", "category")],
    )
    parts = ("stated", "tokens", "source_kind", "language", "category")
    last = rows.groupBy("record_id").agg(F.max(F.struct("audited_at", *parts)).alias("l"))
    return last.select("record_id", *[F.col(f"l.{c}").alias(c) for c in parts])


def wrong_counts(inventory: DataFrame) -> DataFrame:
    """(record_id): the stated count is null or more than a tenth away from the tokens of the text."""
    off = F.col("stated").isNull() | (F.abs(F.col("stated") - F.col("tokens")) * 10 > F.col("tokens"))
    return token_counts(inventory).where(off).select("record_id")


def token_budget(inventory: DataFrame) -> DataFrame:
    """(source_kind, language, category, records, tokens, stated_tokens) per slice of the inventory."""
    sums = (F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"), F.sum("stated").alias("stated_tokens"))
    return token_counts(inventory).groupBy("source_kind", "language", "category").agg(*sums)
