"""Held-out passages inside training documents, found with suffix arrays over the documents.

Each partition of the documents is cut into shards of whole documents. A shard's words form one sequence with marks
between documents. A suffix whose first five words are no run of any prompt cannot agree with a prompt that far, so the
suffix array lists only the others, in the order of the runs that follow: it is built by prefix doubling over run
numbers, in memory linear in the shard. Every suffix of every held-out prompt is searched in the array by bisection,
which gives all locations of its five words; bisection over the length of the agreeing spans then gives the longest
verbatim match. A document lies in one shard whole, so counts per document and item are final there, and only findings
leave the scan.

The held-out set is measured before any of it is read. A set of more than PASS_CHARS characters is searched in passes,
each over a part of the items and all documents; an item lies in one part whole, so the findings of the passes unite.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.staging import spread

RUN = 5
LEAST_RUNS, LEAST_PART = 8, 35  # runs, and per cent of the prompt's runs
#: Words of a shard (a longer document is a shard alone); characters of the prompts of one pass, an item beyond it alone.
SHARD_WORDS, PASS_CHARS = 200_000, 30_000_000
#: Pairs of a run of a document and an item that are held at once, unless one document has more.
MOST_AT_ONCE = 4_000_000
_WORDS = re.compile(r"[a-z0-9]+")
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

FOUND = "doc_id long, eval_id string, runs int, prompt_runs int, longest int, at_word int"


def _run_keys(words: np.ndarray) -> np.ndarray:
    """A 64-bit key of the run of five word numbers that starts at each place, the last four left out."""
    n = len(words) - RUN + 1
    key = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(RUN):
        key = (key ^ words[k : k + len(key)].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


class Prompts:
    """Held-out prompts as run numbers, from 1, one sequence with a 0 after each: suffixes, items and runs.

    Memory is linear in the words of all prompts, whatever the length of one.
    """

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.number: dict[str, int] = {}
        self.ids = [i for i, _ in rows]
        keys, items = [], []
        for k, (_, text) in enumerate(rows):
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in _WORDS.findall((text or "").lower())], dtype=np.int64)
            own = _run_keys(w)
            keys += [own, np.zeros(1, dtype=np.uint64)]
            items.append(np.full(len(own) + 1, k, dtype=np.int64))
        empty = [np.zeros(0, dtype=np.uint64)]
        flat = np.concatenate(keys or empty)
        ends = np.cumsum([len(x) for x in items]) - 1 if items else np.zeros(0, dtype=np.int64)
        real = np.ones(len(flat), dtype=bool)
        real[ends.astype(np.int64)] = False
        self.keys, inverse = np.unique(flat[real], return_inverse=True)
        self.sequence = np.zeros(len(flat), dtype=np.int64)
        self.sequence[real] = inverse + 1
        self.item = np.concatenate(items) if items else np.zeros(0, dtype=np.int64)
        starts = np.flatnonzero(real)
        self.starts = starts[np.argsort(self.sequence[starts], kind="stable")]  # where suffixes begin, by their first run
        self.first_run = self.sequence[self.starts]
        #: Distinct (run, item), sorted by run.
        pairs = np.stack([self.sequence[self.starts], self.item[self.starts]]) if len(self.starts) else np.zeros((2, 0), dtype=np.int64)
        self.run_items = np.unique(pairs, axis=1)
        self.totals = np.bincount(self.run_items[1], minlength=len(rows))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The prompts' run number at each place of a document's words, 0 where no prompt has that run."""
        own = _run_keys(words)
        if not len(self.keys) or not len(own):
            return np.zeros(len(own), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, at + 1, 0)


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """The places of the numbers above 0 in the order of the numbers that follow up to the next 0, by prefix doubling."""
    places = np.flatnonzero(sequence)
    rank = np.append(sequence, 0).astype(np.int64)
    n, step = len(sequence), 1
    while True:
        following = np.where(places + step <= n, rank[np.minimum(places + step, n)], 0)
        order = np.lexsort((following, rank[places]))
        a, b = rank[places][order], following[order]
        fresh = np.zeros(len(rank), dtype=np.int64)
        fresh[places[order]] = 1 + np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if len(places) else 0
        settled = not len(places) or not following.any() or fresh.max() == len(places)
        rank = fresh
        if settled:
            return places[order]
        step *= 2


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for all places of the ranges."""
    sizes = last - first
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def search_shard(prompts: Prompts, docs: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """Rows of FOUND for all pairs of a document of the shard and an item that share a run."""
    parts, owners, begin, at = [], [], np.zeros(len(docs), dtype=np.int64), 0
    for k, (_, w) in enumerate(docs):
        begin[k] = at
        own = np.append(prompts.numbers(w), 0)
        parts.append(own)
        owners.append(np.full(len(own), k, dtype=np.int64))
        at += len(own)
    sequence = np.append(np.concatenate(parts), 0) if parts else np.zeros(1, dtype=np.int64)
    if not sequence.any():
        return []
    owner = np.concatenate(owners)
    array = suffix_array(sequence)
    # Each distinct (document, run) counts for every item that has the run.
    seen = np.unique(np.stack([owner[array], sequence[array]]), axis=1)
    left, right = np.searchsorted(prompts.run_items[0], seen[1], "left"), np.searchsorted(prompts.run_items[0], seen[1], "right")
    if (right - left).sum() > MOST_AT_ONCE and len(docs) > 1:  # stock phrases of many items: fewer documents at once
        half = len(docs) // 2
        return search_shard(prompts, docs[:half]) + search_shard(prompts, docs[half:])
    which, place = _each(left, right)
    pairs, counts = np.unique(seen[0][which] * len(prompts.ids) + prompts.run_items[1][place], return_counts=True)
    longest, where = _longest(prompts, sequence, array, owner, pairs)
    doc, item = pairs // len(prompts.ids), pairs % len(prompts.ids)
    rows = zip(doc.tolist(), item.tolist(), counts.tolist(), (longest + RUN - 1).tolist(), (where - begin[doc]).tolist())
    return [(docs[d][0], prompts.ids[i], c, int(prompts.totals[i]), length, place) for d, i, c, length, place in rows]


class Spans:
    """Equality of spans of number sequences, by polynomial hashes of their prefixes; 0 ends a span."""

    def __init__(self, sequence: np.ndarray, powers: np.ndarray):
        value = (sequence.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(31)
        self.powers, n = powers, len(sequence)
        # prefix[i] = Σ value[k] · base^(n - 1 - k) over k < i, so a span's hash is a difference and a factor.
        self.prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * powers[n - 1 :: -1][:n], dtype=np.uint64)])
        ends = np.where(sequence == 0, np.arange(n), n)
        self.left = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)  # numbers up to the next 0
        self.size = n

    def hashes(self, at: np.ndarray, length: np.ndarray, scale: int) -> np.ndarray:
        """Hashes that agree with those of any other Spans of one `scale`, at least the size of each."""
        return (self.prefix[at + length] - self.prefix[at]) * self.powers[scale - self.size + at]


def _common(one: Spans, a: np.ndarray, two: Spans, b: np.ndarray) -> np.ndarray:
    """How many numbers agree from each place a of one and b of two on, by bisection over span hashes."""
    scale = max(one.size, two.size)
    low, high = np.ones(len(a), dtype=np.int64), np.minimum(one.left[a], two.left[b])
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = one.hashes(a, middle, scale) == two.hashes(b, middle, scale)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _grouped(run: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (run, before), and of each group its run, what is before, its first place in the order and its size."""
    order = np.lexsort((before, run))
    r, f = run[order], before[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])]))
    return order, r[first], f[first], first, np.diff(np.append(first, len(order)))


def _longest(prompts: Prompts, sequence: np.ndarray, array: np.ndarray, owner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (document × items + item) the most runs that follow each other in both, and where in the shard.

    A longest match cannot be made longer to the left. So a prompt suffix meets only the places of its range in the array
    whose run before is another than its own, which leaves one meeting for a passage copied whole, not one per suffix;
    how far they agree is found by bisection. Meetings are taken in blocks, of equal matches the first place counts.
    """
    best, where = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    present = np.unique(sequence[array])
    _, at = _each(np.searchsorted(prompts.first_run, present, "left"), np.searchsorted(prompts.first_run, present, "right"))
    suffix = prompts.starts[at]
    before = lambda numbers, places: np.where(places > 0, numbers[np.maximum(places - 1, 0)], 0)
    s_order, s_run, s_before, s_first, s_size = _grouped(prompts.sequence[suffix], before(prompts.sequence, suffix))
    p_order, p_run, p_before, p_first, p_size = _grouped(sequence[array], before(sequence, array))
    pg, sg = _each(np.searchsorted(s_run, p_run, "left"), np.searchsorted(s_run, p_run, "right"))
    differ = (s_before[sg] != p_before[pg]) | (s_before[sg] == 0)
    pg, sg = pg[differ], sg[differ]
    reach = np.cumsum(s_size[sg] * p_size[pg])
    powers = np.ones(max(len(sequence), len(prompts.sequence)) + 1, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, _BASE, dtype=np.uint64), dtype=np.uint64)
    ours, theirs = Spans(sequence, powers), Spans(prompts.sequence, powers)
    for begin in range(0, int(reach[-1]) if len(reach) else 0, MOST_AT_ONCE):
        index = np.arange(begin, min(begin + MOST_AT_ONCE, int(reach[-1])))
        group = np.searchsorted(reach, index, "right")
        within = index - (reach[group] - s_size[sg[group]] * p_size[pg[group]])
        s = suffix[s_order[s_first[sg[group]] + within % s_size[sg[group]]]]
        position = array[p_order[p_first[pg[group]] + within // s_size[sg[group]]]]
        length = _common(ours, position, theirs, s)
        key = owner[position] * len(prompts.ids) + prompts.item[s]
        order = np.lexsort((position, -length, key))
        key, position, length = key[order], position[order], length[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at, length, position = np.searchsorted(pairs, key[first]), length[first], position[first]
        better = (length > best[at]) | (length == best[at]) & (position < where[at])
        best[at[better]], where[at[better]] = length[better], position[better]
    return best, where


def _parts(heldout: DataFrame, pass_chars: int) -> list[DataFrame]:
    """The held-out items in parts of about `pass_chars` characters, by the hash of their id."""
    rows = heldout.where("id is not null").select("id", "prompt")
    chars = rows.agg(F.sum(F.length("prompt"))).first()[0] or 0
    n = int(-(-chars // pass_chars)) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n)) == k) for k in range(n)]


def shared_runs(spark: SparkSession, documents: DataFrame, heldout: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """FOUND for every document and held-out item that share a run of five words.

    runs: distinct runs of the prompt that the document has; longest: words of the longest verbatim match; at_word: its
    first word in the document, from 0. Null texts and prompts, and those under five words, have no runs. Rows of a
    repeated doc_id are judged each for itself, and so are rows of a repeated item id. A larger held-out set takes more
    passes over the documents, none is refused.
    """
    return reduce(DataFrame.union, [_one_pass(spark, documents, part) for part in _parts(heldout, pass_chars)])


def _one_pass(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.collect()  # of bounded size, by _parts
    sent = spark.sparkContext.broadcast(Prompts([(r["id"], r["prompt"]) for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prompts = sent.value
        get, names = prompts.number.get, [c.split()[0] for c in FOUND.split(", ")]
        shard, size = [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if not text:
                    continue
                w = np.array([get(x, 0) for x in _WORDS.findall(text.lower())], dtype=np.int64)
                if size and size + len(w) > SHARD_WORDS:
                    yield pd.DataFrame(search_shard(prompts, shard), columns=names)
                    shard, size = [], 0
                shard.append((doc_id, w))
                size += len(w)
        if shard:
            yield pd.DataFrame(search_shard(prompts, shard), columns=names)

    return spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id").mapInPandas(run, FOUND)


def leaks(spark: SparkSession, documents: DataFrame, heldout: DataFrame) -> DataFrame:
    """The rows of `shared_runs` with at least 8 and at least 35 % of the prompt's runs."""
    return shared_runs(spark, documents, heldout).where((F.col("runs") >= LEAST_RUNS) & (F.col("runs") * 100 >= F.col("prompt_runs") * LEAST_PART))


def clean_documents(spark: SparkSession, documents: DataFrame, heldout: DataFrame) -> DataFrame:
    """The documents that give no item away; rows without doc_id stay."""
    bad = leaks(spark, documents, heldout).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")
