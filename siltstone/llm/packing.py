"""Filling containers of fixed capacity with texts that are neighbours along a Hilbert curve.

Each text becomes a hashed bag-of-words vector, projected to three dimensions; its place on a Hilbert curve through
that space is the sort key, so texts that stand together are alike. A range sort by key cuts the curve into
partitions, and each partition packs along its stretch of curve: small windows of neighbours, best fit from the longest
down, into the few containers still open, so a container holds texts of one short stretch. Windows do not depend on how
rows are batched. Only (doc_id, tokens, key) is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tokens import PieceTrie
from siltstone.plans.staging import Stage, spread

CAPACITY = 2048
BUCKETS, DIMENSIONS, BITS, SEED = 1024, 3, 10, 29
#: Items of one packing window, containers kept open between windows, items of one partition of the curve. Small windows
#: keep the texts of a container close together on the curve; on sf0.1 128 and 16 fill 99.6 % at a span of 1.4 % of it.
WINDOW, OPEN, ITEMS = 128, 16, 25_000


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of integer coordinates below 2**bits (transpose form, then interleaving)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    q = np.int64(1 << (bits - 1))
    while q > 1:
        p = q - 1
        for k in range(len(x)):
            turn = (x[k] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] if k == 0 else x[k] ^ swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for k in range(len(x)):
            key = (key << 1) | (((x[k] ^ t) >> bit) & 1)
    return key


class Placer:
    """Tokens and curve cell of a text."""

    def __init__(self):
        self.trie, self.bucket = PieceTrie(), {}
        self.project = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))

    def cell(self, text: str | None) -> tuple[int, list[int]]:
        if not text or not (pieces := text.split()):
            return 0, [0] * DIMENSIONS
        if len(self.bucket) > 200_000:
            self.bucket.clear()
        known, ids = self.bucket, []
        for p in pieces:
            b = known.get(p)
            if b is None:
                b = known[p] = zlib.crc32(p.lower().encode("utf-8", "replace")) % BUCKETS
            ids.append(b)
        vector = np.sqrt(np.bincount(ids, minlength=BUCKETS))
        along = (vector @ self.project) / np.sqrt(len(ids))
        return self.trie.count(text), [min((1 << BITS) - 1, int((1 + erf(z / 1.4142)) / 2 * (1 << BITS))) for z in along]


def placed(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens, key) of every row of (doc_id, text); null and empty texts have 0 tokens and key 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = Placer()
        for b in batches:
            got = [place.cell(t) for t in b["text"]]
            cells = np.array([c for _, c in got], dtype=np.int64).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([n for n, _ in got], dtype=np.int64), "key": hilbert_index(cells)})

    return spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, tokens long, key long")


class Packer:
    """Best fit from the longest down over windows; containers stay open between windows while room is left."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: list[tuple[int, int]] = []  # (room, container), ascending

    def pack(self, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes), dtype=np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            n = int(sizes[i])
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, container = self.open.pop(at)
            else:
                room, container, self.next = self.capacity, self.next, self.next + 1
            out[i] = container
            insort(self.open, (room - n, container))
        self.open = sorted(heapq.nlargest(OPEN, (o for o in self.open if o[0] > 0)))
        return out


def packed(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, parts, tokens, container_id, place): every text in containers of `capacity` tokens.

    Texts up to the capacity have one part; longer ones, and only they, are split into full parts and a rest. Empty
    texts take no room. `place` counts along the curve, from a high number of its own in each partition. Repeated rows of
    a doc_id are items of their own; an empty table gives no rows.
    """
    stage = Stage(spark, "packing")
    items = stage.put(placed(documents), "items")
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    whole = items.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    sized = whole.withColumn("tokens", F.least(F.lit(capacity), F.col("tokens") - (F.col("part") - 1) * capacity))
    count = max(1, -(-items.count() // ITEMS))
    curve = sized.repartitionByRange(count, "key", "doc_id", "part").sortWithinPartitions("key", "doc_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        packer, held, place = Packer(capacity, first), None, first

        def window(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal place
            place += len(rows)
            return rows.assign(container_id=packer.pack(rows["tokens"].to_numpy()), place=np.arange(place - len(rows), place))

        for b in batches:
            held = b if held is None or not len(held) else pd.concat([held, b])
            whole = len(held) // WINDOW * WINDOW
            if whole:
                yield pd.concat([window(held.iloc[k : k + WINDOW]) for k in range(0, whole, WINDOW)])
                held = held.iloc[whole:]
        if held is not None and len(held):
            yield window(held)

    rows = curve.select("doc_id", "part", "parts", "tokens")
    return rows.mapInPandas(run, "doc_id long, part int, parts int, tokens long, container_id long, place long")


def container_fill(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, fewest, span): how many containers are used, the least number that could be, and the
    mean stretch of the curve that a container of several texts takes its texts from, as a share of all texts."""
    stage = Stage(spark, "fill")
    rows = stage.put(packed(spark, documents, capacity).where("tokens > 0"), "packed")
    used = rows.groupBy("container_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("texts"), (F.max("place") - F.min("place")).alias("stretch"))
    sums = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.sum("texts").alias("texts"), F.avg(F.when(F.col("texts") > 1, F.col("stretch"))).alias("stretch"))
    return sums.select(
        "containers", "tokens", F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("fewest"), F.try_divide("stretch", "texts").alias("span")
    )


def split_texts(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id): the texts that no container holds whole."""
    return packed(spark, documents, capacity).where("parts > 1").select("doc_id").distinct()
