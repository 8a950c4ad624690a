"""Mixing sources to target weights: Sainte-Laguë block quotas, then seeded selection of token blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ranking import running_total, seeded_hash
from siltstone.plans.slices import latest_sources
from siltstone.plans.staging import Stage
from siltstone.sources.tables import label

BLOCK_TOKENS = 2048
SHARDS = 16
#: A source manifest is a hand-made list; its rows are read by the driver and must stay under this number.
MOST_SOURCES = 100_000


def _seats_at(weight: Fraction, divisor: Fraction, cap: int) -> int:
    """How many quotients weight / 1, weight / 3, weight / 5, … are at least `divisor`, at most `cap`."""
    times = weight / divisor
    return 0 if times < 1 else min(cap, (int(times) - 1) // 2 + 1)


def sainte_lague(weights: dict[str, float], blocks: int, caps: dict[str, int]) -> dict[str, int]:
    """Seats of each source: `blocks` go one by one to the highest quotient weight / (2 × seats + 1) below its cap.

    All quotients above some divisor are taken, so the divisor is found by bisection over exact fractions, each step
    counting quotients by a division; what ties or the last step leave, fewer seats than there are sources, is dealt one
    by one. The work does not grow with the number of blocks. Ties go to the lesser name. Blocks that no source may take
    stay undealt.
    """
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0 and caps[s] > 0}
    if blocks <= 0 or not exact:
        return dict.fromkeys(weights, 0)
    total = lambda d: sum(_seats_at(w, d, caps[s]) for s, w in exact.items())
    if sum(caps[s] for s in exact) <= blocks:
        return {s: caps[s] if s in exact else 0 for s in weights}
    high = max(exact.values()) * 2  # no quotient reaches it
    low = min(exact.values()) / (2 * (blocks + 1) + 1)
    while total(low) <= blocks:
        low /= 2
    # More than `blocks` quotients reach `low`, at most `blocks` reach `high`.
    for _ in range(200):
        middle = ((low + high) / 2).limit_denominator(1 << 62)
        if not low < middle < high or total(high) + len(exact) > total(low):
            break
        low, high = (middle, high) if total(middle) > blocks else (low, middle)
    seats = {s: _seats_at(exact[s], high, caps[s]) if s in exact else 0 for s in weights}
    heap = [(-w / (2 * seats[s] + 1), s) for s, w in exact.items() if seats[s] < caps[s]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(seats.values())):
        _, s = heapq.heappop(heap)
        seats[s] += 1
        if seats[s] < caps[s]:
            heapq.heappush(heap, (-exact[s] / (2 * seats[s] + 1), s))
    return seats


def source_records(slice_: DataFrame) -> DataFrame:
    """(record_id, source_id, tokens) of each distinct record with a source; null counts are 0."""
    rows = slice_.select("record_id", label("source_id").alias("source_id"), F.coalesce("actual_token_count", F.lit(0)).cast("long").alias("tokens"))
    return rows.where("record_id is not null and source_id is not null").groupBy("record_id").agg(F.max("source_id").alias("source_id"), F.max("tokens").alias("tokens"))


def mix_plan(spark: SparkSession, slice_: DataFrame, manifest: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source with a target: target_tokens, max_repeats, supply, `wanted` (its share of all supplies),
    `cap` (supply × max_repeats), quota in blocks, planned tokens and planned share.

    A null max_repeats sets no cap. Sources without records have supply 0 and get nothing. Sources with a null target
    take no part. An empty manifest or slice gives no or zero quotas.
    """
    supply = source_records(slice_).groupBy("source_id").agg(F.sum("tokens").alias("supply"))
    joined = latest_sources(manifest).where("target_tokens is not null").join(supply, "source_id", "left")
    rows = sorted(joined.limit(MOST_SOURCES + 1).collect(), key=lambda r: r["source_id"])
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(r["supply"] or 0 for r in rows)
    asked = sum(r["target_tokens"] for r in rows)
    weights = {r["source_id"]: float(max(0, r["target_tokens"])) for r in rows}
    caps = {r["source_id"]: (10**15 if r["max_repeats"] is None and r["supply"] else (r["supply"] or 0) * (r["max_repeats"] or 0) // block_tokens) for r in rows}
    quotas = sainte_lague(weights, total // block_tokens, caps)
    dealt = sum(quotas.values()) or 1
    out = []
    for r in rows:
        s, had = r["source_id"], r["supply"] or 0
        wanted = r["target_tokens"] * total / asked if asked else 0.0
        cap = None if r["max_repeats"] is None else float(r["max_repeats"] * had)
        out.append((s, r["target_tokens"], r["max_repeats"], had, float(wanted), cap, quotas[s], quotas[s] * block_tokens, quotas[s] / dealt))
    return spark.createDataFrame(out, "source_id string, target_tokens long, max_repeats int, supply long, wanted double, cap double, blocks long, planned_tokens long, planned_share double")


def mix_sources(spark: SparkSession, slice_: DataFrame, manifest: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """(source_id, record_id, pass, block, shard, tokens): the records of the mixture, repeats as further passes.

    Within a source, records stand in seeded order and form a stream of tokens that starts over at each pass; a quota
    of q blocks takes the stream's first q blocks (a record belongs to the block where it begins). Blocks are dealt
    evenly to shards, so each shard has its whole-number part of every quota. Records of 0 tokens go with their place.
    """
    plan = mix_plan(spark, slice_, manifest, block_tokens).where("blocks > 0 and supply > 0").select("source_id", "supply", "blocks")
    rows = Stage(spark, "mix").put(source_records(slice_).join(F.broadcast(plan), "source_id").withColumn("_h", seeded_hash(seed, "record_id")), "records")
    placed = running_total(rows, ["source_id"], "_h", ["record_id"], "tokens", "_before")
    length = F.lit(block_tokens) * F.col("blocks")
    passes = F.ceil((length - F.col("_before")) / F.col("supply"))
    copies = placed.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    block = F.floor((F.col("pass") * F.col("supply") + F.col("_before")) / F.lit(block_tokens))
    return copies.withColumn("block", block).where("block < blocks").select("source_id", "record_id", "pass", "block", F.floor(F.col("block") * shards / F.col("blocks")).cast("int").alias("shard"), "tokens")


def mix_report(spark: SparkSession, slice_: DataFrame, manifest: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The plan of each source with the tokens and share that the drawn records really have."""
    drawn = mix_sources(spark, slice_, manifest, block_tokens).groupBy("source_id").agg(F.sum("tokens").alias("actual_tokens"))
    plan = mix_plan(spark, slice_, manifest, block_tokens)
    both = plan.join(drawn, "source_id", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    whole = both.agg(F.sum("actual_tokens").alias("_all"))
    return both.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.try_divide("actual_tokens", "_all")).drop("_all")
