"""Ordered keep-first de-duplication and greedy selection over fingerprint records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components
from siltstone.plans.staging import Stage

BANDS, BAND_BITS = 4, 16
#: The bits beside a band in blocks, one more than bits that may differ.
BLOCKS, BLOCK_BITS = 7, 7
KEEP, REVIEW, REJECT = "keep", "review", "reject"


def hex_long(c: str) -> Column:
    """A 16-digit hex string as a signed 64-bit number."""
    high, low = F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), F.conv(F.substring(c, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def pair_verdict(a: str, b: str) -> Column:
    """What the later record `a` gets beside the earlier `b`: exact and template copies, then near ones by length ratio
    and Hamming distance. Templates count from 30 tokens, rejection as near from 60, review from 40."""
    col = lambda side, name: F.col(f"{side}.{name}")
    n = col(a, "tokens")
    ratio = F.greatest(n, col(b, "tokens")) / F.greatest(F.lit(1), F.least(n, col(b, "tokens")))
    distance = F.bit_count(col(a, "sim").bitwiseXOR(col(b, "sim")))
    return (
        F.when(col(a, "exact") == col(b, "exact"), REJECT).when((col(a, "template") == col(b, "template")) & (n >= 30), REJECT)
        .when((n >= 60) & (ratio <= 1.2) & (distance <= 3), REJECT).when((n >= 40) & (ratio <= 1.35) & (distance <= 6), REVIEW).otherwise(KEEP)
    )


def bands(sim: Column) -> Column:
    """Join keys of a fingerprint: two that agree in one of four 16-bit bands and differ in at most six bits share one.

    Of the 48 bits beside an equal band at most six differ, so of seven blocks of them one agrees too. A key is a band with
    one such block, 23 bits instead of 16, which leaves a hundredth of the pairs that bands alone would meet."""
    keys = []
    for i in range(BANDS):
        band = F.shiftrightunsigned(sim, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))
        low = sim.bitwiseAND(F.lit((1 << (i * BAND_BITS)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(sim, (i + 1) * BAND_BITS), i * BAND_BITS) if i < BANDS - 1 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(BLOCKS):
            block = F.shiftrightunsigned(rest, j * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
            keys.append(F.lit((i * BLOCKS + j) << (BAND_BITS + BLOCK_BITS)).cast("long").bitwiseOR(F.shiftleft(band, BLOCK_BITS)).bitwiseOR(block))
    return F.array(*keys)


def band_pairs(stage: Stage, rows: DataFrame) -> DataFrame:
    """(id_a, id_b, verdict) for a later id_a and an earlier id_b that share a band and are near, by `pair_verdict`.

    rows: (id, exact, template, sim, tokens), `id` giving the order, one row per `exact`. Rows under 40 tokens cannot be
    near; they make no band keys. Null fingerprints are left out.
    """
    able = rows.where("sim is not null and tokens >= 40")
    keyed = stage.put(able.select("id", "exact", "template", "sim", "tokens", F.explode(bands(F.col("sim"))).alias("band")), "bands")
    a, b = keyed.alias("a"), keyed.alias("b")
    n = F.greatest("a.tokens", "b.tokens") / F.least("a.tokens", "b.tokens")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") > F.col("b.id"))).where(n <= 1.35).where(F.bit_count(F.col("a.sim").bitwiseXOR(F.col("b.sim"))) <= 6)
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), pair_verdict("a", "b").alias("verdict")).where(F.col("verdict") != KEEP).distinct()


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ordered rule within one linked group: a row meets only earlier rows that were not rejected."""
    templates: dict[str, tuple] = {}
    kept: list[tuple] = []  # in the order of ids, as rows come
    by_band: dict[tuple[int, int], list[int]] = {}
    out = []
    for r in pdf.sort_values("id").itertuples(index=False):
        prior = templates.get(r.template)
        verdict, of = KEEP, None
        if prior is not None:
            verdict, of = (REJECT if r.tokens >= 30 or prior[1] == r.exact else REVIEW), prior[0]
        elif not pd.isna(r.sim):
            own = int(r.sim) & ((1 << 64) - 1)
            for k in sorted({k for i in range(BANDS) for k in by_band.get((i, own >> (BAND_BITS * i) & 0xFFFF), ())}):
                p = kept[k]
                x = own ^ p[2]
                ratio = max(r.tokens, p[1]) / max(1, min(r.tokens, p[1]))
                if r.tokens >= 60 and ratio <= 1.2 and x.bit_count() <= 3:
                    verdict, of = REJECT, p[0]
                elif r.tokens >= 40 and ratio <= 1.35 and x.bit_count() <= 6:
                    verdict, of = REVIEW, p[0]
                if of is not None:
                    break
        if verdict != REJECT:
            if r.template is not None:
                templates.setdefault(r.template, (r.id, r.exact))
            if not pd.isna(r.sim):
                own = int(r.sim) & ((1 << 64) - 1)
                for i in range(BANDS):
                    by_band.setdefault((i, own >> (BAND_BITS * i) & 0xFFFF), []).append(len(kept))
                kept.append((r.id, int(r.tokens), own))
        out.append((r.id, verdict, of))
    return pd.DataFrame(out, columns=["id", "verdict", "of"])


def keep_first(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(id, verdict, of): the ordered rule over (id, exact, template, sim, tokens), in the order of `id`.

    Copies by `exact` are folded first: a copy of a record that stays is rejected as its copy, a copy of a rejected one
    gets the same verdict as that. Of the rest only records linked by a shared template or a near pair are replayed, one
    task a linked group; a record without links stays. A shared template under 30 tokens means review. Nulls: a null
    `exact` or `template` equals nothing, a null `sim` is near nothing. Ids are taken as distinct.
    """
    stage = Stage(spark, "keepfirst")
    solid = stage.put(rows.withColumn("exact", F.coalesce("exact", F.concat(F.lit("?"), "id"))), "rows")
    first = solid.groupBy("exact").agg(F.min_by(F.struct("id", "template", "sim", "tokens"), "id").alias("f")).select("exact", "f.*")
    heads = stage.put(first, "heads")
    low = heads.where("template is not null").groupBy("template").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = stage.put(band_pairs(stage, heads), "near")
    node = lambda c: F.xxhash64(c)
    links = heads.join(low, "template").where("id <> low").select(node("id").alias("u"), node("low").alias("v")).union(near.select(node("id_a").alias("u"), node("id_b").alias("v")))
    parts = connected_components(spark, links)
    linked = heads.withColumn("node", node("id")).join(parts, "node")
    replayed = linked.select("component", "id", "exact", "template", "sim", "tokens").groupBy("component").applyInPandas(_replay, "id string, verdict string, of string")
    judged = heads.select("exact", "id").join(stage.put(replayed, "replayed"), "id", "left").select("exact", F.col("id").alias("head"), F.coalesce("verdict", F.lit(KEEP)).alias("v"), "of")
    copy = F.col("id") != F.col("head")
    verdict = F.when(copy & (F.col("v") != REJECT), REJECT).otherwise(F.col("v"))
    return solid.join(judged, "exact").select("id", verdict.alias("verdict"), F.when(copy & (F.col("v") != REJECT), F.col("head")).otherwise(F.col("of")).alias("of"))


def greedy_select(rows: DataFrame, group: str, order: list[Column], quotas: dict[str, int], family_cap: int) -> DataFrame:
    """(id): per group in `order`, each row is taken unless its family is full or its tokens overrun the group's quota.

    rows: (group, id, family, tokens). Skipping and going on depends on all earlier choices of the group, so each group
    is one ordered stream; rows stream through, and only family counters are held. Rows that alone overrun the quota
    are filtered first. Groups without a quota get nothing; null tokens count as 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        families: dict[tuple, int] = {}
        for b in batches:
            out = []
            for g, i, f, n in zip(b["g"], b["id"], b["family"], b["tokens"]):
                if families.get((g, f), 0) >= family_cap > 0 or used.get(g, 0) + n > quotas.get(g, -1):
                    continue
                out.append(i)
                used[g] = used.get(g, 0) + n
                families[g, f] = families.get((g, f), 0) + 1
            yield pd.DataFrame({"id": pd.Series(out, dtype=object)})

    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]) if quotas else F.create_map().cast("map<string,int>")
    small = rows.select(F.col(group).alias("g"), "id", F.coalesce("family", "id").alias("family"), F.coalesce("tokens", F.lit(0)).alias("tokens"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    able = small.where(F.col("tokens") <= F.coalesce(F.element_at(quota, F.col("g")), F.lit(-1)))
    streams = able.repartition("g").sortWithinPartitions("g", *[f"_o{i}" for i in range(len(order))])
    return streams.select("g", "id", "family", "tokens").mapInPandas(run, "id string")


def near_sims(stage: Stage, rows: DataFrame) -> DataFrame:
    """(sim, near): for each fingerprint of (sim, tokens) the others within 6 bits that share a band with it.

    A row of 40 tokens or more can be near an earlier one of 40 / 1.35 tokens; shorter rows make no band keys.
    """
    sims = rows.where("sim is not null and tokens * 1.35D >= 40").select("sim").distinct()
    keyed = stage.put(sims.select("sim", F.explode(bands(F.col("sim"))).alias("band")), "bands")
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.sim") != F.col("b.sim"))).where(F.bit_count(F.col("a.sim").bitwiseXOR(F.col("b.sim"))) <= 6)
    return met.select(F.col("a.sim").alias("sim"), F.col("b.sim").alias("other")).groupBy("sim").agg(F.collect_set("other").alias("near"))


def greedy_unique(spark: SparkSession, rows: DataFrame, group: str, order: list[Column], quotas: dict[str, int], family_cap: int) -> DataFrame:
    """(id): as `greedy_select`, groups in the order of their names, and no row is taken beside a copy taken before.

    rows: (group, id, family, tokens, exact, template, sim). Family, then quota, then copies are tested, in all groups so
    far: the same `exact`, the same `template` from 30 tokens, or near from 40 by length ratio, band and Hamming distance.
    Near fingerprints come from a join; the choice is one ordered stream, as a copy in one group frees quota in the
    next. It holds family counts and the prints of taken rows. Nulls equal nothing and are near nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        families: dict[tuple, int] = {}
        exact: set[str] = set()
        templates: set[str] = set()
        sims: dict[int, set[int]] = {}
        for b in batches:
            out = []
            for g, i, f, n, e, t, s, near in zip(b["g"], b["id"], b["family"], b["tokens"], b["exact"], b["template"], b["sim"], b["near"]):
                if families.get((g, f), 0) >= family_cap > 0 or used.get(g, 0) + n > quotas.get(g, -1):
                    continue
                if e in exact or n >= 30 and t in templates:
                    continue
                if s is not None and n >= 40 and any(max(n, m) / max(1, min(n, m)) <= 1.35 for x in (s, *(() if near is None else near)) for m in sims.get(int(x), ())):
                    continue
                out.append(i)
                used[g] = used.get(g, 0) + n
                families[g, f] = families.get((g, f), 0) + 1
                if e is not None:
                    exact.add(e)
                if t is not None:
                    templates.add(t)
                if s is not None:
                    sims.setdefault(int(s), set()).add(n)
            yield pd.DataFrame({"id": pd.Series(out, dtype=object)})

    stage = Stage(spark, "unique")
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if quotas else F.create_map().cast("map<string,long>")
    small = rows.select(F.col(group).alias("g"), "id", F.coalesce("family", "id").alias("family"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "exact", "template", "sim", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    able = stage.put(small.where(F.col("tokens") <= F.coalesce(F.element_at(quota, F.col("g")), F.lit(-1))), "able")
    # As text: a null beside longs would make Pandas turn fingerprints to floats.
    stream = able.join(near_sims(stage, able), "sim", "left").withColumn("sim", F.col("sim").cast("string")).repartition(1).sortWithinPartitions("g", *[f"_o{i}" for i in range(len(order))])
    return stream.select("g", "id", "family", "tokens", "exact", "template", "sim", "near").mapInPandas(run, "id string")
