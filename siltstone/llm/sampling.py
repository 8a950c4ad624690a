"""A sample with wanted category shares: quotas go down a category tree, records are drawn by permuted dense rank."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ranking import permuted_rank, seeded_hash
from siltstone.sources.tables import label

LEVELS = ("language", "category", "difficulty")
#: A target table is a hand-made plan; its rows are read by the driver and must stay under this number.
MOST_CELLS = 100_000
SAMPLE_PART = 5  # the sample holds one record in so many


@dataclass
class Node:
    """A category: its quota, what its records can give, what must be kept."""

    want: float = 0.0
    least: int = 0
    supply: int = 0
    given: int = 0
    children: dict = field(default_factory=dict)


def _whole(parts: list[float], total: int) -> list[int]:
    """Integers near `parts` that sum to `total`: floors, then one each by largest remainder."""
    out = [math.floor(p + 1e-9) for p in parts]
    order = sorted(range(len(parts)), key=lambda i: (out[i] - parts[i], i))
    for i in order[: max(0, total - sum(out))]:
        out[i] += 1
    return out


def _fill(nodes: list[Node], quota: int) -> list[int]:
    """Shares `quota` among siblings by want, from `least` up to `supply`; what one cannot give goes to the others."""
    given = [min(n.least, n.supply) for n in nodes]
    rest = quota - sum(given)
    ideal = sum(n.want for n in nodes)
    goal = [n.want / ideal * quota if ideal else 0.0 for n in nodes]
    while rest > 0:
        open_ = [i for i, n in enumerate(nodes) if given[i] < n.supply]
        if not open_:
            break
        short = [i for i in open_ if goal[i] > given[i]]
        weight = {i: goal[i] - given[i] for i in short} or {i: max(nodes[i].want, 1e-9) for i in open_}
        scale = sum(weight.values())
        ids = sorted(weight)
        extra = _whole([min(rest * weight[i] / scale, nodes[i].supply - given[i]) for i in ids], min(rest, sum(min(math.ceil(rest * weight[i] / scale), nodes[i].supply - given[i]) for i in ids)))
        moved = 0
        for i, e in zip(ids, extra):
            e = min(e, nodes[i].supply - given[i], rest - moved)
            given[i] += e
            moved += e
        rest -= moved
        if not moved:
            break
    return given


def allocate(cells: list[tuple], size: int) -> dict[tuple, int]:
    """Quota of each cell. cells: (path of labels, share, minimum, supply), one row a path; size: records wanted.

    A node's quota goes to its children by share. Minimum counts come first (less only where supply is short). What a
    leaf cannot give goes to its siblings with records left, then, as their parent reports less capacity, to cousins.
    """
    root = Node()
    for path, share, least, supply in cells:
        node = root
        for step in (None, *path):
            node = node if step is None else node.children.setdefault(step, Node())
            node.want += (share or 0.0) * size
            node.supply += supply
            node.least += min(least or 0, supply)

    out: dict[tuple, int] = {}

    def down(node: Node, quota: int, path: tuple) -> None:
        if not node.children:
            out[path] = quota
            return
        keys = sorted(node.children)
        for key, part in zip(keys, _fill([node.children[k] for k in keys], quota)):
            down(node.children[key], part, (*path, key))

    down(root, max(size, root.least), ())
    return out


def distinct_records(accepted: DataFrame) -> DataFrame:
    """(id, language, category, difficulty) of the latest row of each non-null id, labels trimmed in lower case."""
    latest = F.max(F.struct("received_at", *[label(c).alias(c) for c in LEVELS])).alias("_l")
    return accepted.where("id is not null").groupBy("id").agg(latest).select("id", *[F.col(f"_l.{c}").alias(c) for c in LEVELS])


def cell_report(spark: SparkSession, accepted: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per target row: labels as stored, `wanted` = max(share × size, minimum), `supply`, `quota`, `unmet`.

    size defaults to a fifth of the distinct ids. `quota` is what the sample draws from the cell: below `wanted`
    where supply is short, above where it takes over what siblings or cousins lack. A cell with a null label has no
    records. Repeated targets of one cell add up. No targets: no rows.
    """
    ids = distinct_records(accepted)
    counts = ids.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("supply"))
    if size is None:
        size = int(ids.count() // SAMPLE_PART)
    keyed = targets.select(*LEVELS, "target_share", "min_records", *[label(c).alias(f"_{c}") for c in LEVELS])
    counts = counts.select("supply", *[F.col(c).alias(f"_{c}") for c in LEVELS])
    rows = keyed.join(counts, [f"_{c}" for c in LEVELS], "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    local = rows.limit(MOST_CELLS + 1).collect()
    if len(local) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} target cells")
    merged: dict[tuple, list] = {}
    for r in local:
        path = tuple(r[f"_{c}"] or "" for c in LEVELS)
        cell = merged.setdefault(path, [0.0, 0, r["supply"]])
        cell[0] += r["target_share"] or 0.0
        cell[1] = max(cell[1], r["min_records"] or 0)
    quotas = allocate([(p, *c) for p, c in merged.items()], size)
    out = []
    for r in local:
        path = tuple(r[f"_{c}"] or "" for c in LEVELS)
        wanted = max((r["target_share"] or 0.0) * size, float(r["min_records"] or 0))
        out.append((*[r[c] for c in LEVELS], float(wanted), int(r["supply"]), int(quotas[path]), max(0.0, wanted - r["supply"])))
    return spark.createDataFrame(out, "language string, category string, difficulty string, wanted double, supply long, quota long, unmet double")


def sample_by_targets(spark: SparkSession, accepted: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 11) -> DataFrame:
    """(id, language, category, difficulty, rank) of the drawn records: per cell those of permuted rank ≤ quota."""
    report = cell_report(spark, accepted, targets, size)
    quota = report.select(*[label(c).alias(c) for c in LEVELS], "quota").distinct()
    ids = distinct_records(accepted).join(F.broadcast(quota), list(LEVELS)).withColumn("_h", seeded_hash(seed, "id"))
    ranked = permuted_rank(ids, list(LEVELS), "_h", ["id"])
    return ranked.where("rank <= quota").select("id", *LEVELS, "rank")
