"""Sinks: JSON lines, CSV and Markdown reports, partitioned outputs, tagged text, token files. Commits are Spark's own:
a reader sees a whole output or none."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines with keys in order; with `order`, files are in that order over the whole output."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """CSV with a fixed header; further columns are left out, missing ones are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).csv(path, header=True)


def write_by_status(df: DataFrame, path: str, keys: tuple[str, ...] = ("source", "status"), mode: str = "errorifexists") -> None:
    """One folder per source and status. Rows are not shuffled to writers by key, so a hot source stays spread."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def write_tagged(df: DataFrame, path: str, text: str = "rendered", mode: str = "errorifexists") -> None:
    """Tagged records with a blank line between them."""
    df.select(F.col(text)).write.mode(mode).option("lineSep", "\n\n").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def canonical_json(value) -> bytes:
    """Indented JSON with sorted keys and a final line end."""
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def write_tokens(df: DataFrame, path: str, order: list[str], ids: str = "ids", mask: str | None = None) -> int:
    """A flat uint16 file of token ids in `order`, with a uint8 mask file beside it; the number of tokens.

    Rows stream through the driver one partition at a time, as the format is one file."""
    total = 0
    with Path(f"{path}.bin").open("wb") as out, Path(f"{path}.mask.bin").open("wb") as masks:
        for row in df.select(*order, ids, *([mask] if mask else [])).orderBy(*order).toLocalIterator():
            values = np.asarray(row[ids], dtype=np.int64)
            if len(values) and (values.min() < 0 or values.max() > 0xFFFF):
                raise ValueError("a token id does not fit 16 bits")
            values.astype("<u2").tofile(out)
            (np.asarray(row[mask]) if mask else np.ones(len(values))).astype(np.uint8).tofile(masks)
            total += len(values)
    return total
