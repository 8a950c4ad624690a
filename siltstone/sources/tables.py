"""Table scans. Every query reads its tables through `table`, whole and by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name`; with `columns`, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def label(column) -> F.Column:
    """A label without regard to letter case and surrounding white space."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
