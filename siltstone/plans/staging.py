"""Written intermediate tables: they cut lineage and survive the loss of executors.

Files go to the folder that the session names in `spark.checkpoint.dir`; only where that is unset (tests, a laptop)
a temporary folder is made and set. Each call of `Stage` owns one sub-folder, so iterations can delete what they no
longer need.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors for intermediate tables."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltstone-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer parts than there are cores, spread over all of them by `key` before costly work on each row; any
    larger scan as it is, so nothing is shuffled where files are many. Rows and results are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores, key) if few else df


#: Removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Writes DataFrames as Parquet under one fresh folder and reads them back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and return the scan of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def put_each(self, parts: Iterable[Callable[[], DataFrame]], name: str) -> DataFrame:
        """The union of tables of one schema, made and written one after another; the shuffle files of each are gone
        before the next begins."""
        before, schema = self.spark.conf.get(CLEANUP, None), None
        for make in parts:
            df = make()
            try:
                self.spark.conf.set(CLEANUP, "true")
                # A frame takes the setting from its session when it is planned, so it is planned anew here.
                df.select("*").write.mode("append" if schema else "overwrite").option("compression", "zstd").parquet(self.path(name))
            finally:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
            schema = df.schema
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        self._delete(self.path(name))

    def drop_all(self) -> None:
        """Delete all tables of this stage."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
