"""The incremental path: a stream of documents is de-duplicated and sorted by status as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.plans.staging import shared_dir
from siltstone.sources.tables import label

SCHEMA = "doc_id long, text string, source string, fetched_at timestamp"
#: How late a copy may arrive and still be known; bounds the state of the stream.
LATE = "400 days"


def judged(rows: DataFrame) -> DataFrame:
    """(doc_id, source, fetched_at, normalized_sha256, status) of document rows; the same plan for batch and stream."""
    t = rows.where("text is not null").select("doc_id", label("source").alias("source"), "fetched_at", F.sha2(T.normalize_text("text"), 256).alias("normalized_sha256"), T.normalize_rows("text").alias("t")).withColumn("k", T.lexical_tokens("t"))
    reject, review = R.row_quality("t", "k")
    return t.select("doc_id", "source", "fetched_at", "normalized_sha256", R.status(reject, review).alias("status"))


def run_status_stream(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Reads the Parquet files at `source` that are not yet read, drops copies within the watermark, and appends to one
    folder per status. A batch that is run again writes to the same folder by its number, so nothing doubles."""
    rows = spark.readStream.schema(SCHEMA).parquet(source)
    first = judged(rows).withWatermark("fetched_at", LATE).dropDuplicatesWithinWatermark(["normalized_sha256"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={number}")

    query = first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and status as the stream sorts them."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_status_stream(spark, f"{d}/documents.parquet*", f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy("source", "status").agg(F.count(F.lit(1)).alias("records"))


def batch_status(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole table at once: distinct normal forms per status."""
    rows = judged(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "fetched_at"))
    return rows.groupBy("status").agg(F.countDistinct("normalized_sha256").alias("records"))


_T = "SELECT text, " + T.sql_rows("text") + " AS t FROM documents WHERE text IS NOT NULL"
_K = f"SELECT text, t, {T.sql_lexical('t')} AS k FROM ({_T})"
_A, _B = R.sql_row_quality("t", "k")
SQL = {"batch_status": f"SELECT {R.sql_status(_A, _B)} AS status, count(DISTINCT {T.sql_normalize('text')}) AS records FROM ({_K}) GROUP BY 1"}
QUERIES = {"stream_status": stream_status, "batch_status": batch_status}
