"""Queries through sinks and readers: what is written in each format and read back, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.plans import audit
from siltstone.plans.corpus import DOCS, docs
from siltstone.plans.staging import Stage
from siltstone.sources import readers, sinks
from siltstone.sources.tables import label, table

RECORD = "id string, language string, category string, difficulty string, instruction string, constraints array<string>, answer string, bad_code string, reasoning string, edge_cases array<string>, quality_notes array<string>"


def json_lines_roundtrip(spark, d):
    """Accepted records written as JSON lines with sorted keys and read by schema; nulls are left out and come back null."""
    stage = Stage(spark, "jsonl")
    sinks.write_json_lines(audit.records(spark, d, *audit.FIELDS), stage.path("records"))
    r = readers.json_lines(spark, stage.path("records"), RECORD)
    return r.select("id", "language", F.md5(F.coalesce("instruction", F.lit("-"))).alias("instruction_md5"), F.md5(F.coalesce("answer", F.lit("-"))).alias("answer_md5"), F.col("bad_code").isNull().alias("no_code"), F.coalesce(F.size("constraints"), F.lit(-1)).alias("constraints"))


def tagged_roundtrip(spark, d):
    """(record_md5, copies): rendered records written as tagged text and cut again before each <instruction>."""
    stage = Stage(spark, "tagged")
    sinks.write_tagged(audit.inventory(spark, d, "rendered").where("startswith(rendered, '<instruction>')"), stage.path("records"))
    r = readers.tagged_records(spark, stage.path("records")).where("is_instruction")
    return r.groupBy(F.md5("text").alias("record_md5")).agg(F.count(F.lit(1)).alias("copies"))


def status_partitions(spark, d):
    """(source, status, documents): documents written to one folder per source and status, counted from the folders."""
    stage = Stage(spark, "status")
    sinks.write_by_status(table(spark, d, "documents", "doc_id", "source", "status").select("doc_id", label("source").alias("source"), "status"), stage.path("by"))
    return spark.read.parquet(stage.path("by")).groupBy("source", "status").agg(F.count(F.lit(1)).alias("documents"))


def csv_roundtrip(spark, d):
    """Length outliers as a CSV report with a fixed header, read back."""
    stage = Stage(spark, "csv")
    sinks.write_csv(audit.length_outliers(spark, d), stage.path("outliers"), ["id", "full_record_tokens", "answer_tokens", "reviewer"])
    return spark.read.schema("id string, full_record_tokens int, answer_tokens int, reviewer string").csv(stage.path("outliers"), header=True)


def decode_roundtrip(spark, d):
    """(doc_id, encoding, had_bom, text_md5): texts as bytes in three encodings by their id, decoded by their marks."""
    t = docs(spark, d, "text")
    payload = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "utf-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "utf-16le")))
    r = t.select("doc_id", readers.decoded(payload).alias("d"))
    return r.select("doc_id", "d.encoding", "d.had_bom", F.md5("d.text").alias("text_md5"))


_PARTS = f"list_filter(list_transform(string_split(rendered, '<instruction>')[2:], lambda x: {T.sql_strip(chr(39) + '<instruction>' + chr(39) + ' || x')}), lambda x: x <> '')"
SQL = {
    "json_lines_roundtrip": f"SELECT id, lower(trim(language)) AS language, md5(coalesce(instruction, '-')) AS instruction_md5, md5(coalesce(answer, '-')) AS answer_md5, bad_code IS NULL AS no_code, coalesce(len(constraints), -1) AS constraints FROM {audit._REC}",
    "tagged_roundtrip": f"SELECT md5(x) AS record_md5, count(*) AS copies FROM (SELECT unnest({_PARTS}) AS x FROM {audit._inv('rendered')} WHERE starts_with(rendered, '<instruction>')) GROUP BY 1",
    "status_partitions": "SELECT lower(trim(source)) AS source, status, count(*) AS documents FROM documents GROUP BY ALL",
    "csv_roundtrip": f"SELECT id, full_record_tokens, answer_tokens, NULL::VARCHAR AS reviewer FROM ({audit._OUTLIER})",
    "decode_roundtrip": f"SELECT doc_id, CASE WHEN text = '' AND doc_id % 3 = 0 THEN 'utf-8' ELSE CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-16' END END AS encoding, doc_id % 3 <> 0 AS had_bom, md5(text) AS text_md5 FROM {DOCS}",
}
QUERIES = {k: globals()[k] for k in SQL}
