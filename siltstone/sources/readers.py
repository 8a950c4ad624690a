"""Scans of the formats that corpora come in: JSON lines, tagged text, archives, page dumps, bytes in unknown encodings.

Every scan is distributed by file (Spark's readers) and yields rows; archives are opened where their bytes are. File
and archive formats that cannot be split (an archive, a compressed dump) are one task each.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import rules as R
from siltstone.functions import text as T

DECODED = "text string, encoding string, had_bom boolean, newline_style string, control_ratio double, error string"
MEMBERS = "path string, member string, size long, kind string, unsafe boolean"
FILES = "path string, member string, size long, sha256 string, content binary"
PAGES = "title string, ns string, id string, revision struct<id: string, timestamp: string, text: struct<_VALUE: string>>"
CONTROL_LIMIT = 0.001
#: Byte order marks in the order in which they are tried.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """One JSON object a line, by an explicit schema; blank lines are skipped, a broken line fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that is one JSON object."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def tagged_records(spark: SparkSession, path: str) -> DataFrame:
    """(source, index, text, is_instruction) of all .txt and .md files below a folder, cut before each <instruction>.

    Text before the first tag is a record that is no instruction; blank parts are dropped, and the index counts what stays.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").select(F.col("_metadata.file_path").alias("source"), "value")
    parts = F.filter(F.transform(F.split("value", r"(?=<instruction>)"), T.strip), lambda x: x != "")
    return files.select("source", F.posexplode(parts).alias("index", "text")).withColumn("is_instruction", F.col("text").startswith("<instruction>"))


def decode_bytes(payload: bytes | None, allow_cp1252: bool = True) -> tuple:
    """DECODED of one payload: byte order mark, else UTF-8, else CP1252 where allowed and without NUL bytes."""
    if not payload:
        return ("", "utf-8", False, "none", 0.0, None)
    encoding = next((name for mark, name in MARKS if payload.startswith(mark)), None)
    had_bom, tried = encoding is not None, encoding or "utf-8"
    try:
        text = payload.decode(tried)
    except UnicodeDecodeError:
        if not allow_cp1252 or b"\0" in payload:
            return (None, None, had_bom, None, None, "undecodable")
        try:
            text, tried = payload.decode("cp1252"), "cp1252"
        except UnicodeDecodeError:
            return (None, None, had_bom, None, None, "undecodable")
    share = sum(ord(c) < 32 and c not in "\n\r\t\f" for c in text) / max(1, len(text))
    if "\0" in text or share > CONTROL_LIMIT:
        return (None, tried, had_bom, None, share, "binary-looking")
    crlf = payload.count(b"\r\n")
    ends = {"crlf": crlf, "lf": payload.count(b"\n") - crlf, "cr": payload.count(b"\r") - crlf}
    found = [k for k, n in ends.items() if n]
    return (text, tried, had_bom, "none" if not found else found[0] if len(found) == 1 else "mixed", share, None)


def decoded(payload: str | Column, allow_cp1252: bool = True) -> Column:
    """DECODED of a binary column as a struct; undecodable payloads have a null text and an error."""

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(b) if b is not None else None, allow_cp1252) for b in batch], columns=[c.split()[0] for c in DECODED.split(", ")])

    from pyspark.sql.types import _parse_datatype_string

    return F.pandas_udf(run, _parse_datatype_string(DECODED))(F.col(payload) if isinstance(payload, str) else payload)


def _members(name: str, content: bytes) -> Iterator[tuple[str, int, str, bytes | None]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                link = (m.external_attr >> 16) & 0o170000 == 0o120000
                kind = "directory" if m.is_dir() else "special" if link else "regular"
                yield m.filename, m.file_size, kind, z.read(m) if kind == "regular" else None
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:  # in archive order: random access would read it again and again
                kind = "directory" if m.isdir() else "regular" if m.isreg() else "special"
                yield m.name, m.size, kind, t.extractfile(m).read() if kind == "regular" else None


def _safe(member: str) -> str | None:
    p = member.replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    return None if not p or p.startswith("/") or any(x in ("", ".", "..") for x in p.rstrip("/").split("/")) else p


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """MEMBERS of the .tar, .tar.gz, .tgz and .zip files at `path`, one task an archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, m, n, k, _safe(m) is None) for m, n, k, _ in _members(p, bytes(c))], columns=[x.split()[0] for x in MEMBERS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBERS)


def archive_files(spark: SparkSession, path: str, most_bytes: int = 4 << 20) -> DataFrame:
    """FILES: the regular, safely named members up to a size, with their bytes and hash."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = [(p, _safe(m), n, hashlib.sha256(data).hexdigest(), data) for m, n, k, data in _members(p, bytes(c)) if k == "regular" and _safe(m) and n <= most_bytes]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in FILES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FILES)


def archive_counts(members: DataFrame) -> DataFrame:
    """Members of each archive by kind, and those with unsafe names."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("directory", "regular", "special")]
    return members.groupBy("path").agg(F.count(F.lit(1)).alias("members"), *kinds, F.count_if("unsafe").alias("unsafe"), F.sum("size").alias("bytes"))


def common_root(members: DataFrame) -> DataFrame:
    """The first path part that all safe members of an archive share, or null."""
    root = F.split(R.safe_path("member"), "/")[0]
    return members.where(~F.col("unsafe")).groupBy("path").agg(F.when(F.min(root) == F.max(root), F.min(root)).alias("root"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, page_id, revision_id, revision_timestamp, text), all strings, of the pages of XML dumps."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGES).load(path)
    return pages.select("title", "ns", F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), F.col("revision.timestamp").alias("revision_timestamp"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def bounded_rows(spark: SparkSession, path: str, most_rows: int) -> DataFrame:
    """At most so many rows of a Parquet folder: the bounded stream of a remote data set."""
    return spark.read.parquet(path).limit(most_rows)


#: Folders of a code tree that hold no sources of its own.
SKIPPED_FOLDERS = (".git", ".hg", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".svn", ".turbo", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "out", "target", "vendor")


def code_files(spark: SparkSession, root: str, extensions: tuple[str, ...], most_bytes: int = 200_000, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, content, state): files below a folder; state says why one is left out, or `kept`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    p = F.col("path")
    parts = F.split(p, "/")
    name = F.lower(F.try_element_at(parts, F.lit(-1)))
    state = F.when(~R.suffix(p).isin(*extensions), "bad_extension")
    state = state.when(R.matches_any(p, [f"*{g}" for g in ignore]), "ignored") if ignore else state
    skip = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) | name.isin("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "cargo.lock") | (F.col("length") > most_bytes)
    nul = F.hex(F.substring("content", 1, 4096)).rlike("^(?:..)*?00")
    return files.select("path", "length", "content", state.when(skip, "skipped").when(nul, "binary").otherwise("kept").alias("state"))


def sha1_sums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha1) of a sums file: hash, blanks, name; other lines are dropped."""
    line = r"^([0-9a-fA-F]{40})\s+\*?(\S+)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 2).alias("file"), F.lower(F.regexp_extract("value", line, 1)).alias("sha1"))


def _leaves(value) -> Iterator[str]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                yield x.strip()
        elif isinstance(x, (list, dict)):
            stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x))


def string_leaves(column: str) -> Column:
    """All non-blank strings inside a JSON text of any nesting, in order; empty for null or broken JSON."""

    def run(batch: pd.Series) -> pd.Series:
        out = []
        for x in batch:
            try:
                out.append(list(_leaves(json.loads(x))) if x else [])
            except ValueError:
                out.append([])
        return pd.Series(out)

    from pyspark.sql.types import ArrayType, StringType

    return F.pandas_udf(run, ArrayType(StringType()))(F.col(column))


def protected_items(evaluation: DataFrame, instructions: DataFrame) -> DataFrame:
    """(protected_id, source_kind, text, normalized): held-out texts of 24 characters or more and instruction texts of
    60 or more, in normal form, one per kind and normal form (the least id). Inputs: (protected_id, text)."""
    both = evaluation.select("protected_id", F.lit("evaluation").alias("source_kind"), "text", F.lit(24).alias("least")).unionByName(instructions.select("protected_id", F.lit("instruction").alias("source_kind"), "text", F.lit(60).alias("least")))
    named = both.withColumn("normalized", T.normalize_text("text")).where("char_length(normalized) >= least")
    return named.groupBy("source_kind", "normalized").agg(F.min_by(F.struct("protected_id", "text"), "protected_id").alias("f")).select("f.protected_id", "source_kind", "f.text", "normalized")
