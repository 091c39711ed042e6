"""JSON documents: manifests, progress states, task states and error logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.fixed_values import MANIFEST_SCHEMA_VERSION
from cladeledger.sources.lines import file_path, position
from cladeledger.workspace import materialize

# Field names of the JSON documents.
ARTIFACT_FIELDS = (
    "accession: STRING, include_type: STRING, filename: STRING, expected_md5: STRING, "
    "checksum_source: STRING, committed_at: STRING"
)
MANIFEST_SCHEMA = f"schema_version INT, generated_by STRING, artifacts MAP<STRING, STRUCT<{ARTIFACT_FIELDS}>>"
PROGRESS_SCHEMA = (
    "completed_taxa ARRAY<STRING>, failed_taxa ARRAY<STRING>, start_time DOUBLE, last_update DOUBLE, "
    "_corrupt STRING"
)
TASK_FIELDS = (
    "task_id: STRING, status: STRING, accession_id: STRING, md5_file_path: STRING, md5sum_dir: STRING, "
    "original_path: STRING, target_path: STRING, expected_hash: STRING, initial_status: STRING, "
    "cached_file: STRING, backup_path: STRING, attempts: BIGINT, last_error: STRING, "
    "computed_hash: STRING, created_at: STRING, updated_at: STRING"
)
TASK_STATE_SCHEMA = (
    "schema_version INT, mode STRING, run_id STRING, verification_dir STRING, created_at STRING, updated_at STRING, "
    f"input_fingerprint MAP<STRING, STRING>, summary MAP<STRING, BIGINT>, tasks MAP<STRING, STRUCT<{TASK_FIELDS}>>, _corrupt STRING"
)
ERROR_LOG_SCHEMA = (
    "timestamp DOUBLE, iso_timestamp STRING, taxon STRING, error_type STRING, message STRING, "
    "context MAP<STRING, STRING>, is_fatal BOOLEAN, should_retry BOOLEAN, "
    "exception STRUCT<type: STRING, message: STRING, module: STRING>, _corrupt STRING"
)


def _json(spark: SparkSession, path, schema: str, whole: bool, mode: str = "PERMISSIVE", **options) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", mode).option("multiLine", whole)
    return reader.option("columnNameOfCorruptRecord", "_corrupt").options(**options).json(path)


# An entry on a line of its own: its name and its fields.
_ENTRY_LINE = '^("[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"): (\\{.*\\}),?$'


def _split_documents(
    spark: SparkSession, path: str | list[str], schema: str, entries: str, fields: str, options: dict
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lines of documents with an entry per line; the documents without their entries; the paths of all others.

    Such a document opens its map of ``entries`` at the end of its first line and closes it at the start of its last;
    every line between is an entry that can be read by itself. So all tasks read it, each its share of the lines.
    """
    at = position()
    lines = spark.read.options(**options).text(path).select("value", file_path().alias("document"), at["block"].alias("block"), at["row"].alias("row"))
    read = F.from_json(F.regexp_extract("value", _ENTRY_LINE, 2), f"{fields}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    judged = lines.withColumn("bad", read["_corrupt"].isNotNull() | ~F.rlike("value", F.lit(_ENTRY_LINE))).withColumn("goes_on", F.endswith("value", F.lit(",")))
    fits, ends = ~F.col("bad"), ~F.col("bad") & ~F.col("goes_on")
    # Numbers alone, so that they are counted without sorting the lines; one row per document and split.
    parts = judged.groupBy("document", "block").agg(
        F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n"), F.count_if(fits).alias("n_fit"), F.count_if(ends).alias("n_ends"),
        F.max(F.when(fits, F.col("row"))).alias("last_fit"), F.max(F.when(ends, F.col("row"))).alias("last_end"),
    )
    place = {c: F.when(F.col(c).isNotNull(), F.struct("block", c)) for c in ("last_fit", "last_end")}
    found = parts.groupBy("document").agg(
        F.min(F.struct("block", F.col("first").alias("row"))).alias("first"), F.max(F.struct("block", F.col("last").alias("row"))).alias("last"), F.sum("n").alias("n"),
        F.sum("n_fit").alias("n_fit"), F.sum("n_ends").alias("n_ends"), F.max(place["last_fit"]).alias("last_fit"), F.max(place["last_end"]).alias("last_end"),
    )
    found = materialize(found, "documents")
    edges = found.select("document", F.explode(F.array(F.struct(F.lit(0).alias("end"), "first.*"), F.struct(F.lit(1).alias("end"), "last.*"))).alias("e")).select("document", "e.*")
    edges = lines.filter(~F.startswith("value", F.lit('"'))).join(edges, ["document", "block", "row"])
    edges = edges.groupBy("document").agg(F.min_by("value", "end").alias("head"), F.max_by("value", "end").alias("tail"))
    opened = F.col("head").rlike(f'^\\{{.*"{entries}": \\{{$') & F.startswith("tail", F.lit("}"))
    closed = (F.col("n_ends") == 1) & (F.col("last_fit.block") == F.col("last_end.block")) & (F.col("last_fit.last_fit") == F.col("last_end.last_end"))
    whole = (F.col("n_fit") == F.col("n") - 2) & (closed | (F.col("n_fit") == 0))
    frame = F.from_json(F.concat("head", "tail"), schema if "_corrupt" in schema else f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    known = found.join(edges, "document", "left").select("document", frame.alias("frame"), F.coalesce(opened & whole, F.lit(False)).alias("split"))
    # One row per document.
    known = materialize(known.withColumn("split", F.col("split") & F.col("frame._corrupt").isNull()), "documents")
    others = [re.sub(r"([][{}*?\\])", r"\\\1", r.document) for r in known.filter("NOT split").select("document").collect()]
    frames = known.filter("split").select("document", "frame.*").drop("_corrupt")
    return lines.select("value", "document").filter(F.startswith("value", F.lit('"'))), frames, others


def _entries_of(lines: DataFrame, frames: DataFrame, fields: str) -> DataFrame:
    """``document``, ``name`` and ``entry`` of each entry of the documents in ``frames``."""
    name = F.from_json(F.concat(F.lit('{"k": '), F.regexp_extract("value", _ENTRY_LINE, 1), F.lit("}")), "k STRING")["k"]
    rows = lines.join(frames.select("document"), "document")
    return rows.select("document", name.alias("name"), F.from_json(F.regexp_extract("value", _ENTRY_LINE, 2), fields).alias("entry"))


def read_manifest(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Artifact rows of manifest documents; other schema versions fail (SRC-8)."""
    problem = F.concat(
        F.lit("Unsupported accession manifest schema: "),
        F.coalesce(F.col("schema_version").cast("string"), F.lit("none")),
    )
    right = F.col("schema_version").eqNullSafe(F.lit(MANIFEST_SCHEMA_VERSION))
    kind = f"map<string, struct<{ARTIFACT_FIELDS}>>"
    fields = ARTIFACT_FIELDS.replace(": ", " ")
    lines, frames, others = _split_documents(spark, path, MANIFEST_SCHEMA, "artifacts", fields, options)
    frames = frames.filter(F.when(right, True).otherwise(F.raise_error(problem).cast("boolean")))
    rows = _entries_of(lines, frames, fields).withColumnRenamed("entry", "artifact")
    if others:
        documents = _json(spark, others, MANIFEST_SCHEMA, True, "FAILFAST", **options)
        checked = F.when(right, F.col("artifacts")).otherwise(F.raise_error(problem).cast(kind))
        rows = rows.unionByName(documents.select(file_path().alias("document"), F.explode(checked).alias("name", "artifact")))
    return rows.select("document", F.col("name").alias("filename"), *[
        f"artifact.{c}" for c in ("accession", "include_type", "expected_md5", "checksum_source", "committed_at")
    ])


def read_document_entries(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``name`` and the ``fields`` of each entry of a document with an entry per line, in as many tasks as its size asks for.

    The documents of ``sinks.documents`` written as one file have this form; entries begin at a quotation mark.
    """
    lines = spark.read.text(path).filter(F.startswith("value", F.lit('"')))
    text = F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}"))
    entry = F.from_json(text, f"map<string, struct<{fields}>>", {"mode": "FAILFAST"})
    return lines.select(F.explode(entry).alias("name", "entry")).select("name", "entry.*")


def read_manifest_rows(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Artifact rows of the stored form, one per line; other schema versions fail (SRC-8)."""
    fields = "schema_version INT, " + ARTIFACT_FIELDS.replace(": ", " ")
    rows = spark.read.schema(fields).option("mode", "FAILFAST").options(**options).json(path)
    problem = F.concat(F.lit("Unsupported accession manifest schema: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))
    right = F.col("schema_version").eqNullSafe(F.lit(MANIFEST_SCHEMA_VERSION))
    return rows.filter(F.when(right, True).otherwise(F.raise_error(problem).cast("boolean"))).select(
        "filename", "accession", "include_type", "expected_md5", "checksum_source", "committed_at"
    )


def read_progress_rows(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(item, state) rows of the stored form (SRC-9)."""
    return spark.read.schema("item STRING, state STRING").options(**options).json(path).distinct()


def read_task_rows(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Task rows of the stored form with all fields (SRC-10)."""
    return spark.read.schema(TASK_FIELDS.replace(": ", " ")).options(**options).json(path)


def read_task_heads(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Run id, directory, times, input fingerprint and summary of task documents (SNK-9)."""
    # No field of a task is wanted, so none needs to have the right type.
    _, frames, others = _split_documents(spark, path, TASK_STATE_SCHEMA, "tasks", "task_id STRING", options)
    heads = frames.drop("tasks")
    if not others:
        return heads.select(*heads.drop("document").columns, "document")
    documents = _json(spark, others, TASK_STATE_SCHEMA, True, **options).filter("_corrupt IS NULL")
    return documents.drop("tasks", "_corrupt").withColumn("document", file_path()).unionByName(heads)


def read_progress(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(item, state) rows; a document that cannot be read gives none (SRC-9)."""
    documents = _json(spark, path, PROGRESS_SCHEMA, True, **options).filter("_corrupt IS NULL")
    states = F.array(
        F.struct(F.lit("completed").alias("state"), F.col("completed_taxa").alias("items")),
        F.struct(F.lit("failed").alias("state"), F.col("failed_taxa").alias("items")),
    )
    return (
        documents.select(F.explode(states).alias("s"))
        .select(F.explode("s.items").alias("item"), F.col("s.state").alias("state"))
        .distinct()
    )


def read_task_state(spark: SparkSession, path: str | list[str], version: int = 1, **options) -> DataFrame:
    """Task rows; unreadable documents are ignored, other versions fail (SRC-10)."""
    kind = f"map<string, struct<{TASK_FIELDS}>>"
    right, problem = F.col("schema_version").eqNullSafe(F.lit(version)), F.raise_error(F.lit("Unsupported task state version"))
    fields = TASK_FIELDS.replace(": ", " ")
    lines, frames, others = _split_documents(spark, path, TASK_STATE_SCHEMA, "tasks", fields, options)
    frames = frames.filter(F.when(right, True).otherwise(problem.cast("boolean")))
    tasks = _entries_of(lines, frames, fields).select("entry.*")
    if not others:
        return tasks
    documents = _json(spark, others, TASK_STATE_SCHEMA, True, **options).filter("_corrupt IS NULL")
    checked = F.when(right, F.col("tasks")).otherwise(problem.cast(kind))
    return tasks.unionByName(documents.select(F.explode(checked).alias("id", "task")).select("task.*"))


def read_error_log(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Error records, one JSON object per line; bad lines are dropped (SRC-12)."""
    return _json(spark, path, ERROR_LOG_SCHEMA, False, **options).filter("_corrupt IS NULL").drop("_corrupt")
