"""JSON documents for manifests, progress, repair tasks and errors, and repair reports.

The stored form at any size is a table with one JSON entry per line (``write_manifest_rows`` and so on). For tools that
want one document, ``write_manifest_document`` and so on write one file of any size, which all tasks write at once, an
entry per line and in order, and which is replaced as a whole. ``write_manifest`` and ``write_task_state`` give several
such documents, which all tasks write at once too; in object stores, and of progress, each document passes through one
task. Nothing about the form depends on how many entries there are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import ERROR_CLASSES, MANIFEST_SCHEMA_VERSION
from cladeledger.operators.repair import outcomes, repair_result, summarize
from cladeledger.operators.reports import error_counts
from cladeledger.ordering import with_row_number
from cladeledger.sinks.lines import REPORT_ORDER, exploded, fixed_lines, write_lines
from cladeledger.sinks.single_file import is_mounted, write_text_file, write_text_files

_ARTIFACT = ("accession", "include_type", "filename", "expected_md5", "checksum_source", "committed_at")


def _numbered(df: DataFrame, key: str, documents: int) -> DataFrame:
    """Spread entries with unique keys over ``documents`` documents, an empty table too."""
    return df.withColumn("_document", F.pmod(F.xxhash64(key), F.lit(documents)))


def _write(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def _entry_map(key: str, entry: Column) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.to_json(entry).alias("value"))))
    # The entries are JSON already; joining them keeps the map as it is.
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.regexp_extract(F.to_json(F.struct(p["key"].alias("k"))), "^\\{\"k\":(.*)\\}$", 1), F.lit(": "), p["value"])),
        ",\n",
    )


def _write_entries(numbered: DataFrame, path: str, key: str, entry: Column, begin: str, end: str) -> None:
    """A document for each ``_document``: ``begin``, the entries by ``key``, a line each, and ``end``."""
    if not is_mounted(path):
        texts = numbered.groupBy("_document").agg(_entry_map(key, entry).alias("entries"))
        _write(texts.select(F.concat(F.lit(f"{begin}\n"), "entries", F.lit(f"\n{end}")).alias("value")), path)
        return
    key_text = F.concat(_key_of(key), F.lit(": "))
    file = F.format_string("part-%05d.json", "_document").alias("file")
    entries = numbered.select(
        file, F.lit(1).alias("section"), F.col(key).cast("string").alias("key"), F.lit(",\n").alias("separator"), F.concat(key_text, F.to_json(entry)).alias("text")
    )
    ends = F.array(F.struct(F.lit(0).alias("section"), F.lit(f"{begin}\n").alias("text")), F.struct(F.lit(2).alias("section"), F.lit(f"\n{end}\n").alias("text")))
    nothing = F.lit(None).cast("string")
    frame = numbered.select("_document").distinct().select(file, F.explode(ends).alias("e"))
    frame = frame.select("file", "e.section", nothing.alias("key"), nothing.alias("separator"), "e.text")
    write_text_files(entries.unionByName(frame), path, ["key"])


def _stamped(manifest: DataFrame, committed_at: str) -> DataFrame:
    return manifest.withColumn("committed_at", F.lit(committed_at)) if "committed_at" not in manifest.columns else (
        manifest.withColumn("committed_at", F.coalesce(F.nullif("committed_at", F.lit("")), F.lit(committed_at)))
    )


def write_manifest_rows(manifest: DataFrame, path: str, committed_at: str) -> None:
    """The manifest with one artifact per line; ``committed_at`` fills empty times (SNK-7)."""
    version = F.lit(MANIFEST_SCHEMA_VERSION).alias("schema_version")
    _stamped(manifest, committed_at).select(version, *_ARTIFACT).write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str, committed_at: str, documents: int) -> None:
    """The manifest as ``documents`` documents with sorted filenames (SNK-7)."""
    numbered = _numbered(_stamped(manifest, committed_at), "filename", documents)
    entry = F.struct(*[F.col(c) for c in _ARTIFACT])
    end = f'}}, "generated_by": "cladeledger", "schema_version": {MANIFEST_SCHEMA_VERSION}}}'
    _write_entries(numbered, path, "filename", entry, '{"artifacts": {', end)


def _key_of(column: str) -> Column:
    """The column as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("k"))), "^\\{\"k\":(.*)\\}$", 1)


def _entries(rows: DataFrame, section: int, key: str, text: Column) -> DataFrame:
    """One line per row, by key, each but the first after a comma; keys are distinct."""
    least = rows.agg(F.min(key)).first()[0]
    begin = F.when(F.col(key) == F.lit(least), "\n").otherwise(",\n")
    return rows.select(F.lit(section).alias("section"), F.col(key).alias("item"), F.concat(begin, text).alias("text"))


def _fixed(spark, section: int, text: str) -> DataFrame:
    return spark.createDataFrame([(section, "", text)], "section INT, item STRING, text STRING")


def write_manifest_document(manifest: DataFrame, path: str, committed_at: str) -> DataFrame:
    """The manifest as one document with sorted filenames (SNK-7); returns the index of the file's ranges."""
    spark = manifest.sparkSession
    entry = F.to_json(F.struct(*[F.col(c) for c in _ARTIFACT]))
    rows = _entries(_stamped(manifest, committed_at), 1, "filename", F.concat(_key_of("filename"), F.lit(": "), entry))
    end = f'\n}}, "generated_by": "cladeledger", "schema_version": {MANIFEST_SCHEMA_VERSION}}}\n'
    parts = rows.unionByName(_fixed(spark, 0, '{"artifacts": {')).unionByName(_fixed(spark, 2, end))
    return write_text_file(parts, path, ["section", "item"])


def write_progress_document(states: DataFrame, path: str, start: float, now: float) -> DataFrame:
    """Completed and failed items as one document, each sorted (SNK-8); returns the index of the file's ranges."""
    spark = states.sparkSession
    ends = ['{"completed_taxa": [', '\n], "failed_taxa": [', f'\n], "start_time": {json.dumps(start)}, "last_update": {json.dumps(now)}}}\n']
    parts = _fixed(spark, 0, ends[0]).unionByName(_fixed(spark, 2, ends[1])).unionByName(_fixed(spark, 4, ends[2]))
    for section, state in ((1, "completed"), (3, "failed")):
        parts = parts.unionByName(_entries(states.filter(F.col("state") == state).select("item").distinct(), section, "item", _key_of("item")))
    return write_text_file(parts, path, ["section", "item"])


def write_task_document(
    tasks: DataFrame, path: str, run_id: str, root: str, created_at: str, updated_at: str, fingerprint: dict[str, str] | None = None
) -> DataFrame:
    """Tasks as one document with head and summary, by task id (SNK-9, AG-8); returns the index of the file's ranges."""
    spark = tasks.sparkSession
    summary = summarize(tasks).select(F.to_json(F.struct("*"))).first()[0]
    head = json.dumps(_task_head(run_id, root, created_at, updated_at, fingerprint)).removesuffix("}")
    entry = F.to_json(F.struct(*[F.col(c) for c in tasks.columns]))
    rows = _entries(tasks, 1, "task_id", F.concat(_key_of("task_id"), F.lit(": "), entry))
    parts = rows.unionByName(_fixed(spark, 0, f'{head}, "summary": {summary}, "tasks": {{')).unionByName(_fixed(spark, 2, "\n}}\n"))
    return write_text_file(parts, path, ["section", "item"])


def _task_head(run_id: str, root: str, created_at: str, updated_at: str, fingerprint: dict[str, str] | None) -> dict:
    # The names of the head's fields.
    return {"schema_version": 1, "mode": "md5_autofix", "run_id": run_id, "verification_dir": root, "created_at": created_at,
            "updated_at": updated_at, "input_fingerprint": fingerprint or {}}


def write_progress_rows(states: DataFrame, path: str) -> None:
    """Items of a run with their state, one per line (SNK-8)."""
    states.select("item", "state").write.mode("overwrite").json(path)


def write_progress(states: DataFrame, path: str, start: float, now: float, documents: int) -> None:
    """Completed and failed items of a run as ``documents`` documents (SNK-8)."""
    numbered = _numbered(states, "item", documents)
    texts = numbered.groupBy("_document").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("item")))).alias(f"{s}_taxa")
            for s in ("completed", "failed")
        ]
    )
    document = F.struct(
        "completed_taxa", "failed_taxa", F.lit(start).alias("start_time"), F.lit(now).alias("last_update")
    )
    _write(texts.select(F.to_json(document).alias("value")), path)


def write_task_rows(tasks: DataFrame, path: str) -> None:
    """All fields of the tasks, one task per line, null ones left out (SNK-9)."""
    tasks.write.mode("overwrite").json(path)


def write_task_state(
    tasks: DataFrame, path: str, run_id: str, root: str, created_at: str, updated_at: str, documents: int,
    fingerprint: dict[str, str] | None = None,
) -> None:
    """Tasks as ``documents`` documents; each carries the head and the summary of the whole run (SNK-9, AG-8)."""
    # One row of totals; it is repeated in each document.
    summary = summarize(tasks).select(F.to_json(F.struct("*"))).first()[0]
    numbered = _numbered(tasks, "task_id", documents)
    entry = F.struct(*[F.col(c) for c in tasks.columns])
    head = json.dumps(_task_head(run_id, root, created_at, updated_at, fingerprint)).removesuffix("}")
    _write_entries(numbered, path, "task_id", entry, f'{head}, "summary": {summary}, "tasks": {{', "}}")


def write_errors(errors: DataFrame, path: str, exported_at: str) -> None:
    """Error records as JSON lines; beside them one record with total, time and the count of every class (SNK-14)."""
    errors.write.mode("overwrite").json(f"{path}/errors")
    export_record(errors, exported_at).write.mode("overwrite").json(f"{path}/statistics")


def export_record(errors: DataFrame, exported_at: str) -> DataFrame:
    """``total_errors``, ``export_time`` and ``statistics``, a map of all classes to their count, also zero."""
    classes = errors.sparkSession.createDataFrame([(c,) for c in ERROR_CLASSES], "error_type STRING")
    counts = error_counts(errors).join(classes, "error_type", "full_outer").select("error_type", F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("error_type", "n")))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_errors"), F.lit(exported_at).alias("export_time"), F.map_from_entries(pairs).alias("statistics")
    )


# Sections of the repair report, their introduction and the text of an empty one.
SECTIONS = [
    ("failed", "INITIALLY FAILED FILES", None, "No files failed verification."),
    ("fixed", "SUCCESSFULLY FIXED FILES", None, "No files were successfully fixed."),
    (
        "still_failed",
        "STILL FAILED FILES",
        "The following files still fail verification after redownload:",
        "All redownloaded files passed verification.",
    ),
    (
        "skipped",
        "SKIPPED FILES",
        "The following files were skipped (no valid Accession ID):",
        "No files were skipped.",
    ),
]


@dataclass(frozen=True)
class RepairRun:
    """What the reports say of a run besides its files."""

    run_id: str
    root: str
    started: datetime
    ended: datetime
    organized: int = 0
    state_path: str = ""

    def duration(self) -> str:
        """Hours, minutes and seconds; larger units only where needed."""
        seconds = int((self.ended - self.started).total_seconds())
        parts = [(seconds // 3600, "h"), (seconds // 60 % 60, "m"), (seconds % 60, "s")]
        first = next((i for i, (n, _) in enumerate(parts) if n), 2)
        return " ".join(f"{n}{unit}" for n, unit in parts[first:])


def repair_report_lines(failed: DataFrame, tasks: DataFrame, run: RepairRun) -> DataFrame:
    """Times, totals, and initial failures, fixed, still failing and skipped files, numbered per section (SNK-12, WN-6)."""
    initial = failed.select(
        F.lit("failed").alias("section"), F.col("original_path").alias("path"), F.col("original_path").alias("task_id"),
        F.concat("original_path", F.lit(" ["), F.upper("status"), F.lit("]")).alias("text"),
        F.concat(F.lit("   Accession ID: "), "accession_id").alias("accession"),
        F.concat(F.lit("   Error: "), F.nullif("error_message", F.lit(""))).alias("error"),
    )
    nothing = F.lit(None).cast("string")
    later = outcomes(tasks).select("section", "path", "task_id", F.col("path").alias("text"), nothing.alias("accession"), nothing.alias("error"))
    rows = with_row_number(initial.unionByName(later), ["section"], [F.col("path"), F.col("task_id")], "number")
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    spark = failed.sparkSession
    titles = spark.createDataFrame([(i, *s) for i, s in enumerate(SECTIONS)], "place INT, section STRING, title STRING, intro STRING, empty STRING")
    rule = F.lit("=" * 80)
    n = F.coalesce("n", F.lit(0))
    headed = titles.join(counts, "section", "left")
    heads = [rule, F.concat("title", F.lit(" ("), n.cast("string"), F.lit(" files)")), rule, F.lit(""), F.when(n == 0, F.col("empty")).otherwise(F.col("intro")), F.when((n > 0) & F.col("intro").isNotNull(), F.lit(""))]
    place = titles.select("section", "place")
    body = rows.join(place, "section")
    order = F.format_string("%d-%020d", F.col("place"), F.col("number"))
    head_order = F.format_string("%d-", F.col("place"))
    tail_order = F.format_string("%d-~", F.col("place"))
    # Labels of the head, the summary and the foot of the repair report.
    head = [
        "=" * 80, "MD5 VERIFICATION AUTO-FIX REPORT", "=" * 80, "", f"Report Generated: {run.ended:%Y-%m-%d %H:%M:%S}",
        f"Verification Directory: {run.root}", "", f"Process Start Time: {run.started:%Y-%m-%d %H:%M:%S}",
        f"Process End Time: {run.ended:%Y-%m-%d %H:%M:%S}", f"Total Processing Time: {run.duration()}", "",
    ]

    def total(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))

    totals = [
        rule, F.lit("SUMMARY"), rule, F.lit(""), total("Total Failed Files", "total_failed"), total("Files Redownloaded", "redownloaded"),
        F.lit(f"Files Organized: {run.organized}"), total("Files Successfully Fixed", "successfully_fixed"),
        total("Files Still Failed", "still_failed"), total("Files Skipped", "skipped"),
        F.concat(F.lit("Success Rate: "), F.format_string("%.1f", F.bround("success_rate", 1)), F.lit("%")), F.lit(""),
    ]
    return (
        fixed_lines(spark, 0, head)
        .unionByName(exploded(repair_result(tasks), 0, F.lit("~"), totals))
        .unionByName(fixed_lines(spark, 2, ["=" * 80, "END OF REPORT", "=" * 80]))
        .unionByName(exploded(headed, 1, head_order, heads))
        .unionByName(exploded(body, 1, order, [F.concat(F.col("number").cast("string"), F.lit(". "), "text"), F.col("accession"), F.col("error")]))
        .unionByName(exploded(titles, 1, tail_order, [F.lit("")]))
    )


def task_report_lines(tasks: DataFrame, run: RepairRun) -> DataFrame:
    """Summary and all tasks by path, with what is known of each (SNK-12, SO-4)."""
    spark = tasks.sparkSession
    names = ["fatal_failed", "fixed", "retryable_failed", "skipped", "still_failed", "total"]
    summary = [F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names]

    def known(label: str, column: str) -> Column:
        return F.concat(F.lit(f"  {label}: "), F.nullif(column, F.lit("")))

    block = [F.concat_ws(" | ", "status", "original_path"), known("accession", "accession_id"), known("cached_file", "cached_file"), known("backup_path", "backup_path"), known("error", "last_error")]
    # Header lines of the task report.
    head = ["=" * 80, "MD5 VERIFICATION AUTO-FIX RESUME REPORT", "=" * 80, "", f"Report Generated: {run.ended:%Y-%m-%d %H:%M:%S}", f"Run ID: {run.run_id}",
            f"Verification Directory: {run.root}", f"State File: {run.state_path}", "", "SUMMARY", "-" * 80]
    return (
        fixed_lines(spark, 0, head)
        .unionByName(exploded(summarize(tasks), 1, F.lit(""), summary))
        .unionByName(fixed_lines(spark, 2, ["", "TASKS", "-" * 80]))
        .unionByName(exploded(tasks, 3, F.concat("original_path", F.lit("\t"), "task_id"), block))
        .unionByName(fixed_lines(spark, 4, ["", "NEXT RUN", "-" * 80, "Plan the repair again with this state; finished tasks are not repeated.", ""]))
    )


def write_repair_reports(failed: DataFrame, tasks: DataFrame, path: str, run: RepairRun) -> None:
    write_lines(repair_report_lines(failed, tasks, run), f"{path}/files", REPORT_ORDER)
    write_lines(task_report_lines(tasks, run), f"{path}/tasks", REPORT_ORDER)
