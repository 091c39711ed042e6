"""Verification of a directory tree, repair planning, resume planning and manifest rebuilding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.fixed_values import CHECKSUM_LIST_NAME, DEFAULT_BATCH_SIZE, LIST_BACKUP_NAME
from cladeledger.functions.checksums import display_path, file_state_message
from cladeledger.functions.names import is_valid_binomial
from cladeledger.operators import integrity, layout, manifest, repair, reports, resume
from cladeledger.operators.dedup import last_wins
from cladeledger.sinks.lines import write_lines
from cladeledger.sources.inventory import checksum_lists, existing_files, list_entries, requested_files
from cladeledger.sources.lines import checksum_entries, read_checksums, read_lines, read_many_lists
from cladeledger.workspace import materialize


@dataclass(frozen=True)
class Verification:
    files: DataFrame
    totals: DataFrame


def verify_tree(spark: SparkSession, root: str, inventory: DataFrame | None = None) -> Verification:
    """Hash every file named in the checksum lists below ``root`` and compare (PL-2).

    ``inventory`` has the columns of ``list_entries``, for a store whose listing is at hand; else the tree is listed.
    """
    entries = list_entries(spark, root) if inventory is None else inventory
    chosen = checksum_lists(entries.filter("NOT is_directory"))
    return verify_entries(checksum_entries(read_many_lists(chosen)), entries, root.rstrip("/"))


def verify_entries(entries: DataFrame, inventory: DataFrame, root: str) -> Verification:
    """The same for parsed entries and an inventory of ``root``; entries may also point outside it.

    A directory, and whatever an unreadable directory may hold, is an error and not missing.
    """
    outside = entries.filter(~F.startswith("abs_path", F.lit(root.rstrip("/") + "/")))
    elsewhere = existing_files(outside.select(F.col("abs_path").alias("path")).distinct())
    problem = F.when(F.col("is_directory"), F.coalesce("error", F.concat(F.lit("I/O error: Is a directory: "), "path")))
    inside = inventory.select("path", "size", problem.alias("problem"))
    files = inside.unionByName(elsewhere.withColumn("problem", F.lit(None).cast("string")))
    matched = integrity.match_inventory(entries, files.dropDuplicates(["path"]))
    unreadable = inventory.filter("error IS NOT NULL").select("path", "error")
    matched = materialize(integrity.below_unreadable(matched, unreadable), "matched")
    checked = integrity.verify(matched, integrity.hash_existing(matched))
    result = materialize(
        checked.select(
            display_path(F.lit(root), F.col("abs_path"), F.col("file_path")).alias("file_path"),
            "abs_path",
            "expected_hash",
            "computed_hash",
            "status",
            file_state_message(F.col("status"), F.col("abs_path"), F.col("read_error")).alias("error_message"),
        ),
        "verification",
    )
    return Verification(result, integrity.count_states(result))


@dataclass(frozen=True)
class RepairPlan:
    failed: DataFrame
    tasks: DataFrame
    to_fetch: DataFrame
    summary: DataFrame


def plan_repair(
    verification: DataFrame, root: str, saved: DataFrame | None, cached: DataFrame, retry_failed: bool = False,
    now: str | None = None,
) -> RepairPlan:
    """Failing files to keyed tasks, merged with saved ones, recovered and matched to a cache (PL-3).

    ``verification`` also gives the current hash of each file, by which fixed tasks are checked.
    """
    failed = materialize(repair.failed_files(integrity.failing(verification)), "failed")
    fresh = repair.new_tasks(failed, root, now)
    tasks = fresh if saved is None else repair.merge_tasks(saved, fresh)
    current = verification.select(F.col("file_path").alias("path"), "computed_hash").dropDuplicates(["path"])
    tasks = repair.recover(tasks, current)
    if retry_failed:
        tasks = repair.requeue_failed(tasks)
    tasks = materialize(repair.match_cache(tasks, cached), "tasks")
    return RepairPlan(failed, tasks, repair.accessions_to_fetch(tasks), repair.summarize(tasks))


def plan_resume(
    requested: DataFrame,
    completed: DataFrame,
    files: DataFrame,
    trusted: DataFrame,
    include: Sequence[str],
    validate: bool = True,
    batch_size: int = DEFAULT_BATCH_SIZE,
) -> DataFrame:
    """Remaining accessions in list order with position and batch (PL-4). ``requested`` has ``line``."""
    left = resume.resume_accessions(requested, completed, files, trusted, include, validate)
    return resume.in_batches(left, [F.col("line")], batch_size)


def rebuild_manifest(
    entries: DataFrame, requested: DataFrame, outputs: DataFrame, current: DataFrame, include: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Merge actions for the rows of package checksum lists, and counts per reason (PL-5)."""
    candidates = materialize(manifest.rebuild_candidates(entries, requested, outputs, include), "candidates")
    committed = candidates.filter("reason = 'commit'").select("filename", F.col("expected_hash").alias("expected_md5"))
    return manifest.classify_merge(current, committed), manifest.rebuild_counts(candidates)


def import_checksum_list(spark: SparkSession, folder: str, current: DataFrame, outputs: DataFrame) -> DataFrame:
    """Manifest rows from the old checksum list of ``folder`` (JN-16), which is kept first as a backup beside it (SNK-7).

    The backup is written once, in the order of the list, and never replaced; none is made when nothing is imported.
    """
    path = f"{folder.rstrip('/')}/{CHECKSUM_LIST_NAME}"
    entries = last_wins(read_checksums(spark, path, "flat"), ["file_path"], F.col("line")).select("expected_hash", "file_path")
    rows = materialize(manifest.legacy_import(current, entries, outputs), "imported")
    if not rows.isEmpty():
        old = read_lines(spark, path).select(F.col("value").alias("line"), F.col("line").alias("place"))
        write_lines(old, f"{folder.rstrip('/')}/{LIST_BACKUP_NAME}", ["place"], mode="ignore")
    return rows


def plan_layout(
    files: DataFrame, entries: DataFrame, include: Sequence[str], keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rename plan, merged checksum rows and collisions of a package tree (PL-6)."""
    plan = materialize(layout.rename_plan(requested_files(files, include), keys), "plan")
    resolved = layout.resolve_names(entries, layout.checksum_mapping(plan, keys), keys)
    return plan, layout.merged_checksums(resolved, keys), layout.collisions(plan, keys)


def validate_names(names: DataFrame, column: str = "name") -> tuple[DataFrame, DataFrame]:
    """Each name with validity and reason, and the totals (PL-7)."""
    rows = reports.name_reasons(names, column).withColumn("valid", is_valid_binomial(F.col(column)))
    return rows, reports.name_statistics(names, column)


def error_report(errors: DataFrame, order: Sequence) -> tuple[DataFrame, DataFrame]:
    """Counts per class and the first failures of each (PL-8)."""
    return reports.error_counts(errors), reports.top_failures(errors, order)
