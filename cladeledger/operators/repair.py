"""Repair tasks: creation, merge with saved state, recovery, cache matches and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import RETRY_TEXT, SKIPPED_TEXT, STALE_FIX_TEXT
from cladeledger.functions.accessions import strict_accession, strict_accession_of
from cladeledger.functions.checksums import task_id
from cladeledger.functions.filetypes import output_extension
from cladeledger.functions.text import basename, dirname
from cladeledger.operators.dedup import first_wins


def failed_files(failing: DataFrame) -> DataFrame:
    """Directory, name and accession of failing files (FN-22, FN-4)."""
    path = F.col("file_path")
    return failing.select(
        path.alias("original_path"),
        dirname(path).alias("md5sum_dir"),
        basename(path).alias("md5_file_path"),
        "status",
        "expected_hash",
        strict_accession_of(path, basename(path)).alias("accession_id"),
        *(["error_message"] if "error_message" in failing.columns else [F.lit(None).cast("string").alias("error_message")]),
    )


def accession_totals(failed: DataFrame) -> DataFrame:
    """Distinct accessions and files without one (AG-19)."""
    return failed.agg(
        F.count("*").alias("n_files"),
        F.count_distinct("accession_id").alias("n_accessions"),
        F.count_if(F.col("accession_id").isNull()).alias("n_skipped"),
    )


def new_tasks(failed: DataFrame, root: str, now: str | None = None) -> DataFrame:
    """Pending tasks keyed by a stable id; the first row of an id wins (FN-21). ``now`` is their first time stamp."""
    tasks = failed.select(
        task_id(F.lit(root), F.col("md5sum_dir"), F.col("md5_file_path"), F.col("expected_hash")).alias("task_id"),
        F.lit("PENDING").alias("status"),
        "accession_id",
        "md5_file_path",
        "md5sum_dir",
        "original_path",
        F.col("original_path").alias("target_path"),
        F.coalesce("expected_hash", F.lit("")).alias("expected_hash"),
        F.col("status").alias("initial_status"),
        F.lit(None).cast("string").alias("cached_file"),
        F.lit(None).cast("string").alias("backup_path"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.col("error_message").alias("last_error"),
        F.lit(None).cast("string").alias("computed_hash"),
        F.lit(now).cast("string").alias("created_at"),
        F.lit(now).cast("string").alias("updated_at"),
    )
    return first_wins(tasks, ["task_id"], F.col("original_path"))


def merge_tasks(saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Saved tasks plus unseen ones; a saved task only gains a missing accession, and then a new ``updated_at`` (JN-17).

    All columns of either side are kept; one that a side lacks is null there.
    """
    columns = list(dict.fromkeys([*saved.columns, *fresh.columns]))

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns if c != "task_id"]
        return df.select("task_id", F.struct(*fields).alias(name))

    kept = F.col("old").isNotNull()
    gained = F.nullif(F.col("old.accession_id"), F.lit("")).isNull() & (F.nullif(F.col("new.accession_id"), F.lit("")).isNotNull())

    def value(name: str) -> Column:
        if name == "accession_id":
            return F.when(kept & ~gained, F.col("old.accession_id")).otherwise(F.col("new.accession_id"))
        if name == "updated_at":
            return F.when(kept & gained, F.coalesce("new.updated_at", "old.updated_at")).when(kept, F.col("old.updated_at")).otherwise(F.col("new.updated_at"))
        return F.when(kept, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))

    joined = side(saved, "old").join(side(fresh, "new"), "task_id", "full_outer")
    return joined.select(*[F.col(c) if c == "task_id" else value(c).alias(c) for c in columns])


def recovered_status(status: Column, accession: Column, fix_holds: Column) -> Column:
    """The state an interrupted task restarts from (ST-2, batch form)."""
    return (
        F.when(
            accession.isNull() | (accession == ""),
            F.when(status.isin("FIXED", "SKIPPED_NO_ACCESSION"), status).otherwise("SKIPPED_NO_ACCESSION"),
        )
        .when((status == "FIXED") & ~F.coalesce(fix_holds, F.lit(False)), "DOWNLOAD_QUEUED")
        .when(status.isin("PENDING", "DOWNLOADING", "FAILED_RETRYABLE"), "DOWNLOAD_QUEUED")
        .when(status == "ORGANIZING", "DOWNLOADED")
        .when(status == "VERIFYING", "ORGANIZED")
        .otherwise(status)
    )


def recover(tasks: DataFrame, hashes: DataFrame) -> DataFrame:
    """Tasks after an interruption; fixed ones keep that state only if the file still matches.

    ``hashes`` has path (as in target_path) and computed_hash.
    """
    current = hashes.select(F.col("path").alias("target"), F.col("computed_hash").alias("current_hash"))
    target = F.coalesce("target_path", "original_path")
    joined = tasks.withColumn("target", target).join(current, "target", "left")
    holds = F.col("current_hash") == F.col("expected_hash")
    status = recovered_status(F.col("status"), F.col("accession_id"), holds)
    no_accession = F.col("accession_id").isNull() | (F.col("accession_id") == "")
    changed = status != F.col("status")
    error = (
        F.when(no_accession & changed, SKIPPED_TEXT)
        .when(~no_accession & (F.col("status") == "FIXED") & changed, STALE_FIX_TEXT)
        .otherwise(F.col("last_error"))
    )
    return joined.withColumns({"last_error": error, "status": status}).select(*tasks.columns)


def requeued(status: Column) -> Column:
    """The state after a retry: retryable and still failing tasks go back to the queue, fatal ones do not."""
    return F.when(status.isin("STILL_FAILED", "FAILED_RETRYABLE"), "DOWNLOAD_QUEUED").otherwise(status)


def requeue_failed(tasks: DataFrame) -> DataFrame:
    """Tasks after a retry was asked for; those that it moves have one more attempt."""
    again = requeued(F.col("status")) != F.col("status")
    return tasks.withColumns(
        {
            "attempts": F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "last_error": F.when(again, RETRY_TEXT).otherwise(F.col("last_error")),
            "status": requeued(F.col("status")),
        }
    )


def match_cache(tasks: DataFrame, cached: DataFrame) -> DataFrame:
    """Tasks with the first cached file of the same accession and output extension (JN-12)."""
    by_key = (
        cached.select(
            strict_accession(F.col("name")).alias("accession_id"),
            output_extension(F.col("name")).alias("extension"),
            "path",
        )
        .groupBy("accession_id", "extension")
        .agg(F.min("path").alias("found_file"))
    )
    # Tasks without accession have nothing to find; a key of their own keeps them from meeting in one task.
    by_key = by_key.filter("accession_id IS NOT NULL").withColumnRenamed("accession_id", "_accession")
    keyed = tasks.withColumn("extension", output_extension(F.col("md5_file_path")))
    keyed = keyed.withColumn("_accession", F.coalesce("accession_id", F.concat(F.lit("\0"), "task_id")))
    joined = keyed.join(by_key, ["_accession", "extension"], "left")
    queued = F.col("status") == "DOWNLOAD_QUEUED"
    hit = queued & F.col("found_file").isNotNull()
    return joined.withColumns(
        {
            "cached_file": F.when(hit, F.col("found_file")).otherwise(F.col("cached_file")),
            "status": F.when(hit, "DOWNLOADED").when(queued, "DOWNLOADING").otherwise(F.col("status")),
        }
    ).select(*tasks.columns)


def accessions_to_fetch(tasks: DataFrame) -> DataFrame:
    """Sorted distinct accessions still to be downloaded (SO-5)."""
    return tasks.filter("status = 'DOWNLOADING'").select("accession_id").distinct().orderBy("accession_id")


def match_downloads(downloads: DataFrame, failed: DataFrame) -> DataFrame:
    """Downloaded files with the failed record each one replaces, null if there is none (JN-11)."""
    records = (
        failed.filter("accession_id IS NOT NULL")
        .withColumn("extension", output_extension(F.col("md5_file_path")))
        .select("accession_id", "extension", "original_path")
    )
    keyed = downloads.withColumn("extension", output_extension(F.col("name")))
    return keyed.join(records, ["accession_id", "extension"], "left").select(
        "accession_id", "path", "original_path"
    )


def summarize(tasks: DataFrame) -> DataFrame:
    """Task totals (AG-8)."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return tasks.agg(
        F.count("*").alias("total"),
        n("FIXED").alias("fixed"),
        n("STILL_FAILED").alias("still_failed"),
        n("SKIPPED_NO_ACCESSION").alias("skipped"),
        n("FAILED_RETRYABLE").alias("retryable_failed"),
        n("FAILED_FATAL").alias("fatal_failed"),
    )


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per status (AG-9)."""
    return tasks.groupBy("status").agg(F.count("*").alias("n_tasks"))


def outcomes(tasks: DataFrame) -> DataFrame:
    """One row per finished task: section (fixed, still_failed, skipped) and path (AG-17)."""
    section = (
        F.when(F.col("status") == "FIXED", "fixed")
        .when(F.col("status").isin("STILL_FAILED", "FAILED_RETRYABLE", "FAILED_FATAL"), "still_failed")
        .when(F.col("status") == "SKIPPED_NO_ACCESSION", "skipped")
    )
    path = F.when(section == "skipped", F.col("original_path")).otherwise(F.coalesce("target_path", "original_path"))
    return tasks.select(section.alias("section"), path.alias("path"), "task_id").filter("section IS NOT NULL")


def repair_result(tasks: DataFrame) -> DataFrame:
    """Totals of a repair run and its success rate, 0 when nothing was downloaded again (AG-17)."""
    status = F.col("status")
    counts = tasks.agg(
        F.count("*").alias("total_failed"),
        F.count_if(
            F.col("accession_id").isNotNull() & (F.col("accession_id") != "") & (status != "SKIPPED_NO_ACCESSION")
        ).alias("redownloaded"),
        F.count_if(status == "FIXED").alias("successfully_fixed"),
        F.count_if(status.isin("STILL_FAILED", "FAILED_RETRYABLE", "FAILED_FATAL")).alias("still_failed"),
        F.count_if(status == "SKIPPED_NO_ACCESSION").alias("skipped"),
    )
    rate = F.col("successfully_fixed") / F.col("redownloaded") * 100
    return counts.withColumn("success_rate", F.when(F.col("redownloaded") > 0, rate).otherwise(0.0))
