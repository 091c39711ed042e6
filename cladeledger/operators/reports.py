"""Counts, top failures and totals of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.fixed_values import TOP_FAILURES
from cladeledger.functions.messages import is_fatal, is_retryable
from cladeledger.functions.names import is_valid_binomial, rejection_reason


def name_statistics(names: DataFrame, column: str = "name") -> DataFrame:
    """Total, valid, invalid and valid rate in percent with two digits (AG-7)."""
    valid = F.count_if(is_valid_binomial(F.col(column)))
    counts = names.agg(F.count("*").alias("total"), valid.alias("valid"))
    rate = F.bround(F.col("valid") / F.col("total") * 100, 2)
    return counts.withColumns(
        {
            "invalid": F.col("total") - F.col("valid"),
            "valid_rate": F.when(F.col("total") > 0, rate).otherwise(0.0),
        }
    )


def name_reasons(names: DataFrame, column: str = "name") -> DataFrame:
    return names.withColumn("reason", rejection_reason(F.col(column)))


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per class with share and flags (AG-10)."""
    counts = errors.groupBy("error_type").agg(F.count("*").alias("n_errors"))
    # At most one row per error class reaches this window.
    total = F.sum("n_errors").over(Window.partitionBy(F.lit("all")))
    return counts.select(
        "error_type",
        "n_errors",
        (F.col("n_errors") / total * 100).alias("percentage"),
        is_fatal(F.col("error_type")).alias("is_fatal"),
        is_retryable(F.col("error_type")).alias("should_retry"),
    )


def top_failures(
    failures: DataFrame, order: Sequence[Column], kind: str = "error_type", limit: int = TOP_FAILURES
) -> DataFrame:
    """The first failures of each kind and how many more there are (WN-4, SO-7).

    Spark cuts each kind to ``limit`` rows before the shuffle; the totals combine map-side.
    """
    window = Window.partitionBy(kind).orderBy(*order)
    first = failures.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= limit)
    totals = failures.groupBy(kind).agg(F.count("*").alias("n_total"))
    more = F.greatest(F.col("n_total") - limit, F.lit(0)).cast("bigint")
    return first.join(totals, kind).withColumns({"place": F.col("place").cast("bigint"), "n_more": more}).drop("n_total")


def run_totals(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """Successful and failed taxa, files of successful ones, success rate (AG-11).

    With the ``seconds`` of the run also the mean time per taxon and the taxa per minute.
    """
    counts = results.agg(
        F.count("*").alias("total_taxa"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("files_found"))), F.lit(0)).alias("total_files"),
    )
    total = F.col("total_taxa")
    rate = F.when(total > 0, F.col("successful") / total * 100)
    counts = counts.withColumn("success_rate", rate)
    if seconds is None:
        return counts
    return counts.withColumns(
        {
            "mean_seconds": F.when(total > 0, F.lit(seconds) / total),
            "taxa_per_minute": F.when(F.lit(seconds > 0), total / F.lit(seconds) * 60),
        }
    )


def batch_totals(batches: DataFrame) -> DataFrame:
    """Files, successful and failed batches, completed against expected accessions (AG-12)."""
    counts = batches.agg(
        F.coalesce(F.sum(F.when(F.col("success"), F.col("files_saved"))), F.lit(0)).alias("total_files"),
        F.count_if("success").alias("successful_batches"),
        F.count_if(~F.col("success")).alias("failed_batches"),
        F.sum("n_completed").alias("completed"),
        F.sum("n_expected").alias("expected"),
    )
    return counts.withColumn(
        "all_done", (F.col("failed_batches") == 0) & (F.col("completed") == F.col("expected"))
    )


def split_totals(packed: DataFrame) -> DataFrame:
    """Species, genomes and size per group, for exceeded taxa and overall (AG-4, AG-5).

    ``packed`` has bin (null for exceeded), n_genomes and size_bp. Rows: level ``group`` with its
    number, ``grouped``, ``exceeded`` and ``overall``.
    """
    kind = F.when(F.col("bin").isNull(), "exceeded").otherwise("grouped")
    sums = (
        packed.withColumn("kind", kind)
        .groupingSets([["kind", "bin"], ["kind"], []], "kind", "bin")
        .agg(
            F.grouping_id().alias("gid"),
            F.count("*").alias("n_species"),
            F.sum("n_genomes").alias("n_genomes"),
            F.sum("size_bp").alias("size_bp"),
        )
        .filter("NOT (gid = 0 AND kind = 'exceeded')")
    )
    level = F.when(F.col("gid") == 0, "group").when(F.col("gid") == 1, F.col("kind")).otherwise("overall")
    return sums.select(
        level.alias("level"), F.col("bin").alias("group_id"), "n_species", "n_genomes", "size_bp"
    )
