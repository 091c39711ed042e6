"""The summary report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import TOP_FAILURES
from cladeledger.operators.reports import error_counts, run_totals, top_failures
from cladeledger.sinks.lines import REPORT_ORDER, exploded, fixed_lines, write_lines

_RULE = "=" * 60


def _labelled(label: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(unit))


def _rounded(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def run_summary_lines(results: DataFrame, seconds: float) -> DataFrame:
    """Totals, errors by class and the first failures of each class (AG-10, AG-11, WN-4).

    ``results``: taxon, success, files_found, error_type and error_message of failed taxa.
    """
    spark = results.sparkSession
    failed = results.filter("NOT success").withColumn("error_type", F.coalesce("error_type", F.lit("processing")))
    counts = error_counts(failed)
    top = top_failures(failed, [F.col("taxon")])
    rate = F.when(
        F.col("total_taxa") > 0, _labelled("Success Rate", _rounded(F.col("success_rate"), 1), "%")
    ).otherwise("Success Rate: N/A (no taxa processed)")
    # Labels of the run summary.
    totals = [
        F.lit(_RULE), F.lit("SUMMARY REPORT"), F.lit(_RULE),
        _labelled("Total Taxa Processed", F.col("total_taxa")),
        _labelled("Successful Downloads", F.col("successful")),
        _labelled("Failed Downloads", F.col("failed")),
        rate,
        _labelled("Total Files Downloaded", F.col("total_files")),
        F.lit(f"Total Processing Time: {seconds:.2f} seconds"),
        _labelled("Average Time per Taxon", _rounded(F.col("mean_seconds"), 2), " seconds"),
        F.lit(""),
    ]
    title = F.initcap("error_type")
    flags = F.concat(
        F.when(F.col("is_fatal"), " (FATAL)").otherwise(""), F.when(F.col("should_retry"), " (RETRYABLE)").otherwise("")
    )
    share = F.concat(
        F.lit("  "), title, F.lit(": "), F.col("n_errors").cast("string"), F.lit(" ("),
        _rounded(F.col("percentage"), 1), F.lit("%)"), flags,
    )
    heading = F.concat(title, F.lit(" Errors ("), F.col("n_errors").cast("string"), F.lit(" taxa):"))
    failure = F.concat(F.lit("  - "), F.col("taxon").cast("string"), F.lit(": "), F.coalesce("error_message", F.lit("")))
    left = F.when(
        F.col("n_errors") > TOP_FAILURES,
        F.concat(F.lit("  ... and "), (F.col("n_errors") - TOP_FAILURES).cast("string"), F.lit(" more")),
    )
    place = F.concat("error_type", F.format_string("-%02d", F.col("place")))
    return (
        exploded(run_totals(results, seconds), 0, F.lit(""), totals)
        .unionByName(fixed_lines(spark, 1, ["ERROR STATISTICS:", "-" * 20]))
        .unionByName(exploded(failed.agg(F.count("*").alias("n")), 1, F.lit("~"), [_labelled("Total Errors", F.col("n"))]))
        .unionByName(exploded(counts, 2, F.col("error_type"), [share]))
        .unionByName(fixed_lines(spark, 3, ["", "FAILED TAXA:", "-" * 15]))
        .unionByName(exploded(counts, 4, F.col("error_type"), [F.lit(""), heading]))
        .unionByName(exploded(top, 4, place, [failure]))
        .unionByName(exploded(counts, 4, F.concat("error_type", F.lit("-~")), [left]))
    )


def write_run_summary(results: DataFrame, path: str, seconds: float) -> None:
    write_lines(run_summary_lines(results, seconds), path, REPORT_ORDER)
