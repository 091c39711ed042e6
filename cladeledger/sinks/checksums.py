"""Checksum lists, failure lists, accession lists and verification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import FAILING_STATES
from cladeledger.sinks.lines import REPORT_ORDER, exploded, fixed_lines, write_lines

# Header lines of a merged checksum list.
_LIST_HEADER = [
    "# MD5 checksums",
    "# Compatible with standard md5sum tools on Windows and Linux",
    "# Use 'md5sum -c md5sum.txt' to verify file integrity",
    "#",
]
_RULE = "=" * 60


def checksum_lines(manifest: DataFrame) -> DataFrame:
    """``hash  filename`` of each artifact (SNK-5, SO-3)."""
    return manifest.select("filename", F.concat_ws("  ", "expected_md5", "filename").alias("line"))


def write_checksum_list(manifest: DataFrame, path: str) -> None:
    write_lines(checksum_lines(manifest), path, ["filename"])


def merged_list_lines(merged: DataFrame) -> DataFrame:
    """Header and one line per output name with forward slashes (SNK-6)."""
    line = F.concat_ws("  ", "expected_hash", F.translate("out_name", "\\", "/"))
    return fixed_lines(merged.sparkSession, 0, _LIST_HEADER).unionByName(
        exploded(merged, 1, F.col("out_name"), [line])
    )


def write_merged_list(merged: DataFrame, path: str) -> None:
    write_lines(merged_list_lines(merged), path, REPORT_ORDER)


def failure_lines(verification: DataFrame, root: str, generated: str) -> DataFrame:
    """Failing files, ``N/A`` for unknown hashes, under a commented header (SNK-10)."""
    bad = verification.filter(F.col("status").isin(*FAILING_STATES))
    spark = verification.sparkSession
    total = bad.agg(F.concat(F.lit("# Total failed files: "), F.count("*").cast("string")).alias("line"))
    line = F.concat_ws(
        " | ",
        F.upper("status"),
        "file_path",
        F.coalesce("expected_hash", F.lit("N/A")),
        F.coalesce("computed_hash", F.lit("N/A")),
        F.coalesce("error_message", F.lit("")),
    )
    # Header lines of a failure list.
    head = ["# MD5 Verification Failed Files", f"# Generated: {generated}", f"# Verification Directory: {root}"]
    tail = [
        "#",
        "# Format: STATUS | FILE_PATH | EXPECTED_HASH | COMPUTED_HASH | ERROR_MESSAGE",
        "# FILE_PATH is relative to the verification directory",
        "#" + "=" * 80,
        "",
    ]
    return (
        fixed_lines(spark, 0, head)
        .unionByName(exploded(total, 1, F.lit(""), [F.col("line")]))
        .unionByName(fixed_lines(spark, 2, tail))
        .unionByName(exploded(bad, 3, F.col("file_path"), [line]))
    )


def write_failure_list(verification: DataFrame, path: str, root: str, generated: str) -> None:
    write_lines(failure_lines(verification, root, generated), path, REPORT_ORDER)


def report_lines(verification: DataFrame, totals: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Summary and one block per file whose content depends on its state (SNK-11)."""
    spark = verification.sparkSession

    def labelled(label: str, column: str):
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))

    rate = F.when(
        F.col("total_files") > 0,
        F.concat(F.lit("Success Rate: "), F.format_string("%.1f", F.bround("success_rate", 1)), F.lit("%")),
    ).otherwise("Success Rate: N/A (no files processed)")
    # Labels of the verification report.
    summary = [
        F.lit(_RULE), F.lit("MD5 VERIFICATION REPORT"), F.lit(_RULE),
        labelled("Total Files", "total_files"), labelled("Passed", "passed"), labelled("Failed", "failed"),
        labelled("Missing", "missing"), labelled("Errors", "errors"),
        F.lit(f"Processing Time: {seconds:.2f} seconds"), rate, F.lit(_RULE),
    ]
    status = F.col("status")
    symbol = (
        F.when(status == "pass", "✓").when(status == "fail", "✗").when(status == "missing", "?").otherwise("!")
    )
    block = [
        F.concat(symbol, F.lit(" ["), F.upper(status), F.lit("] "), "file_path"),
        F.when(status == "pass", F.concat(F.lit("  Hash: "), "expected_hash")),
        F.when(status == "fail", F.concat(F.lit("  Expected: "), "expected_hash")),
        F.when(status == "fail", F.concat(F.lit("  Computed: "), "computed_hash")),
        F.when(status.isin("missing", "error"), F.concat(F.lit("  Expected hash: "), "expected_hash")),
        F.when(status == "missing", F.lit("  File not found")),
        F.when((status == "error") & (F.col("error_message") != ""), F.concat(F.lit("  Error: "), "error_message")),
    ]
    final = F.when(F.col("success"), "✓ All files verified successfully!").otherwise(
        "✗ Verification completed with issues. See details above."
    )
    detail_head = F.when(F.col("total_files") > 0, F.lit("DETAILED RESULTS:"))
    return (
        exploded(totals, 0, F.lit(""), [*summary, detail_head])
        .unionByName(exploded(verification, 1, F.col("file_path"), block))
        .unionByName(exploded(totals, 2, F.lit(""), [F.lit(_RULE), final, F.lit(_RULE)]))
    )


def write_report(verification: DataFrame, totals: DataFrame, path: str, seconds: float = 0.0) -> None:
    write_lines(report_lines(verification, totals, seconds), path, REPORT_ORDER)


def write_accessions(accessions: DataFrame, path: str) -> bool:
    """Sorted distinct accessions, one per line; nothing is written for none (SNK-13)."""
    lines = accessions.filter("accession_id IS NOT NULL").select(F.col("accession_id").alias("line")).distinct()
    if lines.isEmpty():
        return False
    write_lines(lines, path, ["line"])
    return True
