"""Checksum entries against an inventory, and the counts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import ERROR, FAIL, FAILING_STATES, MISSING, PASS
from cladeledger.functions.accessions import loose_accession
from cladeledger.functions.checksums import file_state, hash_files
from cladeledger.functions.text import basename, dirname
from cladeledger.ordering import with_row_number

BYTES_PER_TASK = 4 * 1024**3


def match_inventory(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with ``exists`` and ``size`` from the inventory, by absolute path (JN-8).

    ``files`` may hold ``problem`` for a path that is there but cannot be hashed, such as a directory.
    """
    problem = "problem" if "problem" in files.columns else F.lit(None).cast("string").alias("problem")
    known = files.select(F.col("path").alias("abs_path"), "size", problem).withColumn("exists", F.lit(True))
    return entries.join(known, "abs_path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def below_unreadable(matched: DataFrame, unreadable: DataFrame) -> DataFrame:
    """``matched`` with a ``problem`` on entries that an unreadable directory (path, error) may hold."""
    parts = F.split("abs_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    lost = matched.filter(~F.col("exists")).select("abs_path").distinct().withColumn("path", F.explode(above))
    reasons = lost.join(unreadable.select("path", F.col("error").alias("_reason")), "path").groupBy("abs_path").agg(F.min("_reason").alias("_reason"))
    joined = matched.join(reasons, "abs_path", "left")
    hidden = F.col("_reason").isNotNull()
    return joined.withColumns({"problem": F.coalesce("problem", "_reason"), "exists": F.col("exists") | hidden}).drop("_reason")


def hash_existing(matched: DataFrame) -> DataFrame:
    """One row per existing file with ``computed_hash`` and ``error``; each file is read once.

    Tasks read about ``BYTES_PER_TASK`` each, and the large files are spread evenly over them.
    """
    files = matched.filter("exists AND problem IS NULL").select(F.col("abs_path").alias("path"), "size").distinct()
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = int(max(files.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK))
    # Sorted by size and dealt out in turn, each task gets as many of the large ones as the others.
    placed = with_row_number(files, [], [F.desc("size"), F.col("path")], "place")
    dealt = placed.repartitionByRange(tasks, F.pmod(F.col("place"), F.lit(tasks)))
    return hash_files(dealt.select("path"))


def verify(matched: DataFrame, hashes: DataFrame) -> DataFrame:
    """Matched entries with the state of each file (FN-25)."""
    computed = hashes.select(F.col("path").alias("abs_path"), "computed_hash", F.col("error").alias("read_error"))
    joined = matched.join(computed, "abs_path", "left")
    if "problem" in matched.columns:
        joined = joined.withColumn("read_error", F.coalesce("problem", "read_error")).drop("problem")
    return joined.withColumn(
        "status",
        file_state(F.col("expected_hash"), F.col("computed_hash"), F.col("exists"), F.col("read_error")),
    )


def count_states(verification: DataFrame) -> DataFrame:
    """Totals by state, success flag, exit code, count check and success rate (AG-6)."""
    def n(state: str) -> Column:
        return F.count_if(F.col("status") == state)

    counts = verification.agg(
        F.count("*").alias("total_files"),
        n(PASS).alias("passed"),
        n(FAIL).alias("failed"),
        n(MISSING).alias("missing"),
        n(ERROR).alias("errors"),
    )
    bad = F.col("failed") + F.col("missing") + F.col("errors")
    return counts.withColumns(
        {
            "success": bad == 0,
            "exit_code": F.when(bad == 0, 0).otherwise(1).cast("bigint"),
            "counts_valid": F.col("total_files") == F.col("passed") + bad,
            "success_rate": F.when(F.col("total_files") > 0, F.col("passed") / F.col("total_files") * 100),
        }
    )


def failing(verification: DataFrame) -> DataFrame:
    """Failed, missing and unreadable files (SE-7)."""
    return verification.filter(F.col("status").isin(*FAILING_STATES))


def hash_by_accession(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Checksums for (accession, name) pairs by equality instead of text containment (JN-10).

    The first entry by path wins, so ``X.1`` never takes the hash of ``X.10``.
    """
    keyed = (
        entries.select(
            loose_accession(F.col("file_path")).alias("accession"),
            basename(F.col("file_path")).alias("name"),
            "file_path",
            "expected_hash",
        )
        .groupBy("accession", "name")
        .agg(F.min_by("expected_hash", "file_path").alias("expected_hash"))
    )
    return files.join(keyed, ["accession", "name"], "left")


def expected_hash_of(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Expected hash of relative paths (JN-13).

    An entry of the same path wins, then one of the same folder and name written differently, then a
    root entry of the same name. ``entries`` has one row per file_path.
    """
    def clean(path: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(path, "/+(\\./+)*", "/"), "^\\./+", "")

    forward = F.translate("path", "\\", "/")
    exact = entries.select(F.col("file_path").alias("k_exact"), F.col("expected_hash").alias("h_exact"))
    same = (
        entries.groupBy(clean(F.col("file_path")).alias("k_same"))
        .agg(F.min_by("expected_hash", "file_path").alias("h_same"))
    )
    root = (
        entries.filter(dirname(clean(F.col("file_path"))) == ".")
        .groupBy(basename(F.col("file_path")).alias("k_root"))
        .agg(F.min_by("expected_hash", "file_path").alias("h_root"))
    )
    def open_key(found: str, key: Column) -> Column:
        # A resolved path gets a key of its own, so that a common file name does not gather them.
        return F.when(F.col(found).isNull(), key).otherwise(F.concat(F.lit("/\0"), forward))

    return (
        paths.withColumn("k_exact", forward)
        .join(exact, "k_exact", "left")
        .withColumn("k_same", open_key("h_exact", clean(forward)))
        .join(same, "k_same", "left")
        .withColumn("h_found", F.coalesce("h_exact", "h_same"))
        .withColumn("k_root", open_key("h_found", basename(forward)))
        .join(root, "k_root", "left")
        .withColumn("expected_hash", F.coalesce("h_found", "h_root"))
        .select(*paths.columns, "expected_hash")
    )


def reverify(placed: DataFrame, entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Placed paths with ``passed``; a missing file or hash does not pass (JN-18)."""
    known = hashes.select(F.col("path").alias("rel"), "computed_hash")
    expected = expected_hash_of(placed, entries)
    joined = expected.join(known, expected["path"] == known["rel"], "left").drop("rel")
    return joined.withColumn(
        "passed", F.coalesce(F.col("computed_hash") == F.col("expected_hash"), F.lit(False))
    )
