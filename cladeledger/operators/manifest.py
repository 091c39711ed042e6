"""Trusted-artifact manifests: merge, coverage, rebuild from packages and legacy import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.fixed_values import (
    CHECKSUM_LIST_NAME,
    LEGACY_CHECKSUM_SOURCE,
    MANIFEST_NAME,
    PACKAGE_CHECKSUM_SOURCE,
)
from cladeledger.functions.accessions import loose_accession
from cladeledger.functions.filetypes import file_type, standard_name, type_of_standard_name
from cladeledger.functions.text import basename
from cladeledger.workspace import materialize


def classify_merge(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """Each filename of either side with its action (JN-15).

    ``keep``: only in the manifest. ``insert``: new. ``unchanged``: same hash. ``conflict``: another
    hash than the manifest, or several hashes within the batch. Both sides are reduced to one row per
    filename before the join.
    """
    old = manifest.groupBy("filename").agg(F.max("expected_md5").alias("old_md5"))
    new = batch.groupBy("filename").agg(
        F.min("expected_md5").alias("new_md5"),
        (F.min("expected_md5") != F.max("expected_md5")).alias("disagree"),
    )
    action = (
        F.when(F.col("new_md5").isNull(), "keep")
        .when(F.col("disagree"), "conflict")
        .when(F.col("old_md5").isNull(), "insert")
        .when(F.col("old_md5") == F.col("new_md5"), "unchanged")
        .otherwise("conflict")
    )
    return old.join(new, "filename", "full_outer").select(
        "filename", "old_md5", "new_md5", action.alias("action")
    )


def merge(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """The manifest after a batch: its rows plus the inserts; conflicts change nothing."""
    new = F.when(F.col("action") == "insert", F.col("new_md5"))
    merged = classify_merge(manifest, batch).select("filename", F.coalesce("old_md5", new).alias("expected_md5"))
    return merged.filter("expected_md5 IS NOT NULL")


def judge_batches(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifact rows with ``old_md5``, ``conflict`` and ``batch_ok`` for whole batches of ``batch_num``.

    As if the batches came one after the other: one fails as a whole if a hash of it differs from the manifest, from
    another of its own rows, or from an earlier batch that did not fail itself. A batch that no earlier live one
    contradicts is good. One with a single opponent is the opposite of it, so chains of such batches are settled by
    pointer jumping, in rounds that grow with the logarithm of their length. One with several opponents fails if the
    first is good and waits while that is open; each round settles at least the first open batch.
    """
    old = manifest.groupBy("filename").agg(F.max("expected_md5").alias("old_md5"))
    names = artifacts.groupBy("batch_num", "filename").agg(
        F.min("expected_md5").alias("md5"), (F.min("expected_md5") != F.max("expected_md5")).alias("disagree")
    )
    differs = F.col("disagree") | F.coalesce(F.col("old_md5") != F.col("md5"), F.lit(False))
    names = materialize(names.join(old, "filename", "left").withColumn("fault", differs).drop("disagree"), "claims")
    # true: good, false: failed, null: open
    verdicts = names.groupBy("batch_num").agg(F.when(F.bool_or("fault"), False).alias("good"))
    while True:
        verdicts = materialize(_settled(names, verdicts), "verdicts")
        if verdicts.filter("good IS NULL").isEmpty():
            break
    good = names.join(verdicts, "batch_num").filter("good").groupBy("filename").agg(F.min(F.struct("batch_num", "md5")).alias("kept"))
    conflict = F.col("fault") | F.coalesce(
        (F.col("kept.md5") != F.col("md5")) & (F.col("kept.batch_num") < F.col("batch_num")), F.lit(False)
    )
    judged = names.join(good, "filename", "left").withColumn("conflict", conflict).join(verdicts, "batch_num")
    judged = judged.select("batch_num", "filename", "old_md5", "conflict", F.col("good").alias("batch_ok"))
    return artifacts.join(judged, ["batch_num", "filename"])


def _settled(names: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` with what one round settles."""
    live = names.join(verdicts, "batch_num").filter("good IS NULL OR good")
    # Who says otherwise about a name before a batch: the last one stands where the run of equal hashes begins.
    by_name = Window.partitionBy("filename").orderBy("batch_num")
    so_far = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.lag("md5").over(by_name) != F.col("md5"), F.lag(F.struct("batch_num", "good")).over(by_name))
    claims = live.withColumns({"last": last, "one": F.first(F.struct("md5", "batch_num", "good")).over(so_far)})
    other = F.when(F.col("one.md5") != F.col("md5"), F.struct("batch_num", "good"))
    claims = claims.withColumns({"last": F.last("last", ignorenulls=True).over(so_far), "two": F.first(other, ignorenulls=True).over(so_far)})
    first = F.when(F.col("one.md5") != F.col("md5"), F.struct(F.col("one.batch_num"), F.col("one.good")))
    first = first.otherwise(F.when(F.col("two.batch_num") < F.col("batch_num"), F.col("two")))
    found = claims.filter("good IS NULL").select("batch_num", first.alias("first"), "last").groupBy("batch_num")
    opponents = materialize(found.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or(F.coalesce("first.good", F.lit(False)) | F.coalesce("last.good", F.lit(False))).alias("by_good")), "opponents")
    settled = F.when(F.col("first").isNull(), True).when(F.coalesce("by_good", F.lit(False)), False)
    now = verdicts.join(opponents, "batch_num", "left")
    now = now.select("batch_num", F.when(F.col("good").isNotNull(), F.col("good")).otherwise(settled).alias("good"))
    single = opponents.filter("first.batch_num = last.batch_num AND NOT coalesce(by_good, false)")
    chains = _chain_ends(single.select("batch_num", F.col("first.batch_num").alias("end"), F.lit(1).alias("steps")))
    if chains is None:
        return now
    ends = now.select(F.col("batch_num").alias("end"), F.col("good").alias("end_good"))
    # An even number of opposites is the same.
    verdict = F.when(F.col("steps") % 2 == 0, F.col("end_good")).otherwise(~F.col("end_good"))
    chained = chains.join(ends, "end").select("batch_num", verdict.alias("chained"))
    return now.join(chained, "batch_num", "left").select("batch_num", F.coalesce("good", "chained").alias("good"))


def _chain_ends(chains: DataFrame) -> DataFrame | None:
    """Follow ``end`` until it has none itself, adding up ``steps``; each round doubles the distance. None if empty."""
    chains = materialize(chains, "chains")
    if chains.isEmpty():
        return None
    while True:
        onward = chains.select(F.col("batch_num").alias("end"), F.col("end").alias("beyond"), F.col("steps").alias("more"))
        longer = chains.join(onward, "end", "left").select(
            "batch_num", F.coalesce("beyond", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("beyond").isNotNull().alias("moved"),
        )
        longer = materialize(longer, "chains")
        chains = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return chains


def coverage(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tracked, discovered and untracked output files of a folder (AG-14)."""
    outputs = files.filter(
        ~F.col("name").isin(CHECKSUM_LIST_NAME, MANIFEST_NAME)
        & ~F.startswith("name", F.lit("."))
        & ~F.contains("rel_path", F.lit("/"))
    )
    tracked = manifest.select(F.col("filename").alias("name")).distinct().withColumn("tracked", F.lit(True))
    joined = outputs.join(tracked, "name", "left")
    return joined.agg(
        F.count_if(F.col("tracked")).alias("tracked_artifacts"),
        F.count("*").alias("discovered_artifacts"),
        F.count_if(F.col("tracked").isNull()).alias("untracked_artifacts"),
    )


def rebuild_candidates(
    entries: DataFrame, requested: DataFrame, outputs: DataFrame, include: Sequence[str]
) -> DataFrame:
    """Package checksum entries with the reason each is kept or dropped (JN-14).

    ``entries`` has expected_hash and file_path, ``requested`` accession, ``outputs`` name.
    """
    wanted = requested.select("accession").distinct().withColumn("requested", F.lit(True))
    present = outputs.select(F.col("name").alias("filename")).distinct().withColumn("present", F.lit(True))
    kind = file_type(F.col("file_path"), include)
    typed = entries.withColumns(
        {"accession": loose_accession(F.col("file_path")), "include_type": kind}
    ).withColumn("filename", standard_name(F.col("file_path"), F.col("accession"), F.col("include_type")))
    reason = (
        F.when(F.col("accession").isNull(), "unrecognized")
        .when(F.col("requested").isNull(), "unrequested")
        .when(F.col("include_type").isNull(), "unrecognized")
        .when(F.col("present").isNull(), "missing_output")
        .otherwise("commit")
    )
    # Entries without accession, and so without name, get keys of their own instead of meeting in one task.
    own = F.concat(F.lit("\0"), "file_path")
    keyed = typed.withColumns({"_accession": F.coalesce("accession", own), "_filename": F.coalesce("filename", own)})
    return (
        keyed.join(wanted.withColumnRenamed("accession", "_accession"), "_accession", "left")
        .join(present.withColumnRenamed("filename", "_filename"), "_filename", "left")
        .withColumn("reason", reason)
        .select("file_path", "expected_hash", "accession", "include_type", "filename", "reason")
    )


def rebuild_counts(candidates: DataFrame) -> DataFrame:
    """Rows and distinct names per reason (AG-20)."""
    return candidates.groupBy("reason").agg(
        F.count("*").alias("n_entries"), F.count_distinct("filename").alias("n_names")
    )


def missing_outputs(candidates: DataFrame) -> DataFrame:
    """Distinct output names that should exist but do not, sorted."""
    return candidates.filter("reason = 'missing_output'").select("filename").distinct().orderBy("filename")


def artifacts(accession: Column, kind: Column, name: Column, md5: Column, source: Column | None = None) -> list[Column]:
    """The columns of a manifest row."""
    return [
        accession.alias("accession"),
        kind.alias("include_type"),
        name.alias("filename"),
        md5.alias("expected_md5"),
        (F.lit(PACKAGE_CHECKSUM_SOURCE) if source is None else source).alias("checksum_source"),
    ]


def legacy_import(manifest: DataFrame, legacy: DataFrame, outputs: DataFrame) -> DataFrame:
    """Manifest rows from an old checksum list, only for an empty manifest and existing files (JN-16).

    ``legacy`` has expected_hash and file_path with one row per name. The accession comes from the
    name itself, so ``A.1.rna.fna`` belongs to ``A.1``.
    """
    present = outputs.select(F.col("name").alias("file_path")).distinct()
    rows = legacy.join(present, "file_path", "left_semi")
    if not manifest.isEmpty():
        rows = rows.limit(0)
    name = basename(F.col("file_path"))
    accession = F.coalesce(loose_accession(name), F.regexp_replace(name, r"\.[^.]*$", ""))
    return rows.select(
        *artifacts(
            accession, type_of_standard_name(name), name, F.col("expected_hash"), F.lit(LEGACY_CHECKSUM_SOURCE)
        )
    )
