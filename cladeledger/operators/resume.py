"""What is left to do: completed items, valid outputs, batches and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import DEFAULT_BATCH_SIZE, INCLUDE_EXTENSIONS, OUTPUT_EXTENSIONS
from cladeledger.functions.filetypes import file_type, include_types
from cladeledger.functions.names import safe_directory_name
from cladeledger.operators.dedup import first_wins, last_wins
from cladeledger.ordering import with_row_number


def remaining(requested: DataFrame, completed: DataFrame, item: str) -> DataFrame:
    """Requested rows whose item is not completed (JN-4, SE-2)."""
    return requested.join(completed.select(item).distinct(), item, "left_anti")


def index_by_name(files: DataFrame) -> DataFrame:
    """First path of each file name and how many paths share it (WN-3)."""
    return first_wins(files.select("name", "path"), ["name"], F.col("path"), "copies")


def completeness(accessions: DataFrame, files: DataFrame, manifest: DataFrame, include: Sequence[str]) -> DataFrame:
    """Expected and found files per accession; complete if all exist and are trusted (JN-5).

    Each side becomes (accession, bits): a standard name is an accession and the extension of a type, and each type
    has a bit for being present and one for being trusted. One aggregation by accession brings them together;
    a name that ends in several extensions counts for each accession that it could belong to.
    """
    types = _types_of(include)

    def bits_of(name: Column, shift: int) -> Column:
        possible = [
            F.when(
                F.endswith(name, F.lit(extension)),
                F.struct(F.left(name, F.length(name) - len(extension)).alias("accession"), F.lit(1 << 2 * i + shift).cast("bigint").alias("bits")),
            )
            for i, extension in enumerate(types)
        ]
        return F.inline(F.array_compact(F.array(*possible)))

    present = files.select(bits_of(F.col("name"), 0))
    trusted = manifest.filter("expected_md5 <> ''").select(bits_of(F.col("filename"), 1))
    wanted = 1 << 2 * len(types)
    asked = accessions.select("accession", F.lit(wanted).cast("bigint").alias("bits"))
    n_rows = F.count_if(F.col("bits") == wanted)
    merged = asked.unionByName(present).unionByName(trusted).groupBy("accession").agg(F.bit_or("bits").alias("bits"), n_rows.alias("n_rows"))
    found = sum((F.when(F.col("bits").bitwiseAND(F.lit(3 << 2 * i)) == 3 << 2 * i, 1).otherwise(0) for i in range(len(types))), F.lit(0))
    counts = [(F.col("n_rows") * len(types)).alias("n_expected"), (F.col("n_rows") * found).alias("n_found")]
    return merged.filter("n_rows > 0").select("accession", *counts).withColumn("complete", F.col("n_expected") == F.col("n_found"))


def _types_of(include: Sequence[str]) -> list[str]:
    """Output extensions of the requested types, one each."""
    return [OUTPUT_EXTENSIONS[t] for t in include_types(include)]


def taxa_with_files(taxa: DataFrame, files: DataFrame, include: Sequence[str] | None) -> DataFrame:
    """Completed taxa whose folder holds at least one requested file (JN-6)."""
    folder = F.substring_index("rel_path", "/", 1)
    good = files.filter(
        (F.size(F.split("rel_path", "/")) == 2) & file_type(F.col("name"), include_types(include)).isNotNull()
    ).select(folder.alias("folder"))
    named = taxa.withColumn("folder", safe_directory_name(F.col("taxon")))
    return named.join(good.distinct(), "folder", "left_semi").drop("folder")


def resume_accessions(
    requested: DataFrame,
    completed: DataFrame,
    files: DataFrame,
    manifest: DataFrame,
    include: Sequence[str],
    validate: bool = True,
) -> DataFrame:
    """Accessions still to be processed (JN-7).

    With a saved state its completed accessions count, when validating only those with trusted files.
    Without one, requested accessions whose trusted files exist are skipped.
    """
    if not validate:
        return remaining(requested, completed, "accession")
    candidates = requested if completed.isEmpty() else completed
    done = completeness(candidates.select("accession").distinct(), files, manifest, include).filter("complete")
    return remaining(requested, done, "accession")


def resume_taxa(
    requested: DataFrame, completed: DataFrame, files: DataFrame, include: Sequence[str] | None, validate: bool = True
) -> DataFrame:
    """Taxa still to be processed; completed ones count only with files when validating."""
    done = taxa_with_files(completed, files, include) if validate else completed
    return remaining(requested, done, "taxon")


def in_batches(items: DataFrame, order: Sequence[Column], batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Add the 1-based position and batch number in list order (WN-5)."""
    numbered = with_row_number(items, [], order, "position")
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / batch_size).cast("bigint") + 1)


def latest_state(events: DataFrame, item: str, order: Column) -> DataFrame:
    """The last event of each item (WN-7)."""
    return last_wins(events, [item], order)


def progress_state(events: DataFrame, order: Column) -> DataFrame:
    """completed or failed per item: a completion removes a failure, a later failure adds one (SNK-8)."""
    known = events.filter(F.col("state").isin("completed", "failed"))
    seen = known.groupBy("item").agg(F.bool_or(F.col("state") == "completed").alias("done"), F.max_by("state", order).alias("last"))
    states = F.array(F.when(F.col("done"), "completed"), F.when(F.col("last") == "failed", "failed"))
    return seen.select("item", F.explode(F.array_compact(states)).alias("state"))


def progress_summary(states: DataFrame, start: Column, now: Column) -> DataFrame:
    """Completed and failed counts and elapsed seconds (AG-18)."""
    return states.agg(
        F.count_if(F.col("state") == "completed").alias("completed_count"),
        F.count_if(F.col("state") == "failed").alias("failed_count"),
    ).withColumn("elapsed_seconds", now - start)


def accession_outcome(saved: DataFrame, include: Sequence[str]) -> DataFrame:
    """Saved and missing include types per accession; complete when none is missing (AG-13, SE-3).

    The saved types of an accession are bits of one integer, so the aggregation stays a hash aggregation
    with a fixed-size buffer.
    """
    types = sorted(INCLUDE_EXTENSIONS)
    bits = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(1 << i))])
    wanted = sum(1 << types.index(t) for t in include_types(include))
    masks = saved.groupBy("accession").agg(F.bit_or(F.element_at(bits, F.col("include_type"))).alias("mask"))

    def names_of(mask: Column) -> Column:
        return F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, t) for i, t in enumerate(types)])

    lacking = F.bitwise_not("mask").bitwiseAND(F.lit(wanted))
    return masks.select(
        "accession",
        names_of(F.col("mask")).alias("saved_types"),
        names_of(lacking).alias("missing_types"),
        (lacking == 0).alias("complete"),
    )
