"""Rename plans, checksum paths after renaming, and checks of organised folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import CHECKSUM_LIST_NAME
from cladeledger.functions.accessions import loose_accession
from cladeledger.functions.checksums import strip_package_prefix, unquoted
from cladeledger.functions.filetypes import file_type, standard_name
from cladeledger.functions.text import basename
from cladeledger.operators.dedup import last_wins
from cladeledger.workspace import materialize


def rename_plan(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Output name of each data file: accession and extension, or its own name (PL-6)."""
    named = standard_name(F.col("path"), loose_accession(F.col("path")), F.col("include_type"))
    return files.select(
        *keys, "path", "rel_path", "include_type", F.coalesce(named, F.col("name")).alias("out_name")
    )


def collisions(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Output names that several sources map to (JN-19)."""
    return plan.groupBy(*keys, "out_name").agg(F.count("*").alias("n_sources")).filter("n_sources > 1")


def checksum_mapping(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Source paths, as written and without package prefix, with the output name; the last path wins."""
    sources = F.array_distinct(F.array("rel_path", strip_package_prefix(F.col("rel_path"))))
    each = plan.select(*keys, F.explode(sources).alias("source"), "out_name", F.col("rel_path").alias("o"))
    return last_wins(each, [*keys, "source"], F.col("o")).drop("o")


def resolve_names(entries: DataFrame, mapping: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``out_name`` to checksum entries, null where no mapping fits (JN-9).

    Keys are tried in order: the path, without leading ``./``, without package prefix, the bare name;
    last a name that only one output has. Distinct paths are resolved once each. Only paths that none of their
    own forms resolves go on to the names, of which there is one row each, so a name that very many paths share
    costs nothing where the paths themselves are known.
    """
    path = unquoted(F.col("file_path"))
    forms = F.array_distinct(F.array(path, F.ltrim(path, F.lit("./")), strip_package_prefix(F.col("file_path"))))
    paths = entries.select(*keys, "file_path").distinct()
    tried = paths.select(*keys, "file_path", F.posexplode(forms).alias("priority", "source"))
    direct = (
        tried.join(mapping, [*keys, "source"], "left")
        .groupBy(*keys, "file_path")
        .agg(F.min_by("out_name", F.when(F.col("out_name").isNotNull(), F.col("priority"))).alias("out_name"))
    )
    direct = materialize(direct, "direct")
    base = basename(F.col("source"))
    names = mapping.groupBy(*keys, base.alias("base")).agg(
        F.max(F.when(F.col("source") == base, F.col("out_name"))).alias("bare"),
        F.min("out_name").alias("least"), F.max("out_name").alias("most"),
    )
    one = F.coalesce("bare", F.when(F.col("least") == F.col("most"), F.col("least")))
    names = names.select(*keys, "base", one.alias("out_name"))
    open_paths = direct.filter("out_name IS NULL").select(*keys, "file_path", basename(path).alias("base"))
    by_name = open_paths.join(names, [*keys, "base"], "left").select(*keys, "file_path", "out_name")
    resolved = direct.filter("out_name IS NOT NULL").unionByName(by_name)
    return entries.join(resolved, [*keys, "file_path"], "left")


def merged_checksums(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One line per output name, the last list and line winning (SE-1, WN-2)."""
    named = entries.filter("out_name IS NOT NULL").withColumn("base", basename(F.col("out_name")))
    return last_wins(named.select(*keys, "base", "expected_hash", "out_name", "line"), [*keys, "base"], F.col("line"))


def validate_folders(files: DataFrame, entries: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Files per type and checksum-list checks of each taxon folder (AG-15).

    ``files`` and ``entries`` carry ``folder``; ``entries`` holds parsed lines with file_path, null
    for bad lines. ``folders`` names the folders to report; those without a file come with ``directory_exists``
    false and zero counts.
    """
    typed = files.withColumn("include_type", F.when(F.col("name") != CHECKSUM_LIST_NAME, file_type(F.col("name"))))
    per_folder = typed.groupBy("folder").agg(
        F.count("include_type").alias("total_files"),
        F.count_if(F.endswith("name", F.lit(".fna")) | F.endswith("name", F.lit(".fa"))).alias("fna_files"),
        F.bool_or(F.col("name") == CHECKSUM_LIST_NAME).alias("md5_file_exists"),
    )
    lists = entries.groupBy("folder").agg(
        F.bool_or(F.col("file_path").isNotNull()).alias("md5_valid"),
        F.bool_and(~F.coalesce(F.contains("file_path", F.lit("\\")), F.lit(False))).alias("md5_uses_forward_slashes"),
    )
    found = per_folder.join(lists, "folder", "left").withColumn("directory_exists", F.lit(True))
    if folders is not None:
        found = folders.select("folder").distinct().join(found, "folder", "left")
    marks = ("directory_exists", "md5_file_exists", "md5_valid", "md5_uses_forward_slashes")
    filled = {c: F.coalesce(c, F.lit(False)) for c in marks}
    return found.withColumns(filled | {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total_files", "fna_files")})


def file_names_by_type(files: DataFrame) -> DataFrame:
    """The data files of each folder with their include type, one row per name (AG-15)."""
    typed = files.filter(F.col("name") != CHECKSUM_LIST_NAME).withColumn("include_type", file_type(F.col("name")))
    return typed.filter("include_type IS NOT NULL").select("folder", "include_type", "name")


def files_by_type(files: DataFrame) -> DataFrame:
    """Number of data files per folder and include type."""
    typed = files.filter(F.col("name") != CHECKSUM_LIST_NAME).withColumn("include_type", file_type(F.col("name")))
    return typed.filter("include_type IS NOT NULL").groupBy("folder", "include_type").agg(F.count("*").alias("n_files"))


def list_compatibility(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Whether every line of each folder's list is valid, unix-style and names an existing file (AG-16).

    ``entries``: folder, expected_hash and file_path, both null for bad lines.
    """
    present = files.select("folder", F.col("name").alias("file_path")).distinct().withColumn("present", F.lit(True))
    valid = F.coalesce(F.col("expected_hash").rlike("^[a-fA-F0-9]{32}$"), F.lit(False))
    checked = entries.join(present, ["folder", "file_path"], "left")
    return checked.groupBy("folder").agg(
        F.bool_and(valid).alias("format_valid"),
        F.bool_and(valid & ~F.coalesce(F.contains("file_path", F.lit("\\")), F.lit(False))).alias("paths_unix_style"),
        F.bool_and(valid & F.coalesce("present", F.lit(False))).alias("files_referenced_exist"),
    ).withColumn(
        "compatible_with_md5sum",
        F.col("format_valid") & F.col("paths_unix_style") & F.col("files_referenced_exist"),
    )


def package_state(files: DataFrame) -> DataFrame:
    """ready, missing or empty fetch list, or malformed, per package folder (FN-32).

    ``files`` carries ``package`` and the path ``rel_path`` inside it.
    """
    nested, root = F.col("rel_path") == "ncbi_dataset/fetch.txt", F.col("rel_path") == "fetch.txt"
    seen = files.groupBy("package").agg(
        F.max(F.when(nested, F.col("size"))).alias("nested_size"),
        F.max(F.when(root, F.col("size"))).alias("root_size"),
        F.bool_or(F.startswith("rel_path", F.lit("ncbi_dataset/"))).alias("has_dataset"),
    )
    fetch_size = F.coalesce("nested_size", "root_size")
    status = (
        F.when(fetch_size.isNull() & ~F.col("has_dataset"), "malformed_package")
        .when(fetch_size.isNull(), "missing_fetch_manifest")
        .when(fetch_size == 0, "empty_fetch_manifest")
        .otherwise("ready")
    )
    error = (
        F.when(status == "malformed_package", "malformed_package")
        .when(status == "ready", "")
        .otherwise(F.concat(F.lit("package_"), status))
    )
    return seen.select("package", status.alias("status"), error.alias("error_type"))
