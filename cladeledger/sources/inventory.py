"""File inventories: directory trees listed in parallel, and what is found in them."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import batched, islice
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.fixed_values import CHECKSUM_LIST_NAME, INCLUDE_EXTENSIONS
from cladeledger.functions.accessions import strict_accession
from cladeledger.functions.filetypes import file_type, include_types
from cladeledger.functions.text import basename
from cladeledger.workspace import materialize

_SCHEMA = "path STRING, is_directory BOOLEAN, size BIGINT, modified DOUBLE, error STRING, more BOOLEAN"
_ENTRIES_PER_BATCH = 10_000
# Beyond so many entries a directory is listed by many tasks, each for its share of the names.
SHARED_FROM = 20_000


def list_tree(spark: SparkSession, root: str, shared_from: int = SHARED_FROM) -> DataFrame:
    """All files below ``root`` with path, rel_path, name, size and modified. Hidden files are listed too."""
    return list_entries(spark, root, shared_from).filter("NOT is_directory").drop("is_directory", "error")


def list_entries(spark: SparkSession, root: str, shared_from: int = SHARED_FROM) -> DataFrame:
    """Files and directories below ``root``; ``error`` tells why a directory could not be read.

    Directories are listed by the executors, one level of the tree per round; the listing never
    passes through the driver. A directory of more than ``shared_from`` entries, such as one flat folder of all
    files, is listed once more in the next round: every task reads the names, which is quick, and looks at those
    whose hash is its share, which is what takes the time.
    """
    root = root.rstrip("/")
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root, 0, 1)], "path STRING, share INT, shares INT")
    found = None

    def list_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _list_directories(batches, shared_from)

    while True:
        spread = level.repartition(tasks, "path", "share")
        listed = materialize(spread.mapInPandas(list_some, _SCHEMA), "listing")
        entries = listed.filter("NOT more").drop("more")
        found = entries if found is None else found.unionByName(entries)
        below = entries.filter("is_directory AND error IS NULL").select("path", F.lit(0).alias("share"), F.lit(1).alias("shares"))
        shares = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("share")
        again = listed.filter("more").select("path", shares).withColumn("shares", F.lit(tasks))
        level = below.unionByName(again)
        if level.isEmpty():
            break
    return found.select(
        "path",
        F.substr("path", F.lit(len(root) + 2)).alias("rel_path"),
        basename(F.col("path")).alias("name"),
        "size",
        "modified",
        "is_directory",
        "error",
    )


def _list_directories(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    columns = ["path", "is_directory", "size", "modified", "error", "more"]

    def found() -> Iterator[tuple]:
        for batch in batches:
            for directory, share, shares in zip(batch["path"], batch["share"], batch["shares"]):
                entries = _entries(directory, int(share), int(shares))
                if shares == 1:
                    first = list(islice(entries, limit + 1))
                    if len(first) > limit:
                        yield directory, True, 0, 0.0, None, True
                        continue
                    entries = iter(first)
                for entry in entries:
                    yield *entry, False

    # A frame for many small directories together.
    for some in batched(found(), _ENTRIES_PER_BATCH):
        yield pd.DataFrame(some, columns=columns)


def _entries(directory: str, share: int = 0, shares: int = 1) -> Iterator[tuple[str, bool, int, float, str | None]]:
    """What a directory holds of a share of the names, or one row with the error if it cannot be read."""
    if "://" not in directory:
        plain = directory.removeprefix("file:")
        try:
            with os.scandir(plain) as entries:
                for entry in entries:
                    if shares > 1 and crc32(os.fsencode(entry.name)) % shares != share:
                        continue
                    # Links to directories are not followed, so that a listing ends.
                    if entry.is_dir(follow_symlinks=False):
                        yield f"{plain}/{entry.name}", True, 0, 0.0, None
                    elif entry.is_file():
                        status = entry.stat()
                        yield f"{plain}/{entry.name}", False, status.st_size, status.st_mtime, None
        except OSError as problem:
            if share == 0:
                yield plain, True, 0, 0.0, _reason(problem)
        return
    from pyarrow.fs import FileSelector, FileSystem, FileType

    try:
        system, inner = FileSystem.from_uri(directory)
        for info in system.get_file_info(FileSelector(inner)):
            if shares > 1 and crc32(info.base_name.encode()) % shares != share:
                continue
            is_directory = info.type == FileType.Directory
            yield f"{directory}/{info.base_name}", is_directory, info.size or 0, (info.mtime_ns or 0) / 1e9, None
    except OSError as problem:
        if share == 0:
            yield directory, True, 0, 0.0, _reason(problem)


def _reason(problem: OSError) -> str:
    return f"{'Permission denied' if isinstance(problem, PermissionError) else 'I/O error'}: {problem}"


def existing_files(paths: DataFrame) -> DataFrame:
    """The given paths that exist as files, with their size."""
    tasks = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(tasks, "path").mapInPandas(_sizes, "path STRING, size BIGINT")


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem, FileType

    for batch in batches:
        rows = []
        for path in batch["path"]:
            system, inner = FileSystem.from_uri(path)
            info = system.get_file_info(inner)
            if info.type == FileType.File:
                rows.append((path, info.size))
        yield pd.DataFrame(rows, columns=["path", "size"])


def requested_files(files: DataFrame, include: Sequence[str] | None) -> DataFrame:
    """Data files of the requested include types, with their type (SRC-13)."""
    kinds = include_types(include)
    fits = F.lit(False)
    for kind in kinds:
        for extension in INCLUDE_EXTENSIONS[kind]:
            fits = fits | ((F.col("include_type") == kind) & F.endswith("name", F.lit(extension)))
    return files.withColumn("include_type", file_type(F.col("name"), kinds)).filter(fits)


def checksum_lists(files: DataFrame, name: str = CHECKSUM_LIST_NAME) -> DataFrame:
    """The checksum lists of a tree and its layout, ``accession`` or ``taxon`` (SRC-14).

    A root list without any list one level below means the flat accession layout.
    """
    lists = files.filter(F.col("name") == name)
    depth = F.size(F.split("rel_path", "/"))
    seen = lists.agg(
        F.bool_or(depth == 1).alias("at_root"), F.bool_or(depth == 2).alias("below")
    ).first()
    if seen.at_root is None:
        raise ValueError(f"no {name} found")
    flat = seen.at_root and not seen.below
    chosen = lists.filter(depth == 1) if flat else lists
    return chosen.withColumn("layout", F.lit("accession" if flat else "taxon"))


def lists_by_depth(files: DataFrame, name: str = CHECKSUM_LIST_NAME) -> DataFrame:
    """Checksum lists, root first, then by depth and path (SRC-15)."""
    depth = F.size(F.split("rel_path", "/"))
    return files.filter(F.col("name") == name).withColumn("depth", depth).orderBy("depth", "rel_path")


def downloaded_files(files: DataFrame) -> DataFrame:
    """Files of a download folder with their accession, by the best layout present (SRC-16).

    Add ``archives.archive_members`` to ``files`` for what is inside archives. Flat files named by accession win over the whole folder; else, per accession folder, its data
    folder wins over any file with an accession in its path.
    """
    parts = F.split("rel_path", "/")
    flat = F.size(parts) == 1
    folder = strict_accession(F.get(parts, F.lit(0)))
    in_data = (F.size(parts) == 5) & (
        F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
        == F.concat(F.lit("ncbi_dataset/data/"), folder)
    )
    by_path: Column = strict_accession(F.col("path"))
    archive = F.endswith(F.col("name"), F.lit(".zip"))
    candidates = (
        files.withColumn("folder", F.when(~flat, F.get(parts, F.lit(0))))
        .withColumn(
            "priority",
            F.when(flat & ~archive & strict_accession(F.col("name")).isNotNull(), 0)
            .when(~flat & in_data, 1)
            .when(~flat & ~archive & folder.isNotNull() & by_path.isNotNull(), 2),
        )
        .withColumn(
            "accession_id",
            F.when(F.col("priority") == 0, strict_accession(F.col("name")))
            .when(F.col("priority") == 1, folder)
            .otherwise(by_path),
        )
        .filter("priority IS NOT NULL")
    )
    named = candidates.filter("priority = 0")
    if not named.isEmpty():
        # Flat files have no folder to meet in.
        return named.select("accession_id", "path", "rel_path", "name")
    best = candidates.groupBy("folder").agg(F.min("priority").alias("priority"))
    return candidates.join(best, ["folder", "priority"]).select("accession_id", "path", "rel_path", "name")
