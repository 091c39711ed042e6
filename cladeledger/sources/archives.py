"""Checksum lists inside package archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import CHECKSUM_LIST_NAME
from cladeledger.functions.checksums import parse_checksum_line
from cladeledger.functions.text import basename

_SCHEMA = "path STRING, member STRING, line_no BIGINT, value STRING"
_LINES_PER_BATCH = 10_000
SPREAD_BYTES = 64 << 20


def read_package_checksums(paths: DataFrame, column: str = "path") -> DataFrame:
    """Checksum entries of many archives, given as a column of paths (SRC-7).

    Each archive is opened in place by one task and only its checksum list is read, line by line. The
    root list wins, else the first nested one by name; an archive without a list fails the job.
    """
    tasks = paths.sparkSession.sparkContext.defaultParallelism
    rows = paths.select(F.col(column).alias("path")).repartition(tasks, "path")
    lines = rows.mapInPandas(_read_lists, _SCHEMA)
    return (
        lines.withColumn("entry", parse_checksum_line(F.col("value"), "package"))
        .filter("entry IS NOT NULL")
        .select(
            F.col("path").alias("package"),
            "member",
            "line_no",
            F.col("entry.hash").alias("expected_hash"),
            F.col("entry.path").alias("file_path"),
        )
    )


def _read_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for path in batch["path"]:
            system, inner = FileSystem.from_uri(path)
            with system.open_input_file(inner) as source, zipfile.ZipFile(source) as archive:
                names = archive.namelist()
                nested = sorted(n for n in names if n.endswith("/" + CHECKSUM_LIST_NAME))
                if CHECKSUM_LIST_NAME in names:
                    nested = [CHECKSUM_LIST_NAME]
                if not nested:
                    raise ValueError(f"no {CHECKSUM_LIST_NAME} in package {path}")
                with archive.open(nested[0]) as member:
                    yield from _line_batches(path, nested[0], io.TextIOWrapper(member, "utf-8"))


def archive_members(files: DataFrame) -> DataFrame:
    """Files inside the ``.zip`` files at the top of a download folder, as if they were unpacked beside them (SRC-16).

    ``files`` has path and rel_path. Columns: path and rel_path below the folder named like the archive, name, size,
    archive, and error for an archive that cannot be opened, which has one row without a name.
    """
    top = files.filter(F.endswith("rel_path", F.lit(".zip")) & ~F.contains("rel_path", F.lit("/")))
    rows = list_members(top)
    folder, member = F.regexp_replace("archive", r"\.zip$", ""), F.coalesce(F.concat(F.lit("/"), "member"), F.lit(""))
    return rows.select(
        F.concat(folder, member).alias("path"), F.concat(basename(folder), member).alias("rel_path"),
        basename(F.col("member")).alias("name"), "size", "archive", "error",
    )


_MEMBERS = "archive STRING, member STRING, size BIGINT, error STRING"


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for path in batch["path"]:
            try:
                system, inner = FileSystem.from_uri(path)
                with system.open_input_file(inner) as source, zipfile.ZipFile(source) as archive:
                    rows = [(path, m.filename, m.file_size, None) for m in archive.infolist() if not m.is_dir()]
            except (OSError, zipfile.BadZipFile) as problem:
                rows = [(path, None, None, f"I/O error: {problem}")]
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "error"]).astype({"size": "Int64"})


def member_lines(members: DataFrame, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Lines of members of archives: ``archive``, ``member``, ``line_no`` and ``value`` (SRC-7).

    ``members`` has archive, member and size, from ``list_members``. A task opens an archive and reads by range what a
    member needs, so the members of one archive go to as many tasks as their sizes ask for. Members that are not
    UTF-8 are read as far as they are text; an archive that cannot be opened fails the job.
    """
    total = members.agg(F.sum("size")).first()[0] or 0
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-total // spread_bytes))
    rows = members.select("archive", "member").repartition(int(tasks), "archive", "member")
    return rows.mapInPandas(_read_members, "path STRING, member STRING, line_no BIGINT, value STRING").withColumnRenamed("path", "archive")


def list_members(archives: DataFrame) -> DataFrame:
    """``archive``, ``member``, ``size`` and ``error`` of the files in each archive of column ``path``, from its directory alone."""
    tasks = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(tasks, "path").mapInPandas(_list_members, _MEMBERS)


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        # The directory of an archive is read once for all its members here.
        for path, names in batch.groupby("archive")["member"]:
            system, inner = FileSystem.from_uri(path)
            with system.open_input_file(inner) as source, zipfile.ZipFile(source) as archive:
                for name in names:
                    with archive.open(name) as member:
                        lines = (line.rstrip("\r\n") for line in io.TextIOWrapper(member, "utf-8", "replace"))
                        yield from _line_batches(path, name, lines)


def _line_batches(path: str, member: str, lines) -> Iterator[pd.DataFrame]:
    pending = []
    for number, line in enumerate(lines, start=1):
        pending.append((path, member, number, line))
        if len(pending) == _LINES_PER_BATCH:
            yield pd.DataFrame(pending, columns=["path", "member", "line_no", "value"])
            pending = []
    if pending:
        yield pd.DataFrame(pending, columns=["path", "member", "line_no", "value"])
