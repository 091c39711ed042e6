"""Ordered text output: rows carry a total order and each part file continues the one before."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.sinks.single_file import is_mounted, plain, replace_folder

# What Spark calls the folder of null, and what it writes as %XX in the names of folders.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def write_lines(lines: DataFrame, path: str, order: Sequence[str], folder: str | None = None, mode: str = "overwrite") -> None:
    """Write column ``line`` in ``order``, replacing ``path``; one sub-folder per ``folder`` value.

    Rows are range-partitioned, so a large list or folder becomes several consecutive part files. Folders on a mounted
    file system, of which there may be very many, are written by the tasks themselves.
    """
    by = ([folder] if folder else []) + list(order)
    placed = lines.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by)
    if folder and mode == "overwrite" and is_mounted(path):
        _write_folders(placed.select(F.col(folder).cast("string").alias("folder"), "line"), path, folder)
        return
    writer = placed.select(*([folder] if folder else []), "line").write.mode(mode)
    (writer.partitionBy(folder) if folder else writer).text(path)


def folder_name(folder: str, value: str | None) -> str:
    """The name that Spark gives the folder of a value."""
    return f"{folder}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else NULL_FOLDER}"


def _write_folders(placed: DataFrame, path: str, folder: str) -> None:
    """``line`` in the folder of ``folder``; rows of a partition come sorted by it. A file gets its name when it is whole."""
    target = plain(path).rstrip("/")
    unfinished = f"{target}.{uuid.uuid4().hex}.unfinished"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        part = f"part-{task.partitionId():05d}.txt"
        now, place, file = None, None, None

        def finish() -> None:
            file.close()
            os.replace(f"{place}/.{part}.{task.taskAttemptId()}", f"{place}/{part}")

        try:
            for batch in batches:
                for value, line in zip(batch.column("folder").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
                    if file is None or value != now:
                        if file is not None:
                            finish()
                        now, place = value, f"{unfinished}/{folder_name(folder, value)}"
                        os.makedirs(place, exist_ok=True)
                        file = open(f"{place}/.{part}.{task.taskAttemptId()}", "wb")
                    file.write(line or b"")
                    file.write(b"\n")
                    n += 1
            if file is not None:
                finish()
        finally:
            if file is not None:
                file.close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(unfinished)
    try:
        placed.mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()
        replace_folder(unfinished, target)
    finally:
        shutil.rmtree(unfinished, ignore_errors=True)


def fixed_lines(spark: SparkSession, section: int, lines: Sequence[str]) -> DataFrame:
    """A few constant lines of a report as rows of (section, item, part, line)."""
    rows = [(section, "", i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "section INT, item STRING, part INT, line STRING")


def exploded(rows: DataFrame, section: int, item: Column, lines: Sequence[Column]) -> DataFrame:
    """The non-null lines of each row as rows of (section, item, part, line)."""
    return rows.select(
        F.lit(section).alias("section"), item.cast("string").alias("item"), F.posexplode(F.array(*lines)).alias("part", "line")
    ).filter("line IS NOT NULL")


REPORT_ORDER = ("section", "item", "part")
