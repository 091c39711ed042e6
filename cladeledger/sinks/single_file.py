"""One file in one order, or several, written by all tasks at once.

Rows are sorted over ranges; the bytes before each row say where it goes. Every task writes its rows at their
places in a new file beside the target, which takes the target's name when all of it is there. A task that runs again
writes the same bytes to the same places, and a run that fails leaves the old file. The file must be on a file system
that the executors share; in object stores, which know no places, ordered part files (``write_lines``) are the form.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeledger.ordering import in_range_order
from cladeledger.workspace import materialize

WRITE_BYTES = 8 << 20


def is_mounted(path: str) -> bool:
    """Whether ``path`` is on a file system that has places in files."""
    return "://" not in path.removeprefix("file://")


def plain(path: str) -> str:
    """The path without a scheme, for Python's own files."""
    place = path.removeprefix("file://").removeprefix("file:")
    if not is_mounted(path):
        raise ValueError(f"{path} is not on a mounted file system; write ordered part files instead")
    return place


def write_text_file(rows: DataFrame, path: str, order: Sequence[str | Column]) -> DataFrame:
    """Write column ``text`` of ``rows`` in ``order`` to the file ``path``, which is replaced as a whole.

    Returns the index: offset, bytes and rows of each range, by which ``read_text_file`` reads all ranges at once.
    Nulls are empty. Rows that ``order`` does not tell apart come in any order.
    """
    target = plain(path)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    sized = rows.select(*[c.alias(f"_by_{i}") for i, c in enumerate(by)], F.coalesce("text", F.lit("")).alias("text"))
    sized = sized.withColumn("_bytes", F.octet_length("text").cast("bigint"))
    ranged = in_range_order(sized, [], [F.col(f"_by_{i}") for i in range(len(by))])
    parts = ranged.groupBy("_part").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n_rows"))
    # One row per range, never the rows themselves.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    index = parts.select(
        F.col("_part").alias("part"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"), "bytes", "n_rows"
    )
    index = materialize(index, "index")
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    placed = placed.join(index.select(F.col("part").alias("_part"), "offset"), "_part")
    placed = placed.select((F.col("offset") + F.col("_inside")).alias("place"), "text")
    unfinished = f"{target}.{uuid.uuid4().hex}.unfinished"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(unfinished, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            done = 0
            held, start, size = [], 0, 0
            for batch in batches:
                for at, text in zip(batch.column("place").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    if held and (at != start + size or size > WRITE_BYTES):
                        done += _put(file, b"".join(held), start)
                        held, size = [], 0
                    start = start if held else at
                    held.append(text)
                    size += len(text)
            done += _put(file, b"".join(held), start)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.record_batch([pa.array([done], pa.int64())], names=["bytes"])

    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        with open(unfinished, "wb"):
            pass
        written = placed.mapInArrow(write, "bytes BIGINT").agg(F.sum("bytes")).first()[0] or 0
        wanted = index.agg(F.sum("bytes")).first()[0] or 0
        if written != wanted or os.path.getsize(unfinished) != wanted:
            raise OSError(f"{written} of {wanted} bytes of {path} were written")
        os.replace(unfinished, target)
    finally:
        if os.path.exists(unfinished):
            os.remove(unfinished)
    return index


def _put(file: int, data: bytes, at: int) -> int:
    done = 0
    while done < len(data):
        done += os.pwrite(file, data[done:], at + done)
    return done


def write_text_files(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write a file below ``path`` for each value of column ``file``, all of them at once; the folder is replaced as a whole.

    Column ``text`` comes in the order of ``section`` and ``order``, with ``separator`` before it if it has one and is
    not the first row of its file and section. Rows that are equal in these may change places.
    """
    target = plain(path).rstrip("/")
    by = ["file", "section", *order, "text"]
    sized = rows.withColumn("_bytes", F.octet_length(F.concat(F.coalesce("separator", F.lit("")), "text")).cast("bigint"))
    ranged = in_range_order(sized, [], [F.col(c) for c in by])
    firsts = ranged.groupBy("file", "section").agg(F.min(F.struct("_part", "_row")).alias("first"))
    firsts = materialize(firsts.select("file", F.col("first._part").alias("_part"), F.col("first._row").alias("_row"), F.lit(True).alias("_first")), "firsts")
    placed = ranged.join(firsts, ["file", "_part", "_row"], "left")
    leading = F.when(F.col("_first").isNull(), F.col("separator"))
    placed = placed.select("file", "_part", "_row", F.concat(F.coalesce(leading, F.lit("")), "text").alias("text"), (
        F.col("_bytes") - F.when(F.col("_first"), F.coalesce(F.octet_length("separator"), F.lit(0))).otherwise(0)
    ).alias("_bytes"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file and range, never the rows themselves.
    parts = placed.groupBy("file", "_part").agg(F.sum("_bytes").alias("bytes"))
    index = materialize(parts.select("file", "_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"), "bytes"), "index")
    inside = Window.partitionBy("file", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    placed = placed.join(index.select("file", "_part", "offset"), ["file", "_part"])
    placed = placed.select("file", (F.col("offset") + F.col("_inside")).alias("place"), "text")
    unfinished = f"{target}.{uuid.uuid4().hex}.unfinished"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, done = None, None, 0
        held, start, size = [], 0, 0
        try:
            for batch in batches:
                for owner, at, text in zip(*(batch.column(c).to_pylist() for c in ("file", "place")), batch.column("text").cast(pa.binary()).to_pylist()):
                    if held and (owner != name or at != start + size or size > WRITE_BYTES):
                        done += _put(file, b"".join(held), start)
                        held, size = [], 0
                    if owner != name:
                        if file is not None:
                            os.fsync(file)
                            os.close(file)
                        name, file = owner, os.open(f"{unfinished}/{owner}", os.O_WRONLY | os.O_CREAT, 0o644)
                    start = start if held else at
                    held.append(text)
                    size += len(text)
            if file is not None:
                done += _put(file, b"".join(held), start)
                os.fsync(file)
        finally:
            if file is not None:
                os.close(file)
        yield pa.record_batch([pa.array([done], pa.int64())], names=["bytes"])

    os.makedirs(unfinished)
    try:
        written = placed.mapInArrow(write, "bytes BIGINT").agg(F.sum("bytes")).first()[0] or 0
        wanted = index.agg(F.sum("bytes")).first()[0] or 0
        there = sum(entry.stat().st_size for entry in os.scandir(unfinished))
        if written != wanted or there != wanted:
            raise OSError(f"{written} of {wanted} bytes below {path} were written")
        replace_folder(unfinished, target)
    finally:
        shutil.rmtree(unfinished, ignore_errors=True)


def replace_folder(finished: str, target: str) -> None:
    """Give a finished folder the place of an old one, if there is any."""
    if os.path.isdir(target) and not os.path.islink(target):
        shutil.rmtree(target)
    elif os.path.lexists(target):
        os.remove(target)
    os.rename(finished, target)


def read_text_file(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``part``, ``line_no`` in it and ``line`` of a file of lines, each range of ``index`` read from its own place."""
    place = plain(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offset, left in zip(*(batch.column(c).to_pylist() for c in ("part", "offset", "bytes"))):
                with open(place, "rb") as file:
                    file.seek(offset)
                    number = 0
                    while left > 0:
                        texts, size = [], 0
                        while size < min(left, WRITE_BYTES):
                            line = file.readline()
                            size += len(line)
                            texts.append(line.decode().removesuffix("\n"))
                        left -= size
                        numbers = range(number, number + len(texts))
                        yield pa.record_batch(
                            [pa.array([part] * len(texts), pa.int32()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())],
                            names=["part", "line_no", "line"],
                        )
                        number += len(texts)

    ranges = index.select("part", "offset", "bytes")
    return ranges.repartition(max(1, ranges.count()), "part").mapInArrow(read, "part INT, line_no BIGINT, line STRING")


def write_lines_file(lines: DataFrame, path: str, order: Sequence[str | Column]) -> DataFrame:
    """Write column ``line`` in ``order`` as one file of lines; the index as in ``write_text_file``."""
    return write_text_file(lines.withColumn("text", F.concat(F.coalesce("line", F.lit("")), F.lit("\n"))), path, order)
