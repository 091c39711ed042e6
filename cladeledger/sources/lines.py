"""Line-based lists: accessions, taxa, checksum lists and failure lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.fixed_values import ERROR, FAIL, MISSING
from cladeledger.functions.checksums import parse_checksum_line, resolve_path
from cladeledger.functions.text import dirname, strip
from cladeledger.operators.dedup import first_wins
from cladeledger.sources.inventory import list_tree

# Bytes of a list that one task reads at a time.
RANGE_BYTES = 16 * 1024**2


def position() -> Column:
    """Order of a line over all files of a scan: file, place of its split, place in the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def file_path() -> Column:
    """Path of the scanned file, decoded, and without a URI scheme for local files."""
    plus_kept = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(plus_kept), "^file:/+", "/")


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Columns ``value``, ``list_path`` and ``line`` (position)."""
    return spark.read.options(**options).text(path).select(
        "value", file_path().alias("list_path"), position().alias("line")
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_accessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct accessions with first position and number of copies (SRC-3)."""
    lines = read_lines(spark, path).select(strip(F.col("value")).alias("accession"), "line")
    lines = lines.filter("accession <> ''")
    return first_wins(require_rows(lines, f"no accession in {path}"), ["accession"], F.col("line"), "copies")


def read_taxa(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Taxon names or ids, second column of tabbed lines, duplicates kept (SRC-4)."""
    text = strip(F.col("value"))
    fields = F.split("text", "\t")
    taxa = (
        read_lines(spark, path)
        .select(text.alias("text"), "line")
        .filter((F.col("text") != "") & ~F.startswith("text", F.lit("#")))
        .select(
            F.when(F.size(fields) > 1, strip(F.get(fields, F.lit(1)))).otherwise(F.col("text")).alias("taxon"),
            "line",
        )
        .filter("taxon <> ''")
    )
    return require_rows(taxa, f"no taxon in {path}")


def read_many_lists(lists: DataFrame) -> DataFrame:
    """Lines of the files in ``lists`` (path, size), as ``read_lines`` gives them.

    Files are found by path, not by a listing on the driver, and read in ranges of ``RANGE_BYTES``, so a file of
    any size is read by one rule: a line ends at ``\\n``, ``\\r\\n`` or ``\\r``, and belongs to the range it starts in.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size").cast("bigint") - 1, F.lit(0).cast("bigint")), F.lit(RANGE_BYTES).cast("bigint"))
    ranges = lists.filter("size > 0").select("path", F.explode(starts).alias("start"))
    tasks = lists.sparkSession.sparkContext.defaultParallelism
    step = RANGE_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                values = lines_of_range(path, start, start + step)
                n = len(values)
                columns = [pa.array(values, pa.string()), pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(n), pa.int64())]
                yield pa.record_batch(columns, names=["value", "list_path", "block", "row"])

    lines = ranges.repartition(tasks, "path", "start").mapInArrow(read, "value STRING, list_path STRING, block BIGINT, row BIGINT")
    place = F.struct(F.col("list_path").alias("file"), "block", "row")
    return lines.select("value", "list_path", place.alias("line"))


def read_folders(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``value``, ``folder`` (a text) and ``line`` (position) of all files in the folders of its values below ``path``.

    Tasks list the folders and read the files, so there may be as many as there are rows.
    """
    files = list_tree(spark, path).filter(~F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit(".")))
    value = F.url_decode(F.replace(F.regexp_extract("list_path", f"/{folder}=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    # Fixed value: the folder of null.
    value = F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__"))
    return read_many_lists(files.select("path", "size")).select("value", value.alias(folder), "line")


def lines_of_range(path: str, start: int, stop: int) -> list[str]:
    """The lines that start at ``start`` or later and before ``stop``; the last one is read to its end."""
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        # One byte more at the front tells whether a line starts at ``start``.
        first = max(start - 1, 0)
        file.seek(first)
        data = file.read(stop - first)
        # The last line's end may lie beyond, and a \r at the edge may be half of an end.
        while more := file.read(1 << 16):
            data += more
            if re.search(rb"[\r\n]", more[:-1]):
                break
    ends = [m.end() for m in re.finditer(rb"\r\n|\n|\r", data)]
    edges = sorted({*([0] if start == 0 else []), *ends})
    out = []
    for i, at in enumerate(edges):
        if start <= first + at < stop and at < len(data):
            line = data[at : edges[i + 1] if i + 1 < len(edges) else len(data)]
            out.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
    return out


def read_checksums(spark: SparkSession, path: str | list[str], dialect: str = "strict", **options) -> DataFrame:
    """Entries of checksum lists with the absolute path each one means (SRC-5)."""
    return checksum_entries(read_lines(spark, path, **options), dialect)


def checksum_entries(lines: DataFrame, dialect: str = "strict") -> DataFrame:
    parsed = lines.withColumn("entry", parse_checksum_line(F.col("value"), dialect)).filter("entry IS NOT NULL")
    return parsed.select(
        F.col("entry.hash").alias("expected_hash"),
        F.col("entry.path").alias("file_path"),
        resolve_path(dirname(F.col("list_path")), F.col("entry.path")).alias("abs_path"),
        "list_path",
        "line",
    )


def read_checksums_lenient(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Standard and BSD lines; a file that is not UTF-8 throughout is read as latin-1 (SRC-6)."""
    lines = read_lines(spark, path, **options)
    other = lines.filter(~F.is_valid_utf8("value")).select("list_path").distinct()
    other = other.withColumn("latin", F.lit(True))
    # The text source keeps the bytes of a line as they are, so they can be decoded again.
    decoded = F.when(F.col("latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = lines.join(other, "list_path", "left").withColumn("value", F.coalesce(decoded, "value"))
    parsed = lines.withColumn("entry", parse_checksum_line(F.col("value"), "lenient"))
    return parsed.filter("entry IS NOT NULL").select(
        F.col("entry.hash").alias("expected_hash"),
        F.col("entry.path").alias("file_path"),
        "list_path",
        "line",
    )


def read_failures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of ``STATUS | PATH | EXPECTED | COMPUTED | ERROR`` lists (SRC-11)."""
    fields = F.split(F.col("text"), r"\s*\|\s*", 5)

    def value(index: int) -> Column:
        return strip(F.get(fields, F.lit(index)))

    known = {"FAIL": FAIL, "MISSING": MISSING}
    status = F.lit(ERROR)
    for word, state in known.items():
        status = F.when(value(0) == word, state).otherwise(status)
    return (
        read_lines(spark, path)
        .select(strip(F.col("value")).alias("text"))
        .filter((F.col("text") != "") & ~F.startswith("text", F.lit("#")) & (F.size(fields) >= 3))
        .select(
            status.alias("status"),
            value(1).alias("file_path"),
            F.nullif(value(2), F.lit("N/A")).alias("expected_hash"),
            F.nullif(value(3), F.lit("N/A")).alias("computed_hash"),
            value(4).alias("error_message"),
        )
    )


def read_failure_root(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The verified directory named in the header of each failure list."""
    label = "# Verification Directory:"
    return (
        read_lines(spark, path)
        .filter(F.startswith(strip(F.col("value")), F.lit(label)))
        .select("list_path", strip(F.regexp_extract("value", "^[^:]*:(.*)$", 1)).alias("root"), "line")
        .groupBy("list_path")
        .agg(F.min_by("root", "line").alias("root"))
    )
