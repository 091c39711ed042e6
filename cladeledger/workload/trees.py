"""Directory trees and package archives written by Spark from the given documents."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.workload.fixtures import derived, given
from cladeledger.workspace import new_path

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        path = new_path(spark, kind)
        write(path)
        _written[key] = path
    return _written[key]


def _save(path: str, content: bytes) -> int:
    from pyarrow.fs import FileSystem

    folder, _, name = path.rpartition("/")
    system, inner = FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/{name}") as stream:
        stream.write(content)
    return len(content)


def foldered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: folder (at most 100 documents each), name, hash and text."""
    files = derived(spark, sf_dir, "files").select("doc_id", "expected_hash", "computed_hash")
    texts = given(spark, sf_dir, "documents").select("doc_id", "source", "text")
    block = F.floor(F.col("doc_id") / 100).cast("string")
    return texts.join(files, "doc_id").select(
        "doc_id",
        F.concat("source", F.lit("/"), block).alias("folder"),
        F.concat(F.lit("GCA_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".1.fna")).alias("name"),
        "expected_hash",
        F.col("computed_hash").isNotNull().alias("present"),
        "text",
    )


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """Folders with data files and a checksum list each."""
    def write(root: str) -> None:
        def write_folder(rows: pd.DataFrame) -> pd.DataFrame:
            folder, size = rows["folder"].iloc[0], 0
            rows = rows.sort_values("doc_id")
            for row in rows[rows["present"]].itertuples():
                size += _save(f"{root}/{folder}/{row.name}", row.text.encode("utf-8"))
            listed = "".join(f"{row.expected_hash}  {row.name}\n" for row in rows.itertuples())
            size += _save(f"{root}/{folder}/md5sum.txt", ("# list\n" + listed).encode("utf-8"))
            return pd.DataFrame({"folder": [folder], "size": [size]})

        # A folder has at most 100 documents.
        foldered(spark, sf_dir).groupBy("folder").applyInPandas(write_folder, "folder STRING, size BIGINT").agg(
            F.sum("size")
        ).collect()

    return _once(spark, sf_dir, "tree", write)


def packages(spark: SparkSession, sf_dir: str) -> str:
    """Package archives with a checksum list of at most 100 paths each, in one of two places."""
    def write(root: str) -> None:
        def write_package(rows: pd.DataFrame) -> pd.DataFrame:
            number = int(rows["block"].iloc[0])
            lines = "".join(f"{row.hash}  {row.path}\n" for row in rows.sort_values("doc_id").itertuples())
            content = io.BytesIO()
            with zipfile.ZipFile(content, "w") as archive:
                archive.writestr("ncbi_dataset/fetch.txt", "x")
                archive.writestr("z/md5sum.txt", "bad\n")
                archive.writestr("md5sum.txt" if number % 2 else "a/md5sum.txt", lines)
            size = _save(f"{root}/package{number}.zip", content.getvalue())
            return pd.DataFrame({"size": [size]})

        paths = derived(spark, sf_dir, "paths").select(
            "doc_id", "path", F.md5("path").alias("hash"), F.floor(F.col("doc_id") / 100).alias("block")
        )
        paths.groupBy("block").applyInPandas(write_package, "size BIGINT").agg(F.sum("size")).collect()

    return _once(spark, sf_dir, "packages", write)


def flat_folder(spark: SparkSession, sf_dir: str) -> str:
    """One folder with an empty file for every document."""
    def write(root: str) -> None:
        def write_files(batches):
            for batch in batches:
                yield pd.DataFrame({"size": [_save(f"{root}/{doc_id}.fna", b"") for doc_id in batch["doc_id"]]})

        given(spark, sf_dir, "documents").select("doc_id").mapInPandas(write_files, "size BIGINT").agg(F.sum("size")).collect()

    return _once(spark, sf_dir, "flat", write)
