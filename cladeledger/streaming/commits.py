"""Manifest commits as a stream: a keyed merge into a table bucketed by file name (ST-1).

The manifest is a Spark table of its own folder, partitioned by micro-batch and bucketed by file name. Its rows are only
ever added, so a batch joins the rows of earlier batches, bucket by bucket and without moving them, and overwrites
its own partition; one that runs again after a failure gives the same files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeledger.operators.manifest import judge_batches
from cladeledger.streaming.state import checkpoint_of
from cladeledger.workspace import make_folder, materialize, run_folder

MANIFEST_COLUMNS = "filename STRING, expected_md5 STRING, accession STRING, batch_num BIGINT, batch_id BIGINT"
BUCKETS = 64


def manifest_table(spark: SparkSession, path: str) -> str:
    """The name of the manifest table below ``path``, made known to the session's catalogue with all its partitions."""
    name = f"manifest_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"
    place = f"{path.rstrip('/')}/manifest".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({MANIFEST_COLUMNS}) USING parquet PARTITIONED BY (batch_id)"
        f" CLUSTERED BY (filename) INTO {BUCKETS} BUCKETS LOCATION '{place}'"
    )
    make_folder(spark, f"{path.rstrip('/')}/manifest")
    spark.catalog.recoverPartitions(name)
    return name


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that ``commit_artifacts`` keeps below ``path``."""
    return spark.table(manifest_table(spark, path)).drop("batch_id")


def commit_artifacts(artifacts: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Merge finished download batches into a manifest (ST-1).

    ``artifacts``: batch_num, accession, filename, expected_md5. New rows go to the manifest; rows of batches with
    a conflicting hash go to ``conflicts``; last, the accessions of good batches are marked below ``completed``. The
    checkpoint is kept below ``path`` as well, so no other stream can take the place of the first one's batches.
    """
    spark = artifacts.sparkSession
    name = manifest_table(spark, path)

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        with run_folder(spark):
            batch = materialize(batch, "batch")
            known = spark.table(name).filter(F.col("batch_id") < batch_id)
            judged = materialize(judge_batches(known, batch), "judged")
            good = judged.filter("batch_ok")
            # One source row per name, so that accession and batch belong together.
            row = F.struct("batch_num", "accession", "expected_md5")
            inserts = good.filter("old_md5 IS NULL").groupBy("filename").agg(F.min(row).alias("row"))
            inserts = inserts.select("filename", "row.expected_md5", "row.accession", "row.batch_num", F.lit(batch_id).cast("bigint").alias("batch_id"))
            inserts.repartition(min(BUCKETS, max(1, batch.rdd.getNumPartitions())), "filename").write.insertInto(name, overwrite=True)
            _write(judged.filter("conflict").drop("conflict", "batch_ok"), f"{path}/conflicts", batch_id)
            _write(good.select("accession").distinct(), f"{path}/completed", batch_id)

    return artifacts.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint_of(path)).trigger(**trigger).start()


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows appended so far below ``path``."""
    return spark.read.parquet(path).drop("batch_id")
