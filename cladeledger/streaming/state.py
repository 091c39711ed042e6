"""What the streams share: sources, Spark's state store, and rows that pass through Python unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Their nullable values would become floats in pandas.
_AS_TEXT = ("tinyint", "smallint", "int", "bigint", "boolean", "decimal", "date", "timestamp")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond an executor's heap needs the RocksDB store; operators with state of their own insist on it."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_of(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def checkpoint_of(path: str) -> str:
    """The checkpoint of the stream that writes below ``path``; its place ties the two together."""
    return f"{path.rstrip('/')}/_checkpoint"


def as_text(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df``, with numbers, dates and flags as text, which Python hands back exactly."""
    return [
        F.col(name).cast("string").alias(name) if kind.startswith(_AS_TEXT) and name not in but else F.col(name)
        for name, kind in df.dtypes
    ]

