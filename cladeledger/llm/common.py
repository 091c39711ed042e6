"""What the operators of this package share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to meet a column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def with_key(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """``docs`` and two columns that tell its rows apart: the id as long and a hash of the text."""
    return docs.withColumns({doc: F.col("doc_id").cast("bigint"), key: F.xxhash64(F.coalesce("text", F.lit("")))})


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; other columns go, whatever their names."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Send ``value`` to the executors once; the function returned gives a task its copy.

    It travels by value, as the tasks' own functions do, so executors need no copy of this package.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
