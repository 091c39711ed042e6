"""Session settings and the shared folder for tables that cut lineage between steps.

Steps live in the folder named by ``spark.checkpoint.dir``, below one folder per run. ``run_folder`` owns one and
removes it at its end; a micro-batch has one of its own. Without an owner, the steps of an application share a
folder that goes when the Python process ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owned: ContextVar[str | None] = ContextVar("owned", default=None)
_application_folders: dict[str, str] = {}


def session(app_name: str = "cladeledger", **settings: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; any setting can be overridden."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local master without one uses the session's warehouse folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


def make_folder(spark: SparkSession, path: str) -> None:
    """Make the folder if there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all steps made inside; it is removed at the end, so results must be written before."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _owned.set(path)
    try:
        yield path
    finally:
        _owned.reset(token)
        remove_folder(spark, path)


def _application_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    key = f"{context.applicationId} {shared_folder(spark)}"
    if key not in _application_folders:
        path = f"{shared_folder(spark)}/app-{context.applicationId}"
        _application_folders[key] = path
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        # Kept from now on, as the session may be stopped before the process ends.
        system = place.getFileSystem(context._jsc.hadoopConfiguration())
        atexit.register(_remove_quietly, system, place)
    return _application_folders[key]


def _remove_quietly(system, place) -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        system.delete(place, True)
    except (Py4JError, Py4JNetworkError, OSError):
        pass  # the JVM has gone first; whoever ended it clears the shared folder


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the folder of the run."""
    return f"{_owned.get() or _application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so later steps neither recompute nor depend on it.

    The files survive lost executors, and their sizes let the optimizer choose join strategies.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
