"""Where jobs may write: the folder that every executor of the session can reach."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only for a local session without one."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="groundswell-")
    return _local_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/groundswell/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> str:
    """Write `df` as a table in the shared folder; returns its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`store` and read back.

    Cuts the lineage where a result feeds several branches, survives lost
    executors, and keeps column pruning for the readers.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="groundswell-ship-"), "groundswell")
    context.addPyFile(shutil.make_archive(base, "zip", root, "groundswell"))
    _shipped.add(context.applicationId)


def parallelism(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes but much work, which adaptive coalescing would join into one task."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def by_value() -> Iterator[None]:
    """Functions and classes of this package that are given to Spark inside are sent with their code.

    State processors are also loaded by a helper of the driver that does not see shipped files.
    """
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)
