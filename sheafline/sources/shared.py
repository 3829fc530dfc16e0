"""Intermediate results in the folder that all executors share, and sides of joins that are sent only if small."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}  # temporary folders of local masters by application
#: Rows of a few words each that may be sent to every task.
MOST_SENT = 200_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without one uses a temporary folder, a cluster has none that all nodes see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        found = _LOCAL[key] = _LOCAL.get(key) or tempfile.mkdtemp(prefix="sheafline-")
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, its lineage cut, lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, for an exchange."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows per Arrow batch for the jobs run inside; the session's value is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
