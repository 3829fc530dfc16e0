"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it; bytes.split() without arguments splits on exactly these.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}  # temporary folders of local masters by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master uses a temporary folder of
    its own; a cluster has no folder that every node sees, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="sheafline-")
        _LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheafline_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    raw = bytes(b & 255 for b in iter(stream.read, -1))
    stream.close()
    return raw.decode()


def discard(*frames: DataFrame) -> None:
    """Remove what materialise() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_sheafline_path", None)
        if path:
            remove(df.sparkSession, path)


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], most: int) -> DataFrame:
    """docs less the rows whose keys (column of gone: expression over docs; null equals null) are in gone. Up to most rows
    of gone are sent to the texts, which then stay in place; more are joined by an exchange of both."""
    tag = uuid.uuid4().hex[:8]
    own = gone.select(*[F.col(k).alias(f"{k}_{tag}") for k in keys])
    same = F.lit(True)
    for k, column in keys.items():
        same = same & column.eqNullSafe(F.col(f"{k}_{tag}"))
    return docs.join(F.broadcast(own) if own.count() <= most else own, same, "left_anti")


def hash_sample(df: DataFrame, n: int, key: str = "doc_id", by: str | None = None) -> DataFrame:
    """About n rows (all, if fewer) by a hash of the key, or about n of each value of by: a filter, so that no task and
    not the driver gathers more. The key should differ between copies, so that one much-copied row is not all or nothing."""
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    if by is None:
        most = [(F.lit(True), df.count())]
    else:
        most = [(F.col(by).eqNullSafe(F.lit(r[by])), r["n"]) for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()]
    keep = F.lit(False)
    for own, rows in most:
        keep = keep | (own & (cell < int((1 << 30) * min(1.0, n / max(1, rows)))))
    return df.where(keep)


@contextmanager
def lean(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """At most so many rows per Arrow batch for the jobs run inside: batches of whole texts or sets otherwise take tens of MB
    in the executor and again in its Python worker. The session's value is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications (queries, pipelines) that hand on results which Python has still to compute: the session's Arrow
    batches hold few rows from here on, if it has the default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def chunks_of(batches, column: str, most_bytes: int = 2_000_000):
    """Slices of Arrow batches holding about most_bytes of the string column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        total = sizes.cumsum()
        first = 0
        while first < len(sizes):
            base = total[first - 1] if first else 0
            last = max(first + 1, int(total.searchsorted(base + most_bytes, side="right")))
            yield batch.slice(first, last - first)
            first = last
