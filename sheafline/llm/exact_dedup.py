"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: (digest, keep_id, n, batch). New documents are digested,
collapsed to one row per digest (a map-side combine, so a text repeated by a third of all rows is a handful of rows before
any shuffle), deduplicated by a sort-merge anti-join against the index and appended. Counts of digests that are already
there are appended as further rows with the keep_id on record, so reading sums n and takes the first keep_id. A batch has a
name: appending it again, after a failed or a lost write, changes nothing, as reading counts each batch of a digest once.
The number of buckets is set from the size of the first batch and kept in a file beside the table.

Cases. Null text counts as empty; all empty texts are equal. Rows that repeat a doc_id count in group_size and share its
fate as far as their texts are equal; rows with one doc_id and different texts are different documents. A null doc_id is
kept only if no row of the group has one. An empty table gives an empty result. Columns of the input other than doc_id and
text are ignored by ``classify`` and returned unchanged by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, materialise, read_text, remove, scratch, without, write_text

INDEX_SCHEMA = "digest STRING, keep_id BIGINT, n BIGINT, batch STRING"
ROWS_PER_BUCKET = 1_000_000  # some 80 MB of digests
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WS, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A digest table at a path: ``DigestIndex(spark, path)`` opens it, making it if absent. buckets counts only then; by
    default eight, or what ``buckets_for`` gives for the first batch's rows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path = spark, path
        known = read_text(spark, f"{path}/_buckets")
        self.buckets = int(known) if known else buckets
        if not known:
            write_text(spark, f"{path}/_buckets", str(buckets))
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_SCHEMA}) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        """One row per digest; the bucketing makes these aggregations free of a shuffle."""
        once = self.spark.table(self.table).groupBy("digest", "batch").agg(F.min("keep_id").alias("keep_id"), F.max("n").alias("n"))
        return once.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def append(self, grouped: DataFrame) -> None:
        (
            grouped.select("digest", "keep_id", "n", "batch").repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def absorb(self, digested: DataFrame, batch: str | None = None) -> None:
        """Add a batch (doc_id, digest): a digest's first batch decides its keep_id for good. A batch absorbed again under
        its name changes nothing."""
        name = F.lit(batch or uuid.uuid4().hex)
        rows = digested.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        rows = materialise(rows.withColumn("batch", name), "digest-batch")
        known = self.read().select("digest", F.col("keep_id").alias("known_id"))
        fresh = rows.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), "n", "batch")
        again = rows.join(known.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), "n", "batch")
        # Both read the index as it was: the append is planned and written as one job.
        self.append(fresh.unionByName(again))

    def close(self, delete: bool = False) -> None:
        """Forget the table's name; its files stay unless delete."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if delete:
            remove(self.spark, self.path)


def buckets_for(rows: int) -> int:
    return max(8, 1 << max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length())


def classify(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, after adding docs to the index as a batch.

    Without an index one is made in the shared folder, sized by the rows, and removed.
    """
    spark = docs.sparkSession
    digested = materialise(docs.select(F.col("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    own = None if index else DigestIndex(spark, scratch(spark, "digest-index"), buckets_for(digested.count()))
    index = index or own
    index.absorb(digested, batch)
    # A hot digest makes the left side uneven. Both sides are written tables and exchanged for this join alone, so
    # adaptive execution splits it.
    grouped = materialise(index.read(), "digest-groups")
    if own:
        own.close(delete=True)
    return digested.join(grouped, "digest", "left").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows whose text an earlier document (smaller doc_id) has; of rows that repeat id and text one stays.

    Texts stay in place while few rows go or repeat: then ids and digests are sent to them.
    """
    marked = materialise(classify(docs, index), "marked")
    keys = {"doc_id": F.col("doc_id"), "text_sha256": text_digest(F.col("text"))}
    left = without(docs, marked.where("NOT kept").select(*keys).distinct(), keys, BROADCAST_ROWS)
    repeated = materialise(marked.where("kept").groupBy(*keys).count().where("count > 1").select(*keys), "repeated-rows")
    if repeated.isEmpty():
        return left
    tag = uuid.uuid4().hex[:8]
    named = left.withColumn(f"digest_{tag}", keys["text_sha256"])
    own = repeated.select(*[F.col(k).alias(f"{k}_{tag}") for k in keys])
    same = F.col("doc_id").eqNullSafe(F.col(f"doc_id_{tag}")) & (F.col(f"digest_{tag}") == F.col(f"text_sha256_{tag}"))
    one = named.join(own, same, "left_semi").dropDuplicates(["doc_id", f"digest_{tag}"]).drop(f"digest_{tag}")
    return without(left, repeated, keys, BROADCAST_ROWS).unionByName(one)
