"""Relations that several queries share, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

CORPUS_SQL = """(SELECT d.doc_id AS id, d.text, d.lang, d.source AS department, CAST(2000 + d.doc_id % 25 AS INTEGER) AS year, d.n_chars,
  CASE WHEN d.doc_id % 7 = 0 THEN 'SUPERSEDED' WHEN d.doc_id % 11 = 0 THEN 'AMENDED' ELSE 'CURRENT_ACTIVE' END AS status, e.embedding,
  'GO-' || d.doc_id || '/XX/' || CAST(2000 + d.doc_id % 25 AS VARCHAR) AS go_number
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def go_number():
    return F.concat(F.lit("GO-"), F.col("doc_id").cast("string"), F.lit("/XX/"), (2000 + F.col("doc_id") % 25).cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with derived facets and their vectors."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    status = F.when(F.col("doc_id") % 7 == 0, "SUPERSEDED").when(F.col("doc_id") % 11 == 0, "AMENDED").otherwise("CURRENT_ACTIVE")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("department"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), "n_chars",
        status.alias("status"), "embedding", go_number().alias("go_number"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without vectors: a scan without a join."""
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "SUPERSEDED").when(F.col("doc_id") % 11 == 0, "AMENDED").otherwise("CURRENT_ACTIVE")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("department"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), "n_chars", status.alias("status"), go_number().alias("go_number"))


QUERIES_SQL = """(SELECT b.item_id AS query_id, lower(b.text) AS query_text, e.embedding,
  'src' || CAST(b.item_id % 20 AS VARCHAR) AS department FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows as queries: the whole text, the vector of the same number, a department."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return b.join(e, b.item_id == e.vec_id).select(
        F.col("item_id").alias("query_id"), F.lower("text").alias("query_text"), "embedding", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("department"),
    )


PHRASES_SQL = """(SELECT item_id AS query_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[\\p{L}]+'), 1 + CAST(item_id % 3 AS INTEGER), 2 + CAST(item_id % 3 AS INTEGER)), ' ') AS query_text FROM benchmark)"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two words, which many texts hold apart."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1 + (F.col("item_id") % 3).cast("int"), F.lit(2)), " ").alias("query_text"))


LINEAGE_SQL = """(SELECT doc_id AS old, doc_id + 7 AS new, CASE WHEN doc_id % 2 = 0 THEN 'SUPERSEDED' ELSE 'AMENDED' END AS status FROM documents
  WHERE doc_id % 7 = 0 AND doc_id + 7 <= (SELECT max(doc_id) FROM documents))"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from an order to the one that replaces it."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    most = d.agg(F.max("doc_id").alias("most"))
    e = d.where("doc_id % 7 = 0").join(F.broadcast(most), F.col("doc_id") + 7 <= F.col("most"))
    return e.select(F.col("doc_id").alias("old"), (F.col("doc_id") + 7).alias("new"), F.when(F.col("doc_id") % 2 == 0, "SUPERSEDED").otherwise("AMENDED").alias("status"))
