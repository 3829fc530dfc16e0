"""The thin queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, html_text, langid, mixing, near_dedup, pieces, repeats, secrets, topk, toxicity

#: Folder of the public tokenizers; another one can be named in the environment.
TOKENIZERS = os.environ.get("SHEAFLINE_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

MIX = mixing.MixSpec(
    weights={("group0",): 3.0, ("group1",): 2.0, ("group2",): 1.0, ("group0", "en"): 4.0, ("group1", "de"): 2.0, ("group2", "fr"): 2.0},
    budget_share=0.75, max_epochs=2, seed=17,
)


def mix_domain():
    """The tables name no domain; one is made of the source's number."""
    return F.concat(F.lit("group"), F.pmod(F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)), F.lit(3)).cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans_removed(table(spark, sf_dir, "documents")).drop("spans")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), near_dedup.NearSpec(words=4))


def tox_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Up to so many labels (16 bytes each) are sent to the texts; more are joined by an exchange of both.
    if labels.count() <= 2_000_000:
        marks = F.broadcast(marks)
    return docs.select("doc_id", "text").where(langid.fold(F.col("doc_id"), 5) != 0).join(marks, "doc_id").select("doc_id", "text", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(tox_labels(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model, ("doc_id",))
    return out.select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spelled(F.col("base_spans")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crf = langid.train(docs.where(langid.fold(F.col("doc_id"), 4) != 2))
    out = langid.predict(docs, crf, ("doc_id",))
    return out.select("doc_id", (langid.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, PIECE_MODEL, check="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "round_trip", "ids")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = topk.TopKSpec()
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), spec.scale)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, spec)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), mix_domain(), MIX)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
