"""A training corpus from ``documents``: toxicity, exact copies, near copies, mixture, piece ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

* toxicity: documents scored 0.5 or more go; the model learns from the labelled documents outside the held-out fold.
* exact dedup: of equal texts (white space made single) the one with the smallest doc_id stays.
* near dedup: of documents linked by five-word shingles at a similarity of 0.8 or more the smallest doc_id stays.
* mixture: domains, languages and sources are brought to the target weights; an epoch repeats rows.
* pieces: doc_id, lang, source, n_pieces and the piece ids of each text.

An empty table passes through; nulls are treated as each operator states. Extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import exact_dedup, mixing, near_dedup, pieces, queries, toxicity
from sheafline.llm.common import materialise, small_batches

#: A name that no table has.
SCORE = "score_3f1c9a5e"
#: The pipeline keeps all tokens that the weights allow within two epochs.
PIPELINE_MIX = mixing.MixSpec(weights=queries.MIX.weights, budget_share=0.9, max_epochs=2, seed=queries.MIX.seed)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.learn(queries.tox_labels(docs, queries.table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, None, SCORE)
    return scored.where(F.col(SCORE) < 0.5).drop(SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, near_dedup.NearSpec(words=5))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, queries.mix_domain(), PIPELINE_MIX)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), queries.PIECE_MODEL)
    return out.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixture", mixture_stage),
    ("pieces", pieces_stage),
]

#: Levenshtein automata, min-max hashing and piece lattices have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
