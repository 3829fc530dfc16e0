"""Reducers of session state as batch folds, and other folds over ordered updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def immutable(log: DataFrame) -> DataFrame:
    """session, field, value, violated: the first value stays; another one later is a violation."""
    v = log.where("value IS NOT NULL AND value <> ''")
    return v.groupBy("session", "field").agg(F.min_by("value", "seq").alias("value"), (F.count_distinct("value") > 1).alias("violated"))


def appended(log: DataFrame) -> DataFrame:
    """session, field, items in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return log.where("value IS NOT NULL").groupBy("session", "field").agg(items.alias("items"))


def merged(log: DataFrame) -> DataFrame:
    """session, field, value, place: one row per key, the latest item at the place of the first."""
    g = log.groupBy("session", "field").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("first"))).drop("first")


def last(log: DataFrame) -> DataFrame:
    """session, field, value: the latest that is not null; empty values do overwrite."""
    return log.where("value IS NOT NULL").groupBy("session", "field").agg(F.max_by("value", "seq").alias("value"))


def breaker(log: DataFrame, threshold: int = 3) -> DataFrame:
    """session, seq, state of a breaker after each operation: open from the first run of so many failures; a success
    closes it, but operations are refused while it is open, so it never does."""
    w = Window.partitionBy("session").orderBy("seq")
    x = log.withColumn("run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    x = x.withColumn("streak", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("session", "run").orderBy("seq")))
    return x.select("session", "seq", F.when(F.max("streak").over(w) >= threshold, "OPEN").otherwise("CLOSED").alias("state"))
