"""Lineage of orders and confidence in what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved, sent

KNOWN = ("CURRENT_ACTIVE", "AMENDED", "SUPERSEDED", "UNKNOWN")


def confidence(passages: DataFrame, words: DataFrame) -> DataFrame:
    """passages: query_id, place (1..3), score, t (lower-cased text); words: query_id, ws."""
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"])
    g = passages.groupBy("query_id").agg(at(1, "score").alias("a"), at(2, "score").alias("b"), F.array_join(joined, " ").alias("t")).join(words, "query_id")
    margin = F.greatest(F.lit(0.0), F.col("a") - F.coalesce("b", F.col("a") / 2))
    cover = F.when(F.size("ws") == 0, F.lit(0.5)).otherwise(F.size(F.filter("ws", lambda w: F.col("t").contains(w))) / F.size("ws"))
    return g.select("query_id", F.round(0.5 * F.least(F.lit(1.0), "a") + 0.3 * F.least(F.lit(1.0), 2 * margin) + 0.2 * cover, 3).alias("confidence"))


def blend(c: Column, other: Column) -> Column:
    """Half of each of two confidences of three decimals, a half rounded up; in whole thousandths, so that no engine's
    fractions decide."""
    whole = lambda x: F.round(x * 1000).cast("long")
    return F.floor((whole(c) + whole(other) + 1) / 2) / 1000.0


def fast_path(c: Column, one_order: Column, conflict: Column) -> Column:
    """One order, no conflict and a fair score are lifted to at least 0.92."""
    return F.when(one_order & ~conflict & (c >= 0.35), F.greatest(F.lit(0.92), c)).otherwise(c)


def statuses(keys: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, status, superseded_by of each key: exact edge, then an edge whose number contains the key or is contained
    in it (smallest number first), then the document of that number, else active."""
    keys = sent(keys)
    nil = F.lit(None).cast("long")
    exact = edges.join(keys, F.col("go") == F.col("key")).select("query_id", F.lit(1).alias("rule"), "go", "status", "superseded_by")
    near = edges.join(keys, F.col("go").contains(F.col("key")) | F.col("key").contains(F.col("go"))).select("query_id", F.lit(2).alias("rule"), "go", "status", "superseded_by")
    own = docs.join(keys, F.col("go") == F.col("key")).select("query_id", F.lit(3).alias("rule"), "go", "status", nil.alias("superseded_by"))
    best = exact.union(near).union(own).groupBy("query_id").agg(F.min_by(F.struct("status", "superseded_by"), F.struct("rule", "go")).alias("x"))
    status = F.when(F.col("x.status").isin(*KNOWN), F.col("x.status")).otherwise("CURRENT_ACTIVE")
    return keys.join(best, "query_id", "left").select("query_id", status.alias("status"), F.col("x.superseded_by").alias("superseded_by"))


def closure(edges: DataFrame, most: int) -> DataFrame:
    """root, node, depth (least number of steps, up to most) by doubling: paths of up to 2^i steps are joined with
    themselves, so most = 20 takes five rounds and not twenty."""
    paths = edges.select(F.col("old").alias("root"), F.col("new").alias("node"), F.lit(1).alias("depth"))
    reach = 1
    while reach < most:
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.node") == F.col("b.root")).select("a.root", "b.node", (F.col("a.depth") + F.col("b.depth")).alias("depth")).where(F.col("depth") <= most)
        paths = paths.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        reach *= 2
        if reach < most:
            paths = saved(paths, "lineage-paths")
    return paths


def compare_versions(asked: DataFrame, cited: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, go_number, accepted, status, superseded_by of the orders asked about (query_id, go_number). A query is
    accepted if all its orders are among those cited (query_id, go_number); the others get no status."""
    marked = asked.join(cited.select("query_id", "go_number").distinct().withColumn("known", F.lit(True)), ["query_id", "go_number"], "left")
    whole = marked.groupBy("query_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("accepted"))
    keyed = asked.join(whole, "query_id").withColumn("row", F.xxhash64("query_id", "go_number"))
    found = statuses(keyed.where("accepted").select(F.col("row").alias("query_id"), F.col("go_number").alias("key")).distinct(), edges, docs).withColumnRenamed("query_id", "row")
    return keyed.join(found, "row", "left").select("query_id", "go_number", "accepted", "status", "superseded_by")
