"""Sources and sinks: document scans, keyed upserts, deletes, samples. Tables are DataFrames; a write replaces a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import sent


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf", only: str | None = None) -> DataFrame:
    """path, name, stem, length, content of the files of a folder, by one name or stem if given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "content")
    return out.where(F.lower("name").isin(only.lower()) | F.lower("stem").isin(only.lower())) if only else out


def upsert(target: DataFrame, updates: DataFrame, key: str, order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """target with the latest update of each key; columns named in keep stay as they were on rows that were there.

    One exchange: both sides are stacked and the winner of each key is taken.
    """
    names = target.columns
    both = target.select(*names, F.lit(0).alias("__new"), F.lit(None).cast("long").alias("__at")).unionByName(updates.select(*names, F.lit(1).alias("__new"), order.cast("long").alias("__at")))
    old = lambda c: F.max(F.when(F.col("__new") == 0, F.struct(c)))
    best = F.max_by(F.struct(*names), F.struct("__new", F.coalesce("__at", F.lit(0))))
    g = both.groupBy(key).agg(best.alias("b"), F.max(F.col("__new") == 0).alias("__had"), *[old(c).alias(f"__{c}") for c in keep])
    return g.select(*[F.when(F.col("__had"), F.col(f"__{c}.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in keep else F.col(f"b.{c}").alias(c) for c in names])


def delete(target: DataFrame, column: str, exact: str | None = None, contains: str | None = None) -> DataFrame:
    gone = F.lit(False)
    if exact is not None:
        gone = gone | (F.col(column) == exact)
    if contains is not None:
        gone = gone | F.col(column).contains(contains)
    return target.where(~F.coalesce(gone, F.lit(False)))


def truncate(spark: SparkSession, *paths: str) -> int:
    """Empties Parquet tables, keeping their columns; the number of tables that were there."""
    done = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
            done += 1
    return done


def checkpointed(states: DataFrame, updates: DataFrame) -> DataFrame:
    """States by thread (thread_id, seq, state): of what is stored and what comes the one of the greatest seq, so that a
    late write of an earlier state changes nothing."""
    best = states.unionByName(updates).groupBy("thread_id").agg(F.max_by(F.struct("seq", "state"), "seq").alias("x"))
    return best.select("thread_id", "x.*")


def resumed(states: DataFrame, threads: DataFrame) -> DataFrame:
    """The stored state of each asked thread, null where there is none."""
    return sent(threads).join(states, "thread_id", "left")


def highlights(asked: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked (row_id, go_number, page) with status and box: a number that is not cited is a violation; the box attached to
    the citation is taken, else that of the page's first chunk that has one, else none, which is no error."""
    known = citations.groupBy("go_number").agg(F.lit(True).alias("cited"))
    own = citations.where("box IS NOT NULL").groupBy("go_number", "page").agg(F.min("box").alias("attached"))
    first = chunks.where("box IS NOT NULL").groupBy("go_number", "page").agg(F.min_by("box", "chunk_index").alias("stored"))
    x = asked.join(known, "go_number", "left").join(own, ["go_number", "page"], "left").join(first, ["go_number", "page"], "left")
    cited = F.coalesce("cited", F.lit(False))
    return x.select("row_id", F.when(cited, "ok").otherwise("violation").alias("status"), F.when(cited, F.coalesce("attached", "stored")).alias("box"))


def titles(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", "New Query").when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("..."))).otherwise(t)


def sessions(turns: DataFrame) -> DataFrame:
    """conv_id, title, created, updated: the first title that is more than a placeholder stays."""
    x = turns.withColumn("title", titles(F.col("text")))
    placed = F.when(~F.col("title").isin("New Query", ""), F.col("turn"))
    g = x.groupBy("conv_id").agg(F.min_by("title", placed).alias("t"), F.min(placed).alias("has"), F.min("turn").alias("created"), F.max("turn").alias("updated"))
    return g.select("conv_id", F.when(F.col("has").isNotNull(), F.col("t")).otherwise("New Query").alias("title"), "created", "updated")


def resolve(wanted: DataFrame, files: DataFrame, most_wanted: int = 100_000) -> DataFrame:
    """key, path of the file that each key means: exact number, number contained, core digits, stem, then a token of
    three letters or more; the smallest path among equals. Keys without a hit have none."""
    if wanted.limit(most_wanted + 1).count() <= most_wanted:
        wanted = F.broadcast(wanted)
    clean = F.trim(F.regexp_replace(F.trim("key"), r"(?i)^(?:UK-)?(?:GO|ORDER|NOTIFICATION)[-_/\s:]*", ""))
    k = wanted.select("key", clean.alias("clean"), F.nullif(F.regexp_extract(clean, r"\b(\d{2,5})\b", 1), F.lit("")).alias("core"))
    parts = F.filter(F.split(F.col("clean"), r"[/\-_\s().]+"), lambda t: F.length(t) >= 3)
    number, stem = F.col("go"), F.lower("stem")
    hits = [
        (1, number == F.col("key")), (2, number.contains(F.col("clean"))), (3, number.contains(F.col("core"))), (4, stem.isin(F.lower("key")) | (stem == F.lower("clean"))),
        (5, F.exists(parts, lambda t: stem.contains(F.lower(t)))),
    ]
    rule = F.coalesce(*[F.when(cond, F.lit(n)) for n, cond in hits])
    found = files.join(k, F.coalesce(*[F.when(c, F.lit(True)) for _, c in hits], F.lit(False))).select("key", rule.alias("rule"), "path")
    best = found.groupBy("key").agg(F.min_by("path", F.struct("rule", "path")).alias("path"))
    return wanted.join(best, "key", "left")


def recency(at: Column, now: Column) -> Column:
    days = F.datediff(F.to_date(now), F.to_date(at))
    return F.when(days <= 0, "Today").when(days <= 1, "Yesterday").when(days <= 7, "Previous 7 Days").otherwise("Older")


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
