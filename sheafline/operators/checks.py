"""Checks of questions, filters and scopes. Failures are a status column, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

NO_STRINGS = "array<string>"


def forbidden(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + fixed.SQL_TOKENS) | text.rlike("(?i)" + fixed.PATH_TOKENS), F.lit(False))


def query_status(text: Column, most: int = 500) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "empty").when(F.length(t) > most, "too long").when(t.rlike("(?i)" + fixed.SQL_TOKENS), "forbidden tokens")
        .when(t.rlike("(?i)" + fixed.PATH_TOKENS), "path traversal").otherwise("ok")
    )


def department_words(dept: Column) -> Column:
    """Words to search for a department: those of the first entry that fits, else the input itself."""
    c = F.lower(F.trim(F.coalesce(dept, F.lit(""))))
    out = F.array(dept)
    for key, words in reversed(fixed.DEPARTMENT_WORDS):
        hit = F.lit(key).contains(c)
        for w in words:
            hit = hit | (c == w.lower()) | c.contains(w.lower())
        out = F.when(hit, F.array(*map(F.lit, words))).otherwise(out)
    return F.when(c == "", F.array().cast(NO_STRINGS)).otherwise(out)


def order_pattern(go: Column) -> Column:
    """LIKE pattern of an order filter: leading G, O and - are stripped as characters, a number of 2 to 5 digits preferred."""
    raw = F.trim(F.regexp_replace(F.trim(go), "^[GO-]+", ""))
    n = F.regexp_extract(raw, r"\b(\d{2,5})\b", 1)
    return F.when(F.trim(F.coalesce(go, F.lit(""))) != "", F.concat(F.lit("%"), F.when(n != "", n).otherwise(raw), F.lit("%")))


def query_facets(text: Column) -> Column:
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(19\d\d|20\d\d)\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1950, 2035))
    c = F.regexp_replace(F.regexp_extract(text, "(?i)" + fixed.ORDER_IN_QUERY, 1), r"^[?.!:,;\"']+|[?.!:,;\"']+$", "")
    order = F.when((F.length(c) >= 2) & c.rlike("[0-9]") & ~F.lower(c).isin(*fixed.ORDER_STOP_WORDS), c)
    return F.struct(
        X.first_match(text, fixed.QUERY_DEPARTMENTS).alias("department"), X.first_match(text, fixed.QUERY_POLICIES).alias("policy"),
        F.array_min(years).alias("year_from"), F.array_max(years).alias("year_to"), order.alias("go_number"),
    )


def departments(rows: DataFrame) -> DataFrame:
    """row_id, status, department (canonical, null if unknown or rejected) of rows (row_id, dept)."""
    names = rows.sparkSession.createDataFrame([(d, d.lower()) for d in fixed.DEPARTMENTS], "name string, low string")
    bad = forbidden(F.col("dept"))
    x = rows.join(F.broadcast(names), F.lower(F.trim("dept")) == F.col("low"), "left")
    return x.select("row_id", F.when(bad, "rejected").otherwise("ok").alias("status"), F.when(~bad, F.col("name")).alias("department"))


def categories(rows: DataFrame) -> DataFrame:
    """row_id, status, category of rows (row_id, category): allowed name, then synonym, then synonym in either direction."""
    spark = rows.sparkSession
    data = [(1, i, c.lower(), c) for i, c in enumerate(fixed.CATEGORIES)] + [(2, i, s, c) for i, (s, c) in enumerate(fixed.CATEGORY_SYNONYMS)]
    known = F.broadcast(spark.createDataFrame(data, "rule int, ord int, low string, name string"))
    c = F.lower(F.trim("category"))
    hits = rows.join(known, (c == F.col("low")) | ((F.col("rule") == 2) & (c != "") & (c.contains(F.col("low")) | F.col("low").contains(c))))
    rule = F.when(c == F.col("low"), F.col("rule")).otherwise(3)
    best = hits.groupBy("row_id").agg(F.min_by("name", F.struct(rule, "ord")).alias("name"))
    bad = forbidden(F.col("category"))
    return rows.join(best, "row_id", "left").select("row_id", F.when(bad, "rejected").otherwise("ok").alias("status"), F.when(~bad, F.col("name")).alias("category"))


def years_status(years: Column, latest: int) -> Column:
    return (
        F.when(years.isNull(), "none").when(F.size(years) != 2, "not two").when(F.array_min(years) < 1950, "too early")
        .when(F.array_max(years) > latest, "too late").when(years[0] > F.get(years, F.lit(1)), "reversed").otherwise("ok")
    )


def access(scope: Column, own: Column, asked: Column) -> Column:
    """(status, scope) of an officer's request: a department must be in scope, none asks for the whole scope."""
    s = F.when(F.coalesce(F.size(scope), F.lit(0)) <= 0, F.array(own)).otherwise(scope)
    none = F.coalesce(asked, F.lit("")) == ""
    allowed = F.array_contains(s, F.coalesce(asked, F.lit(""))) | F.array_contains(s, "ALL")
    return F.struct(F.when(~none & ~allowed, "violation").otherwise("ok").alias("status"), F.when(none, s).when(allowed, F.array(asked)).alias("scope"))


def content_boxes(boxes: Column) -> Column:
    """Boxes (x, y, w, h) above the footer; all of them if none is."""
    b = F.coalesce(boxes, F.array().cast("array<array<double>>"))
    kept = F.filter(b, lambda x: F.get(x, F.lit(1)) < 0.9)
    return F.when(F.size(kept) == 0, b).otherwise(kept)


def representative_box(boxes: Column, index: int, total: int) -> Column:
    b = content_boxes(boxes)
    at = F.least(F.floor(F.lit(index / max(total, 1)) * F.size(b)), F.size(b) - 1).cast("int")
    return F.when(F.size(b) > 0, F.get(b, at))
