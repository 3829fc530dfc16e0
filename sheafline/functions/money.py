"""Money amounts in mixed notation as exact decimals, and the table checks built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, ascii_digits, let

DECIMAL = "decimal(38,6)"


def parse_money(text: Column, factor: Column | None = None) -> Column:
    """Amount of a cell, null if it has no number. A scale word in the cell replaces the table's factor."""
    return let(let(let(tidy(text), lambda t: F.struct(t.alias("t"), is_negative(t).alias("negative"))), lambda x: scaled_rest(x["t"], x["negative"], factor)), value_of)


def tidy(text: Column) -> Column:
    return F.lower(F.trim(F.when(text.rlike(f"[{fixed.DEVANAGARI_DIGITS}]"), ascii_digits(text)).otherwise(text)))


def is_negative(t: Column) -> Column:
    return (t.startswith("(") & t.rlike(r"^\(.*\)$")) | t.startswith("-")


def scaled_rest(t: Column, negative: Column, factor: Column | None = None) -> Column:
    """(scale, rest, negative): the factor of the first scale word contained and the text without the word and the signs."""

    def scaled(bare: Column) -> Column:
        made = lambda scale, rest: F.struct(scale.cast("decimal(20,0)").alias("scale"), rest.alias("rest"), negative.alias("negative"))
        out = made(F.lit(1) if factor is None else factor, bare)
        for word, value in reversed(fixed.SCALES):
            out = F.when(bare.contains(word), made(F.lit(value), F.trim(F.replace(bare, F.lit(word), F.lit(""))))).otherwise(out)
        return out

    return F.when(negative, let(F.regexp_replace(t, r"^[()\- ]+|[()\- ]+$", ""), scaled)).otherwise(scaled(t))


def value_of(x: Column) -> Column:
    plain = F.regexp_replace(x["rest"], r"[₹$£€]|rs\.?|inr|[,/\-'\"\s]", "")
    number = F.nullif(F.regexp_extract(plain, r"([-+]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("decimal(18,6)")
    return (F.when(x["negative"], -F.abs(number)).otherwise(number) * x["scale"]).cast(DECIMAL)


def with_amount(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with ``parse_money`` of a column, step by step: each step is compiled and computed once a row, which the
    functions on arrays behind ``let`` are not."""
    x = rows.withColumn("_t", tidy(F.col(text))).withColumn("_negative", is_negative(F.col("_t")))
    x = x.withColumn("_plain", F.col("_t").rlike(r"^\d{1,12}(?:\.\d{1,6})?$"))  # such a text is its own amount
    x = x.withColumn("_x", F.when(~F.col("_plain"), scaled_rest(F.col("_t"), F.col("_negative"))))
    v = F.when(F.col("_plain"), F.col("_t").try_cast("decimal(18,6)").cast(DECIMAL)).otherwise(value_of(F.col("_x")))
    return x.withColumn(name, v).drop("_t", "_negative", "_plain", "_x")


def scale_of(header: Column) -> tuple[Column, Column]:
    """(factor, unit) named in a table's header. What every spelling of a scale holds is looked for first: patterns with
    Unicode boundaries are dear, and few texts name a scale."""
    factor, unit = F.lit(1).cast("long"), F.lit(None).cast("string")
    low = F.lower(header)
    for (words, value, name), parts in zip(reversed(fixed.HEADER_SCALES), reversed(fixed.HEADER_SCALE_PARTS), strict=True):
        hit = any_of(low, parts) & low.rlike(f"(?iU)(?:{words})\\b")
        factor, unit = F.when(hit, F.lit(value).cast("long")).otherwise(factor), F.when(hit, F.lit(name)).otherwise(unit)
    return factor, unit


def is_total(text: Column) -> Column:
    return any_of(F.lower(F.trim(text)), fixed.TOTAL_WORDS)


def role_of(header: Column) -> Column:
    h = F.lower(header)
    return F.when(any_of(h, fixed.SANCTIONED), "sanctioned").when(any_of(h, fixed.SPENT), "spent").when(any_of(h, fixed.BALANCE), "balance")
