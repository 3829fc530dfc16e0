"""Text functions as columns: language, n-grams, claims, ratios, dates, orders, clean-up. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

DEVANAGARI = r"[\x{0900}-\x{097F}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(text: Column, pairs: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Name of the first pattern that occurs in text, without regard to case."""
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for name, pattern in reversed(pairs):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


TOKEN = r"([\p{L}\p{M}\p{N}]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def language(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]+)\b"), F.lit(1))
    return F.when(text.rlike(DEVANAGARI), "hi").when(F.arrays_overlap(words, F.array(*map(F.lit, fixed.HINGLISH))), "hinglish").otherwise("en")


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of letters, digits, underscores and the script's block; a shorter text is its own."""

    def cut(clean: Column) -> Column:  # clean is computed once, not once for each place
        size = F.length(clean)
        parts = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(clean, i, F.lit(n)))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(clean)).otherwise(F.array_distinct(parts))

    return let(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+", ""), cut)


def recall(own: Column, other: Column) -> Column:
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def claims(text: Column) -> Column:
    """Statements of an answer: its lines without headers, JSON, preambles and negative remarks, else its sentences."""
    line_ok = lambda s: ~(
        (s == "") | s.rlike(r"^\s*[\"{}\[\]]") | s.rlike("(?i)" + fixed.JSON_KEYS) | s.startswith("#") | s.startswith("*(") | s.endswith(")*")
        | s.contains("प्रमाणित प्रशासनिक संदर्भ") | (s.contains("शासनादेश संख्या") & s.contains("के अनुसार")) | any_of(s, fixed.NEGATIVE_REMARKS)
    )
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), line_ok)
    lines = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[*\-•\d.\s]+", ""), r"[*_]", "")))
    lines = F.filter(lines, lambda s: F.length(s) >= 15)
    sentences = F.filter(
        F.transform(F.split(text, r"[।.\n]+"), lambda s: F.trim(s)),
        lambda s: (F.length(s) >= 15) & ~s.startswith("*(") & ~s.rlike(r"^\s*[\"{}\[\]]") & ~any_of(s, fixed.NEGATIVE_REMARKS[:4]),
    )
    return F.when(F.size(lines) > 0, lines).when(F.length(F.trim(text)) >= 20, sentences).otherwise(F.array().cast("array<string>"))


def any_of(s: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+(?:,\d+)?(?:\.\d+)?)\b"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def grounding(claim: Column, excerpts: Column, question: Column, least: float = 0.25, sure: float = 0.35) -> tuple[Column, Column]:
    """(recall, verdict) of a claim against excerpts: low recall fails, middling recall needs its numbers found."""
    own = grams(claim)
    r = recall(own, grams(excerpts))
    hay = F.replace(F.lower(F.concat_ws(" ", excerpts, question)), F.lit(","), F.lit(""))
    missing = F.exists(numbers(claim), lambda n: (F.length(n) >= 3) & ~hay.contains(n))
    return r, F.when(F.size(own) == 0, True).when(r < least, False).when((r < sure) & missing, False).otherwise(True)


def clean_excerpt(text: Column) -> Column:
    out = F.regexp_replace(text, r"[A-Za-z]:\\[^\n\r]+", "")
    out = F.regexp_replace(out, r"\\\\[^\s\n\r]+", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    out = F.regexp_replace(out, r"(\S)\1{4,}", "$1$1")
    out = F.regexp_replace(out, r"[~|^_`*]{3,}", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def ratio_of(text: Column, pattern: str) -> Column:
    """Share of characters other than white space that match a one-character pattern."""
    solid = squeezed(text)
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(F.regexp_count(solid, F.lit(pattern)) / F.length(solid))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, fixed.DEVANAGARI_DIGITS, fixed.ASCII_DIGITS)


def year_of(text: Column, default: int = 2018) -> Column:
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(19\d\d|20\d\d)\b", 1)
    return F.when(y == "", F.lit(default)).otherwise(y.try_cast("int"))


def date_of(text: Column) -> Column:
    """Issue date as text: day and month name, digits, else a year of this century; no calendar check."""
    t = ascii_digits(text)

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", y, m, d)

    def month(word: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, n in reversed(fixed.MONTHS):
            out = F.when(word.contains(name) | F.lit(name).contains(word), F.lit(n)).otherwise(out)
        return out

    part = lambda k: F.regexp_extract_all(t, F.lit("(?i)" + fixed.DATE_WITH_NAME), F.lit(k))
    named = F.transform(F.arrays_zip(part(1).alias("d"), part(2).alias("m"), part(3).alias("y")), lambda x: F.struct(x["d"].cast("int").alias("d"), month(x["m"]).alias("m"), x["y"].cast("int").alias("y")))
    named = F.filter(named, lambda x: x["m"].isNotNull() & x["d"].between(1, 31) & x["y"].between(1990, 2030))
    digits = F.transform(F.regexp_extract_all(t, F.lit(fixed.DATE_IN_DIGITS), F.lit(1)), lambda s: F.split(s, r"[/.\-]"))
    digits = F.transform(digits, lambda p: F.struct(p[0].cast("int").alias("d"), p[1].cast("int").alias("m"), p[2].cast("int").alias("y")))
    digits = F.filter(digits, lambda x: x["d"].between(1, 31) & x["m"].between(1, 12) & x["y"].between(1990, 2030))
    year = F.regexp_extract(F.substring(t, 1, 500), r"\b(20[0-2][0-9])\b", 1)
    one = lambda a: F.get(a, F.lit(0))
    return F.coalesce(
        F.when(F.size(named) > 0, iso(one(named)["y"], one(named)["m"], one(named)["d"])),
        F.when(F.size(digits) > 0, iso(one(digits)["y"], one(digits)["m"], one(digits)["d"])),
        F.when(year != "", F.concat(year, F.lit("-01-01"))),
    )


def clamp(score: Column) -> Column:
    """Into 0..1; missing, not a number and infinite become 0."""
    v = score.try_cast("double") if isinstance(score, Column) else score
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def as_share(value: Column, whole: Column | None = None) -> Column:
    """A confidence given as a whole percentage from 2 to 100 becomes a share; fractions stay. whole: whether the value was
    written as a whole number (by default, whether it is one)."""
    v = value.cast("double")
    whole = (v == F.floor(v)) if whole is None else whole
    return F.when(whole & (v > 1) & (v <= 100), v / 100).otherwise(v)


def clauses(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"(?=(?:^|\n)\s*(?:\(\d+\)|\d+[.\-]\s*))"), strip), lambda s: s != "")
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(parts)


def packed(units: Column, size: int) -> Column:
    """Greedy packing: units are joined by a blank line until the next would exceed size; a unit is never cut.

    The fold keeps finished chunks and the open one, so a page is packed in one pass.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    step = lambda a, u: F.when(
        (a["cur"] != "") & (F.length(a["cur"]) + F.length(u) > size), F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), u.alias("cur"))
    ).otherwise(F.struct(a["done"].alias("done"), F.when(a["cur"] == "", u).otherwise(F.concat(a["cur"], F.lit("\n\n"), u)).alias("cur")))
    return F.aggregate(units, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
