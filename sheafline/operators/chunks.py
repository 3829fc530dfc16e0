"""Page texts: statistics, garbage, numbers of orders, departments, boxes of clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.indic import english_words


def entropy(docs: DataFrame) -> DataFrame:
    """doc_id, entropy of the characters other than white space, counted within the row: a character occurs as often as
    taking it out makes the text shorter."""

    def total(solid: Column) -> Column:
        chars = F.filter(F.array_distinct(F.split(solid, "")), lambda c: c != "")
        counts = F.transform(chars, lambda c: (F.length(solid) - F.length(F.replace(solid, c, F.lit("")))).cast("double"))
        # H = log2 T - (1/T) sum n log2 n
        return F.log2(F.length(solid)) - F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * F.log2(n)) / F.length(solid)

    x = docs.select("doc_id", X.squeezed(F.col("text")).alias("solid")).where("solid <> ''")
    return x.select("doc_id", F.round(X.let(F.col("solid"), total), 3).alias("entropy"))


def _unmapped(text: Column) -> Column:
    """Share of the tokens that are Latin words of three letters or more but no English word."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[ ,;:.()\[\]{}\"']+|[ ,;:.()\[\]{}\"']+$", ""))
    return X.let(bare, lambda ts: F.size(F.filter(ts, lambda t: t.rlike("^[A-Za-z]{3,}$") & ~F.lower(t).isin(*english_words()))) / F.size(ts))


def garbage(text: Column) -> Column:
    """Why a text layer is no text, or "fine": too short, corrupt fragments, a little of the script among unknown Latin
    words, or mostly marks."""

    def judged(solid: Column) -> Column:
        n = F.length(solid)
        script = F.regexp_count(solid, F.lit(X.DEVANAGARI)) / n
        marks = F.regexp_count(solid, F.lit(r"[^\p{L}\p{N}\x{0900}-\x{097F}]")) / n
        hits = X.let(F.lower(text), lambda low: F.size(F.filter(F.array(*map(F.lit, fixed.MOJIBAKE)), lambda w: low.contains(w))))
        return (
            F.when(text == "", "fine").when(n < 15, "too_short")
            .otherwise(X.let(hits, lambda h: F.when((h >= 2) | ((h >= 1) & (n < 100)), "mojibake").otherwise(
                X.let(script, lambda d: F.when((d > 0) & (d < 0.35) & (_unmapped(text) > 0.4), "mixed_latin").when((d < 0.2) & (marks > 0.3), "punctuation").otherwise("fine")))))
        )

    return X.let(X.squeezed(text), judged)


def is_draft(text: Column) -> Column:
    return (F.trim(text) == "") | text.rlike(fixed.DRAFT_NUMBER) | (text.startswith("GO-") & (F.length(text) <= 4))


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"[.\-/:, ]+$", "")


# Forms of order numbers, tried in this order on the head of the first page.
ENDORSEMENT = r"(?i)संख्या\s*[:\-–—]?\s*([0-9]+(?:\s*\([0-9A-Za-z]+\))?\s*/[A-Za-z0-9()\-_/\s\x{0900}-\x{097F}]+?)\s*तद\s*(?:दिनांक|दनिांक|दनांक)"
ORDER_FORMS = [
    r"(?i)(?:शासनादेश\s*(?:संख्या|संo|सं०|सं\.)?|संख्या|संo|सं०|सं\.|पत्रांक|Letter\s*No\.?|File\s*No\.?|No\.?)\s*[:\-–—]?\s*\n?\s*([0-9]+(?:\s*\([0-9A-Za-z]+\))?\s*/[A-Za-z0-9()\-_/\s\x{0900}-\x{097F}]+)",
    r"(?i)\b([0-9]+(?:\s*\([0-9A-Za-z]+\))?\s*/[XVICM0-9()\-_/\s\x{0900}-\x{097F}]+)\b",
    r"(?i)(?:अ0?शा0?\s*पत्र\s*सं0?|अ\s*शा\s*पत्र\s*संख्या|DO\s*No\.?)\s*[:\-–—]?\s*([A-Za-z0-9/\-()._]{2,60})",
    r"([0-9]{1,5}(?:\s*\([0-9A-Za-z]+\))?[/\-][A-Za-z0-9().\-]+[/\-][0-9]{2,4}(?:[/\-][A-Za-z0-9().\-]+)?)",
    r"(?i)\bGO\s*[:\-]?\s*([0-9A-Za-z/\-_()\s]+)",
]
# Words at which a number ends, and file suffixes that are none.
CUT = r"(?i)[\n\r]|देहरादून|दिनांक|dated|date|अनुभाग|विभाग"
NO_NUMBERS = ["docx", "pdf", "null", "nil", "heri", "txt", "scan"]


def _sound(c: Column) -> Column:
    return ((c.contains("/")) | c.contains("-")) & (F.length(c) >= 4) & ~is_draft(c)


def endorsed_number(text: Column) -> Column:
    c = _tidy(F.regexp_extract(X.ascii_digits(text), ENDORSEMENT, 1))
    return F.when((c != "") & _sound(c), F.when(F.upper(c).startswith("GO-"), c).otherwise(F.concat(F.lit("GO-"), c)))


def order_number(text: Column, stem: Column | None = None) -> Column:
    """Number of an order: that of the endorsement line, else the first sound candidate by form, else the file's stem, else
    GO-UNKNOWN."""
    head = F.substring(X.ascii_digits(text), 1, 1200)
    found = [endorsed_number(text)]
    for form in ORDER_FORMS:
        cands = F.transform(F.regexp_extract_all(head, F.lit(form), F.lit(1)), lambda m: _tidy(F.trim(F.get(F.split(F.trim(m), CUT), F.lit(0)))))
        ok = F.filter(cands, lambda c: _sound(c) & ~F.lower(c).isin(*NO_NUMBERS))
        one = F.get(ok, F.lit(0))
        found.append(F.when(F.size(ok) > 0, F.when(F.upper(one).startswith("GO-"), one).otherwise(F.concat(F.lit("GO-"), one))))
    if stem is not None:
        found.append(F.when(stem != "", F.concat(F.lit("GO-"), F.regexp_replace(stem, r"[^0-9A-Za-z\-_]", ""))))
    return F.coalesce(*found, F.lit("GO-UNKNOWN"))


def department(text: Column) -> Column:
    """Section or department named in a header: a known one with its number, else by pattern, else the general one."""
    named = F.regexp_extract(text, fixed.SECTION_NAMES, 1)
    tidy = F.regexp_replace(F.trim(F.regexp_replace(named, r"\s*[/\\]+.*$", "")), r"[ :\-–—/\\,]+$", "")
    return F.when(text.rlike(fixed.SECTION_NAMES), tidy).otherwise(X.first_match(text, fixed.CANONICAL_DEPARTMENTS, F.lit("सामान्य")))


def metadata(pages: DataFrame) -> DataFrame:
    """doc, go_number, department, issued: the last endorsement, else page 1; first department and date found."""
    x = pages.select("doc", "page", endorsed_number(F.col("t")).alias("e"), order_number(F.col("t")).alias("o"), department(F.col("t")).alias("d"), X.date_of(F.col("t")).alias("issued"))
    at = lambda c: F.when(c.isNotNull(), F.col("page"))
    known = F.when(F.col("d") != "सामान्य", F.col("d"))
    g = x.groupBy("doc").agg(F.max_by("e", at(F.col("e"))).alias("e"), F.max(at(F.col("e"))).alias("has"), F.min_by("o", "page").alias("o"), F.min_by("d", at(known)).alias("d"), F.min(at(known)).alias("named"), F.min_by("issued", at(F.col("issued"))).alias("i"), F.min(at(F.col("issued"))).alias("dated"))
    return g.select("doc", F.when(F.col("has").isNotNull(), F.col("e")).otherwise(F.col("o")).alias("go_number"), F.when(F.col("named").isNotNull(), F.col("d")).otherwise("सामान्य").alias("department"), F.when(F.col("dated").isNotNull(), F.col("i")).alias("issued"))


def without_table_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~(F.trim(s).startswith("|") & F.trim(s).endswith("|"))), "\n")


def clause_box(chars: Column, index: Column, total: Column) -> Column:
    """(ymin, ymax) of a clause on its page, from its place among the clauses and its length."""
    step = F.lit(0.8) / total
    ymin = F.greatest(F.lit(0.08), F.least(F.lit(0.08) + index * F.lit(0.8) / total, F.lit(0.82)))
    height = F.greatest(F.lit(1), F.floor(chars / 75)) * 0.032
    return F.struct(F.round(ymin, 4).alias("ymin"), F.round(F.least(ymin + F.greatest(height, step * 0.85), F.lit(0.92)), 4).alias("ymax"))
