"""Answers and replies: unwrapping, cleaning, summaries, delivery, routing, refusal, alignment of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def reply_json(reply: Column) -> Column:
    """The JSON object of a reply as text: the fenced one, else the first with one level of nesting; null if none parses."""
    fenced = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{(?:[^{}]|(?:\{[^{}]*\}))*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(bare)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def unwrapped(reply: Column) -> Column:
    """The text of an answer that may be wrapped in JSON or a fence."""
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"(?m)^```(?:json|markdown)?\s*|\s*```$", ""))
    j = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    named = [F.nullif(F.trim(F.get_json_object(j, f"$.{k}")), F.lit("")) for k in fixed.ANSWER_KEYS]
    ok = (j != "") & F.try_parse_json(j).isNotNull()
    return F.when(ok, F.coalesce(*named, t)).otherwise(t)


def without_chatter(reply: Column) -> Column:
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    t = blank(F.regexp_replace(reply, "@+", ""))
    t = blank(F.regexp_replace(t, r"(?i)^(?:Here is the (?:extracted |markdown |verbatim )?text[^\n]*\n+|Sure,?[^\n]*\n+|Certainly,?[^\n]*\n+)", ""))
    t = blank(F.regexp_replace(t, r"(?i)\n+(?:Let me know if you need anything else|I hope this helps|Note: The above text is extracted)[^\n]*$", ""))
    inner = F.regexp_extract(t, r"(?s)^```(?:markdown|text)?\s*\n(.*)\n```$", 1)
    return F.when(inner != "", blank(inner)).otherwise(t)


def _listed(reply: Column) -> Column:
    """The text of a reply that is a list of parts."""
    t = F.trim(F.coalesce(reply, F.lit("")))
    part = F.get_json_object(F.when(t.startswith("[{'type': 'text'"), F.regexp_replace(t, "'", '"')).otherwise(t), "$[0].text")
    return F.when(t.rlike(r"""^\[\{['"]type['"]: ['"]text['"]"""), F.coalesce(part, t)).otherwise(F.coalesce(reply, F.lit("")))


def header(reply: Column) -> Column:
    """(go_number, page_text, draft) of a reply with a metadata object, fenced or whole: the page's text is the object's,
    else what stands round it, else its own entries line by line, else the reply."""

    def read(t: Column) -> Column:
        block = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
        fenced = F.regexp_extract(t, block, 1)
        whole = F.when(F.trim(t).startswith("{") & F.trim(t).endswith("}"), F.trim(t))
        j = F.coalesce(F.nullif(fenced, F.lit("")), whole)
        rest = F.when(fenced != "", F.trim(F.regexp_replace(t, block, ""))).when(whole.isNotNull(), "").otherwise(t)
        j = F.when(F.try_parse_json(j).isNotNull(), j)
        go = F.coalesce(F.get_json_object(j, "$.go_number"), F.lit(""))
        said = F.get_json_object(j, "$.is_draft_placeholder").try_cast("boolean")
        entries = F.from_json(j, "map<string,string>")
        lines = F.transform(F.filter(F.map_entries(entries), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (e["key"] != "page_text") & (e["value"] != "false")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        text = F.coalesce(F.nullif(F.trim(F.get_json_object(j, "$.page_text")), F.lit("")), F.nullif(F.trim(rest), F.lit("")), F.nullif(F.array_join(lines, "\n"), F.lit("")), F.trim(t))
        return F.struct(go.alias("go_number"), text.alias("page_text"), F.coalesce(said, (go == "") | go.rlike(fixed.DRAFT_NUMBER)).alias("draft"))

    return F.get(F.transform(F.array(_listed(reply)), read), F.lit(0))


def or_blank(text: Column, least: int = 30) -> Column:
    """Pages with fewer meaningful characters are blank."""
    return F.when(F.length(F.regexp_replace(text, r"[\s\-_=@~|`#*]", "")) < least, "").otherwise(text)


def summary(text: Column, lines: int = 3, chars: int = 180) -> Column:
    kept = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 10), 1, lines)
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("- **"), F.substring(s, 1, chars))), "\n")


def with_tokens(search: Column, question: Column) -> Column:
    """search with every vital token of the question that it lacks appended, in order."""
    vital = F.regexp_extract_all(question, F.lit(r"([\x{0900}-\x{097F}]{2,}|\b\d+\b|[A-Za-z0-9\-()/]{3,})"), F.lit(1))
    return F.aggregate(vital, search, lambda s, t: F.when(s.contains(t), s).otherwise(F.trim(F.concat(s, F.lit(" "), t))))


def deliverable(text: Column, confidence: Column, cited: Column) -> Column:
    return (F.length(text) > 20) & ((confidence >= 0.85) | cited)


def refusals(errors: DataFrame) -> DataFrame:
    """session, template: the newest denial or injection decides, else the oldest record that names a category."""
    tpl = F.when(F.col("kind").isin("HumanVerificationDenied", "PromptInjectionDetected"), F.col("kind"))
    for c, _ in fixed.SCOPE:
        tpl = tpl.when(F.lower("message").contains(c) | F.lower("kind").contains(c), F.lit(c))
    stop = F.when(F.col("kind").isin("HumanVerificationDenied", "PromptInjectionDetected"), F.col("seq"))
    x = errors.withColumn("tpl", tpl)
    g = x.groupBy("session").agg(F.max_by("tpl", stop).alias("stopped"), F.max(stop).alias("at"), F.min_by("tpl", F.when(F.col("tpl").isNotNull(), F.col("seq"))).alias("oldest"))
    return g.select("session", F.coalesce(F.when(F.col("at").isNotNull(), F.col("stopped")), "oldest", F.lit("default")).alias("template"))


ROUTES = {
    "route_scope": lambda: F.when(F.col("refusal"), "refusal_redirect").otherwise("retrieval_invocation"),
    "route_confidence": lambda: F.when((F.col("confidence") < 0.85) | (F.col("conflicts") > 0), "human_verification_interrupt").otherwise("grounded_synthesis"),
    "route_human": lambda: F.when(~F.col("refusal") & F.coalesce(F.col("action").isin("approve", "approve_with_edit"), F.lit(False)), "grounded_synthesis").otherwise("refusal_redirect"),
    "route_integrity": lambda: F.when(F.col("refusal"), "refusal_redirect")
    .when((F.col("last") == "CitationIntegrityFailure") & (F.col("failures") < 2), "grounded_synthesis")
    .when(F.col("last") == "CitationIntegrityFailure", "refusal_redirect")
    .otherwise("response_delivery"),
}


def aligned(cites: DataFrame, passages: DataFrame) -> DataFrame:
    """cite_id, pos: same order and page, then most shared keywords, then same order, then the first passage."""
    held = lambda c: F.filter(F.array(*map(F.lit, fixed.CITATION_WORDS)), lambda w: F.lower(F.col(c)).contains(w))
    c, p = cites.withColumn("own", held("excerpt")), passages.withColumn("own", held("excerpt"))
    rule = lambda n, s: (F.lit(n).alias("rule"), s.alias("s"), "pos")
    exact = c.select("cite_id", "go", "page").join(p.select("go", "page", "pos"), ["go", "page"]).select("cite_id", *rule(1, F.lit(0)))
    order = c.select("cite_id", "go").join(p.groupBy("go").agg(F.min("pos").alias("pos")), "go").select("cite_id", *rule(3, F.lit(0)))
    # A passage counts by which of the few keywords it holds, so the first passage of each combination stands for all.
    kinds = p.where(F.size("own") > 0).groupBy(F.col("own").alias("theirs")).agg(F.min("pos").alias("pos"))
    asked = c.where(F.size("own") > 0).select("own").distinct()
    shared = F.size(F.array_intersect("own", "theirs")) * 5
    best = asked.join(F.broadcast(kinds), F.arrays_overlap("own", "theirs")).groupBy("own").agg(F.min(F.struct((-shared).alias("s"), "pos")).alias("x"))
    words = c.select("cite_id", "own").join(best, "own").select("cite_id", F.lit(2).alias("rule"), "x.s", "x.pos")
    first = cites.select("cite_id").join(F.broadcast(passages.agg(F.min("pos").alias("pos"))), F.lit(True)).select("cite_id", *rule(4, F.lit(0)))
    return exact.union(words).union(order).union(first).groupBy("cite_id").agg(F.min_by("pos", F.struct("rule", "s", "pos")).alias("pos"))
