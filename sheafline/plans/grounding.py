"""Queries of grounding, answers, routing and refusal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import answers as A
from .registry import Fixture, literal, query, table

ANSWER = Fixture("row_id int, answer string, excerpt string, question string", [
    (1, "# Title\n- The officer may sanction up to 50,000 rupees per year.\n* Transfers are allowed after three years.", "The officer may sanction up to 50,000 rupees per year. Transfers are allowed after three years of service.", "sanction limit"),
    (2, "- The officer may sanction 75,000 rupees.\n- Quantum flux zeppelins vanish by Tuesday 99,123.", "The officer may sanction up to 50,000 rupees per year.", "limit"),
    (3, "short", "anything at all", "q"), (4, "One long sentence without bullets that says something. And another sentence follows here.", "One long sentence without bullets that says something.", ""),
    (5, "\"go_number\": \"x\"\n{\"a\": 1}\n*(Ref: y)*", "text", ""), (6, "प्रावधान नहीं है इस विषय में\n- वन विभाग द्वारा अनुमति दी जाएगी यहाँ", "वन विभाग द्वारा अनुमति दी जाएगी", ""),
])

CLAIMS_SQL = f"""(SELECT row_id, excerpt, question, CASE WHEN len(lines) > 0 THEN lines WHEN length(trim(answer)) >= 20 THEN sentences ELSE [] END AS claims FROM (SELECT *,
  [c FOR c IN [trim(regexp_replace(regexp_replace(s, '^[*\\-•\\d.\\s]+', ''), '[*_]', '', 'g')) FOR s IN [trim(x) FOR x IN string_split(answer, chr(10))]
    IF NOT (s = '' OR regexp_matches(s, '^\\s*["{{}}\\[\\]]') OR regexp_matches(s, {literal(fixed.JSON_KEYS)}, 'i') OR starts_with(s, '#') OR starts_with(s, '*(') OR ends_with(s, ')*')
      OR contains(s, 'प्रमाणित प्रशासनिक संदर्भ') OR (contains(s, 'शासनादेश संख्या') AND contains(s, 'के अनुसार')) OR len([n FOR n IN {literal(fixed.NEGATIVE_REMARKS)} IF contains(s, n)]) > 0)] IF length(c) >= 15] AS lines,
  [s FOR s IN [trim(x) FOR x IN regexp_split_to_array(answer, '[।.\\n]+')] IF length(s) >= 15 AND NOT starts_with(s, '*(') AND NOT regexp_matches(s, '^\\s*["{{}}\\[\\]]') AND len([n FOR n IN {literal(fixed.NEGATIVE_REMARKS[:4])} IF contains(s, n)]) = 0] AS sentences
  FROM {ANSWER.sql()}))"""


def grams_sql(x: str) -> str:
    c = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+', '', 'g')"
    return f"(CASE WHEN {c} = '' THEN [] WHEN length({c}) < 3 THEN [{c}] ELSE list_distinct([substr({c}, i, 3) FOR i IN range(1, length({c}) - 1)]) END)"


@query("claim_extract", f"SELECT row_id, array_to_string(claims, '|') AS claims FROM {CLAIMS_SQL}")
def claim_extract(spark, sf):
    return ANSWER.df(spark).select("row_id", F.array_join(X.claims(F.col("answer")), "|").alias("claims"))


@query("char_3grams", f"SELECT item_id, len({grams_sql('text')}) AS n, sha256(array_to_string(list_sort({grams_sql('text')}), '|')) AS digest FROM benchmark")
def char_3grams(spark, sf):
    g = X.grams(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(g), "|"), 256).alias("digest"))


GROUND_SQL = f"""(SELECT row_id, claim, r AS recall, CASE WHEN len(own) = 0 THEN TRUE WHEN r < 0.25 THEN FALSE WHEN r < 0.35 AND len([n FOR n IN nums IF length(n) >= 3 AND NOT contains(hay, n)]) > 0 THEN FALSE ELSE TRUE END AS grounded
  FROM (SELECT row_id, claim, own, CASE WHEN len(own) = 0 THEN 1.0 ELSE len(list_intersect(own, other)) / len(own) END AS r, [replace(n, ',', '') FOR n IN regexp_extract_all(claim, '\\b(\\d+(?:,\\d+)?(?:\\.\\d+)?)\\b', 1)] AS nums, replace(lower(excerpt || ' ' || question), ',', '') AS hay
    FROM (SELECT row_id, claim, excerpt, question, {grams_sql('claim')} AS own, {grams_sql('excerpt')} AS other FROM (SELECT row_id, excerpt, question, unnest(claims) AS claim FROM {CLAIMS_SQL}))))"""


def grounded(spark):
    x = ANSWER.df(spark).select("row_id", "excerpt", "question", F.explode(X.claims(F.col("answer"))).alias("claim"))
    r, ok = X.grounding(F.col("claim"), F.col("excerpt"), F.col("question"))
    return x.select("row_id", "claim", r.alias("recall"), ok.alias("grounded"))


@query("grounding_verdict", f"SELECT row_id, claim, round(recall, 6) AS recall, grounded FROM {GROUND_SQL}")
def grounding_verdict(spark, sf):
    return grounded(spark).withColumn("recall", F.round("recall", 6))


@query("answer_verdict", f"SELECT row_id, bool_and(grounded) AS grounded, count(*) AS n_claims FROM {GROUND_SQL} GROUP BY row_id")
def answer_verdict(spark, sf):
    return grounded(spark).groupBy("row_id").agg(F.bool_and("grounded").alias("grounded"), F.count(F.lit(1)).alias("n_claims"))


@query("ngram_recall", f"""WITH t AS (SELECT conv_id, turn, role, text, {grams_sql('text')} AS g FROM conversations), a AS (SELECT * FROM t WHERE role = 'assistant'), p AS (SELECT conv_id, turn, g FROM t WHERE role <> 'assistant')
  SELECT a.conv_id, a.turn, round(CASE WHEN len(a.g) = 0 THEN 1.0 ELSE len(list_intersect(a.g, list_distinct(flatten(list(p.g))))) / len(a.g) END, 6) AS recall FROM a JOIN p ON a.conv_id = p.conv_id AND p.turn < a.turn GROUP BY a.conv_id, a.turn, a.g""")
def ngram_recall(spark, sf):
    """Share of an assistant turn's 3-grams in the turns before it, as an exchange of gram rows and not of arrays."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.explode_outer(X.grams(F.col("text"))).alias("g"))
    a, p = t.where("role = 'assistant'"), t.where("role <> 'assistant' AND g IS NOT NULL")
    first = p.groupBy("conv_id", "g").agg(F.min("turn").alias("first"))
    before = p.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    hit = a.join(first, ["conv_id", "g"], "left").join(before, "conv_id").where("opening < turn")
    found = F.count_if(F.col("first") < F.col("turn"))
    return hit.groupBy("conv_id", "turn").agg(F.round(F.when(F.count("g") == 0, F.lit(1.0)).otherwise(found / F.count("g")), 6).alias("recall"))


@query("delivery", "SELECT doc_id, length(text) > 20 AND (doc_id % 100 >= 85 OR doc_id % 3 = 0) AS valid, CASE WHEN length(text) > 20 AND (doc_id % 100 >= 85 OR doc_id % 3 = 0) THEN FALSE ELSE doc_id % 2 = 0 END AS refusal FROM documents")
def delivery(spark, sf):
    d = table(spark, sf, "documents")
    valid = A.deliverable(F.col("text"), F.col("doc_id") % 100 / 100, F.col("doc_id") % 3 == 0)
    return d.select("doc_id", valid.alias("valid"), F.when(valid, False).otherwise(F.col("doc_id") % 2 == 0).alias("refusal"))


@query("clean_excerpt")
def clean_excerpt(spark, sf):
    """No SQL: the rule on repeated characters needs a back reference, which the second engine lacks."""
    return table(spark, sf, "documents").select("doc_id", X.clean_excerpt(F.col("text")).alias("excerpt"))


REPLIES = Fixture("row_id int, reply string", [
    (1, "```json\n{\"answer\": \"Forty two is the answer\", \"n\": 1}\n```"), (2, "noise {\"content\": \"plain\"} tail"), (3, "no json here"), (4, None), (5, "{broken"), (6, "{\"text\": \"  \", \"markdown\": \"kept\"}"), (7, "Sure, here it is\n\nbody text @@@ goes here\n\nI hope this helps you"),
    (8, "```markdown\n| a | b |\n```"), (9, "{\"go_number\": \"\", \"page_text\": \"page body\"}"), (10, "{\"go_number\": \"संख्या-__/XXX\", \"is_draft_placeholder\": true}"),
    (11, "[{'type': 'text', 'text': 'listed words'}]"), (12, "{\"go_number\": \"GO-7/XX\", \"date\": \"2018\"}"), (13, "before\n```json\n{\"go_number\": \"GO-9/AB\", \"is_draft_placeholder\": false}\n```\nafter the block"),
])


@query("reply_json", "SELECT row_id, json_valid(j) AND j <> '' AS found FROM (SELECT row_id, CASE WHEN f <> '' THEN f ELSE o END AS j FROM (SELECT row_id, coalesce(regexp_extract(reply, '(?is)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '') AS f, coalesce(regexp_extract(reply, '(?s)(\\{(?:[^{}]|(?:\\{[^{}]*\\}))*\\})', 1), '') AS o FROM " + REPLIES.sql() + "))")
def reply_json(spark, sf):
    return REPLIES.df(spark).select("row_id", A.reply_json(F.col("reply")).isNotNull().alias("found"))


@query("answer_unwrap", "SELECT row_id, CASE WHEN json_valid(j) AND j <> '' THEN coalesce(" + ", ".join(f"nullif(trim(json_extract_string(CASE WHEN json_valid(j) THEN j ELSE '{{}}' END, '$.{k}')), '')" for k in fixed.ANSWER_KEYS) + ", t) ELSE t END AS answer FROM (SELECT row_id, t, regexp_extract(t, '(?s)\\{.*\\}') AS j FROM (SELECT row_id, trim(regexp_replace(trim(coalesce(reply, '')), '(?m)^```(?:json|markdown)?\\s*|\\s*```$', '', 'g')) AS t FROM " + REPLIES.sql() + "))")
def answer_unwrap(spark, sf):
    return REPLIES.df(spark).select("row_id", A.unwrapped(F.col("reply")).alias("answer"))


@query("strip_chatter", r"""SELECT row_id, CASE WHEN inside <> '' THEN trim(inside, ' ' || chr(10)) ELSE t END AS t FROM (SELECT row_id, t, regexp_extract(t, '(?s)^```(?:markdown|text)?\s*\n(.*)\n```$', 1) AS inside FROM (SELECT row_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(reply, '@+', '', 'g'), ' ' || chr(10)), '^(?:Here is the (?:extracted |markdown |verbatim )?text[^\n]*\n+|Sure,?[^\n]*\n+|Certainly,?[^\n]*\n+)', '', 'i'), '\n+(?:Let me know if you need anything else|I hope this helps|Note: The above text is extracted)[^\n]*$', '', 'i'), ' ' || chr(10)) AS t FROM """ + REPLIES.sql() + "))")
def strip_chatter(spark, sf):
    return REPLIES.df(spark).select("row_id", A.without_chatter(F.col("reply")).alias("t"))


HEADER_SQL = r"""WITH x AS (SELECT row_id, CASE WHEN regexp_matches(trim(coalesce(reply, '')), '^\[\{[\x27"]type[\x27"]: [\x27"]text[\x27"]') THEN coalesce(json_extract_string(CASE WHEN json_valid(replace(trim(reply), chr(39), '"')) THEN replace(trim(reply), chr(39), '"') ELSE '[]' END, '$[0].text'), trim(reply)) ELSE coalesce(reply, '') END AS t FROM REPLIES),
  y AS (SELECT *, regexp_extract(t, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) AS f, starts_with(trim(t), '{') AND ends_with(trim(t), '}') AS whole FROM x),
  z AS (SELECT *, CASE WHEN f <> '' THEN f WHEN whole THEN trim(t) END AS raw, CASE WHEN f <> '' THEN trim(regexp_replace(t, '(?s)```(?:json)?\s*(\{.*?\})\s*```', '', 'g')) WHEN whole THEN '' ELSE t END AS rest FROM y),
  w AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS j FROM z),
  v AS (SELECT *, coalesce(json_extract_string(j, '$.go_number'), '') AS go, array_to_string([k || ': ' || json_extract_string(j, '$.' || k) FOR k IN json_keys(j) IF k <> 'page_text' AND coalesce(json_extract_string(j, '$.' || k), '') NOT IN ('', 'false')], chr(10)) AS entries FROM w)
  SELECT row_id, go AS go_number, coalesce(nullif(trim(json_extract_string(j, '$.page_text')), ''), nullif(trim(rest), ''), nullif(entries, ''), trim(t)) AS page_text, coalesce(TRY_CAST(json_extract_string(j, '$.is_draft_placeholder') AS BOOLEAN), go = '' OR regexp_matches(go, DRAFT)) AS draft FROM v"""


@query("header_json", HEADER_SQL.replace("REPLIES", REPLIES.sql()).replace("DRAFT", literal(fixed.DRAFT_NUMBER)))
def header_json(spark, sf):
    return REPLIES.df(spark).select("row_id", A.header(F.col("reply")).alias("h")).select("row_id", "h.go_number", "h.page_text", "h.draft")


@query("blank_page", "SELECT page_id, CASE WHEN length(regexp_replace(t, '[\\s\\-_=@~|`#*]', '', 'g')) < 30 THEN 0 ELSE length(t) END AS n FROM (SELECT page_id * 2 AS page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages UNION ALL SELECT page_id * 2 + 1, '-- ' || substring(url, 1, CAST(page_id % 50 AS INTEGER)) FROM pages)")
def blank_page(spark, sf):
    """The text of every page, and the head of its address, which is blank for some."""
    p = table(spark, sf, "pages")
    texts = p.select((F.col("page_id") * 2).alias("page_id"), F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    heads = p.select((F.col("page_id") * 2 + 1).alias("page_id"), F.concat(F.lit("-- "), F.col("url").substr(F.lit(1), (F.col("page_id") % 50).cast("int"))).alias("t"))
    return texts.unionByName(heads).select("page_id", F.length(A.or_blank(F.col("t"))).cast("long").alias("n"))


@query("fallback_summary", "SELECT doc_id, array_to_string(['- **' || left(l, 180) FOR l IN ([x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF length(x) > 10])[1:3]], chr(10)) AS summary FROM documents")
def fallback_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.summary(F.col("text")).alias("summary"))


RETAIN_SQL = r"""WITH RECURSIVE b AS (SELECT item_id, lower(text) AS e, regexp_extract_all(text, '[\x{0900}-\x{097F}]{2,}|\b\d+\b|[A-Za-z0-9\-()/]{3,}') AS ts FROM benchmark),
  s AS (SELECT item_id, ts, 1 AS i, e AS t FROM b UNION ALL SELECT item_id, ts, i + 1, CASE WHEN contains(t, ts[i]) THEN t ELSE trim(t || ' ' || ts[i]) END FROM s WHERE i <= len(ts))
  SELECT item_id, t AS search FROM s WHERE i = len(ts) + 1"""


@query("retain_tokens", RETAIN_SQL)
def retain_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", A.with_tokens(F.lower("text"), F.col("text")).alias("search"))


@query("citation_markers", "SELECT row_id, len(regexp_extract_all(t, '\\[\\d+\\]|\\(Ref:[^)]*\\)')) AS n FROM (VALUES (1, 'as in [1] and [22] (Ref: GO-5)'), (2, 'none'), (3, '[x] [3]')) v(row_id, t)")
def citation_markers(spark, sf):
    d = spark.createDataFrame([(1, "as in [1] and [22] (Ref: GO-5)"), (2, "none"), (3, "[x] [3]")], "row_id int, t string")
    return d.select("row_id", F.regexp_count("t", F.lit(r"\[\d+\]|\(Ref:[^)]*\)")).cast("long").alias("n"))


ERRORS = Fixture("session int, seq int, kind string, message string", [
    (1, 1, "OutOfScopeQuery", "Category: grievance - x"), (1, 2, "CitationIntegrityFailure", "m"), (2, 1, "PromptInjectionDetected", "m"), (2, 2, "OutOfScopeQuery", "Category: policy_opinion - x"), (3, 1, "Other", "m"),
    (4, 1, "CitationIntegrityFailure", "a"), (4, 2, "CitationIntegrityFailure", "b"), (5, 1, "HumanVerificationDenied", "d"), (5, 2, "OutOfScopeQuery", "Category: order_drafting - x"),
])
CATS = ["financial_disbursement", "grievance", "order_drafting", "policy_opinion"]


@query("refusal_template", f"""WITH e AS (SELECT *, CASE WHEN kind IN ('HumanVerificationDenied', 'PromptInjectionDetected') THEN kind {' '.join(f"WHEN contains(lower(message), '{c}') OR contains(lower(kind), '{c}') THEN '{c}'" for c in CATS)} END AS tpl FROM {ERRORS.sql()}),
  stop AS (SELECT session, max(seq) AS s FROM e WHERE tpl IN ('HumanVerificationDenied', 'PromptInjectionDetected') GROUP BY session)
  SELECT e.session, coalesce(max(CASE WHEN seq = s THEN tpl END), arg_min(tpl, seq) FILTER (WHERE tpl IS NOT NULL), 'default') AS template FROM e LEFT JOIN stop USING (session) GROUP BY e.session""")
def refusal_template(spark, sf):
    return A.refusals(ERRORS.df(spark))


@query("failure_count", f"SELECT session, count(*) FILTER (WHERE kind = 'CitationIntegrityFailure') AS failures, CASE WHEN count(*) FILTER (WHERE kind = 'CitationIntegrityFailure') >= 2 THEN 'refuse' WHEN count(*) FILTER (WHERE kind = 'CitationIntegrityFailure') = 1 THEN 'retry' ELSE 'none' END AS action FROM {ERRORS.sql()} GROUP BY session")
def failure_count(spark, sf):
    n = F.count_if(F.col("kind") == "CitationIntegrityFailure")
    return ERRORS.df(spark).groupBy("session").agg(n.alias("failures"), F.when(n >= 2, "refuse").when(n == 1, "retry").otherwise("none").alias("action"))


STATES = Fixture("row_id int, refusal boolean, confidence double, conflicts int, action string, failures int, last string", [
    (1, True, 0.9, 0, None, 0, None), (2, False, 0.9, 0, "approve", 0, None), (3, False, 0.5, 0, "deny", 1, "CitationIntegrityFailure"), (4, False, 0.95, 1, "approve_with_edit", 2, "CitationIntegrityFailure"), (5, False, 0.85, 0, None, 1, "Other"),
])
ROUTES = {
    "route_scope": "CASE WHEN refusal THEN 'refusal_redirect' ELSE 'retrieval_invocation' END",
    "route_confidence": "CASE WHEN confidence < 0.85 OR conflicts > 0 THEN 'human_verification_interrupt' ELSE 'grounded_synthesis' END",
    "route_human": "CASE WHEN NOT refusal AND action IN ('approve', 'approve_with_edit') THEN 'grounded_synthesis' ELSE 'refusal_redirect' END",
    "route_integrity": "CASE WHEN refusal THEN 'refusal_redirect' WHEN last = 'CitationIntegrityFailure' AND failures < 2 THEN 'grounded_synthesis' WHEN last = 'CitationIntegrityFailure' THEN 'refusal_redirect' ELSE 'response_delivery' END",
}


def _route(name: str, sql: str) -> None:
    @query(name, f"SELECT row_id, {sql} AS next_node FROM {STATES.sql()}")
    def route(spark, sf):
        return STATES.df(spark).select("row_id", A.ROUTES[name]().alias("next_node"))


for _name, _sql in ROUTES.items():
    _route(_name, _sql)


CITES = Fixture("cite_id int, go string, page int, excerpt string", [(1, "A", 2, "x"), (2, "A", 9, "royalty due"), (3, "B", None, "y"), (4, "Z", 1, "nothing")])
PASSAGES = Fixture("pos int, go string, page int, excerpt string", [(1, "A", 1, "plain"), (2, "A", 2, "second"), (3, "B", 5, "royalty of 2000"), (4, "A", 3, "transit")])


@query("citation_align", f"""WITH c AS {CITES.sql()}, p AS {PASSAGES.sql()}, k AS (SELECT cite_id, pos, list_sum([CASE WHEN contains(lower(c.excerpt), w) AND contains(lower(p.excerpt), w) THEN 5 ELSE 0 END FOR w IN {literal(fixed.CITATION_WORDS)}]) AS s FROM c, p),
  m AS (SELECT cite_id, 1 AS rule, 0 AS s, pos FROM c JOIN p ON c.go = p.go AND c.page = p.page UNION ALL SELECT cite_id, 2, -s, pos FROM k WHERE s > 0 UNION ALL SELECT cite_id, 3, 0, pos FROM c JOIN p ON c.go = p.go UNION ALL SELECT cite_id, 4, 0, (SELECT min(pos) FROM p) FROM c)
  SELECT cite_id, pos FROM m QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY rule, s, pos) = 1""")
def citation_align(spark, sf):
    return A.aligned(CITES.df(spark), PASSAGES.df(spark))


@query("timeline", "SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY y DESC, doc_id DESC) = 1 THEN 'CURRENT' ELSE 'PREVIOUS' END AS label FROM (SELECT source, doc_id, 2000 + doc_id % 25 AS y FROM documents QUALIFY row_number() OVER (PARTITION BY source, 2000 + doc_id % 25 ORDER BY doc_id) = 1)")
def timeline(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", (2000 + F.col("doc_id") % 25).alias("y"))
    first = d.groupBy("source", "y").agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy("source").orderBy(F.desc("y"), F.desc("doc_id"))
    return first.select("source", "doc_id", F.when(F.row_number().over(w) == 1, "CURRENT").otherwise("PREVIOUS").alias("label"))
