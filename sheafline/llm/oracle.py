"""SQL of the queries that SQL can express, for a second engine."""

from .mixing import LEVELS
from .queries import MIX

OP1 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP9 = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""




def _case(level: int) -> str:
    whens = "".join(f" WHEN {' AND '.join(f'{n} = {chr(39)}{v}{chr(39)}' for n, v in zip(LEVELS, path, strict=False))} THEN {w}" for path, w in MIX.weights.items() if len(path) == level)
    return f"CASE{whens} ELSE {MIX.default_weight} END" if whens else str(MIX.default_weight)


def _fill(nodes: str, parent: str, names: str) -> str:
    """Budgets of nodes (names, cap, w, pb) within each parent, children in the order in which they saturate."""
    w = f"(PARTITION BY {parent} ORDER BY cap / w, {names} ROWS BETWEEN"
    return f"""(SELECT {names}, CASE WHEN lev IS NULL THEN cap ELSE least(cap, lev * w) END AS b FROM (SELECT *, first_value(CASE WHEN cap / w * aft > rest THEN rest / aft END IGNORE NULLS) OVER {w} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev
      FROM (SELECT *, pb - coalesce(sum(cap) OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER {w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM {nodes})))"""


#: The weights of the query hold no 0, so every child counts in its parent's capacity.
OP10 = rf"""
WITH led AS (
  SELECT doc_id, 'group' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 3 AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM led GROUP BY ALL),
c3 AS (SELECT domain, lang, source, tokens * {float(MIX.max_epochs)}::DOUBLE AS cap, CAST({_case(3)} AS DOUBLE) AS w FROM leaves),
c2 AS (SELECT domain, lang, sum(cap) AS cap, CAST(any_value({_case(2)}) AS DOUBLE) AS w FROM c3 GROUP BY domain, lang),
c1 AS (SELECT domain, sum(cap) AS cap, CAST(any_value({_case(1)}) AS DOUBLE) AS w, (SELECT CAST(sum(tokens) AS DOUBLE) * {MIX.budget_share}::DOUBLE FROM leaves) AS pb FROM c2 GROUP BY domain),
b1 AS (SELECT * FROM {_fill("c1", "1", "domain")}),
b2 AS (SELECT * FROM {_fill("(SELECT c2.*, b1.b AS pb FROM c2 JOIN b1 USING (domain))", "domain", "domain, lang")}),
b3 AS (SELECT * FROM {_fill("(SELECT c3.*, b2.b AS pb FROM c3 JOIN b2 USING (domain, lang))", "domain, lang", "domain, lang, source")}),
plan AS (SELECT domain, lang, source, tokens, CAST(floor(b + 1e-6) AS BIGINT) AS b, CASE WHEN tokens > 0 THEN CAST(floor(b + 1e-6) AS BIGINT) // tokens ELSE 0 END AS epochs FROM leaves JOIN b3 USING (domain, lang, source)),
keyed AS (SELECT led.*, tokens, b, epochs, b - epochs * tokens AS rest, CAST('0x' || substr(md5('{MIX.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) AS key FROM led JOIN plan USING (domain, lang, source)),
runs AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE UNBOUNDED PRECEDING) AS run FROM keyed),
cut AS (SELECT domain, lang, source, min((key, doc_id)) AS last FROM runs WHERE rest > 0 AND run >= rest GROUP BY domain, lang, source)
SELECT doc_id, domain, lang, source, n AS n_tokens, tokens AS leaf_tokens, b AS leaf_budget, CAST(epochs + CASE WHEN (key, doc_id) <= last THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM keyed LEFT JOIN cut USING (domain, lang, source)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op9_exact_topk": OP9, "op10_mix_sources": OP10}
