"""Queries of retrieval, lineage and confidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lineage as L
from ..operators import retrieval as R
from ..sources.shared import sent
from .base import CORPUS_SQL, LINEAGE_SQL, PHRASES_SQL, QUERIES_SQL, corpus, facts, lineage, phrases, questions
from .registry import Fixture, query, table

DENSE_SQL = f"""(SELECT query_id, id, dense_rank, dense_sim FROM (SELECT query_id, id, dense_sim, row_number() OVER (PARTITION BY query_id ORDER BY dense_sim DESC, id) AS dense_rank
  FROM (SELECT q.query_id, c.id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS dense_sim
    FROM {{q}} q JOIN {CORPUS_SQL} c ON c.embedding IS NOT NULL {{where}})) WHERE dense_rank <= 50)"""
TOKENS_SQL = "regexp_extract_all(lower({t}), '[\\p{L}\\p{M}\\p{N}]+')"
#: query_id, id, score: cover density from the last occurrence of each term at or before each occurrence; 0 for literal hits.
MATCH_SQL = f"""(WITH q AS MATERIALIZED (SELECT query_id, query_text, list_distinct({TOKENS_SQL.replace("{t}", "query_text")}) AS terms FROM {{q}} z),
  t AS MATERIALIZED (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM q),
  docs AS MATERIALIZED (SELECT id, lower(text) AS t, {TOKENS_SQL.replace("{t}", "text")} AS toks FROM {CORPUS_SQL}),
  pairs AS MATERIALIZED (SELECT q.query_id, docs.id FROM q JOIN docs ON len(terms) > 0 AND list_has_all(toks, terms)),
  p AS (SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM docs WHERE id IN (SELECT id FROM pairs)),
  o AS MATERIALIZED (SELECT query_id, id, term, pos, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS i FROM pairs JOIN p USING (id) JOIN t USING (query_id, term)),
  l AS (SELECT o.query_id, o.id, o.i, max(CASE WHEN o.term = t.term THEN o.i END) OVER (PARTITION BY o.query_id, o.id, t.term ORDER BY o.i) AS last FROM o JOIN t USING (query_id)),
  b AS (SELECT query_id, id, i, min(last) AS s FROM l GROUP BY query_id, id, i HAVING count(last) = count(*)),
  c AS (SELECT query_id, id, s, min(i) AS e FROM b GROUP BY query_id, id, s),
  d AS (SELECT c.query_id, c.id, sum(0.1::DOUBLE / (1.0::DOUBLE + (y.pos - x.pos) - (c.e - c.s))) AS score FROM c JOIN o x ON x.query_id = c.query_id AND x.id = c.id AND x.i = c.s JOIN o y ON y.query_id = c.query_id AND y.id = c.id AND y.i = c.e GROUP BY c.query_id, c.id)
  SELECT query_id, id, round(max(score), 9) AS score FROM (SELECT * FROM d UNION ALL SELECT q.query_id, docs.id, 0.0 FROM q JOIN docs ON contains(docs.t, substring(lower(q.query_text), 1, 100))) GROUP BY query_id, id)"""
SPARSE_SQL = f"""(SELECT query_id, id, sparse_rank, sparse_score FROM (SELECT m.query_id, m.id, m.score AS sparse_score, row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, m.id) AS sparse_rank
  FROM {MATCH_SQL} m JOIN {{q}} q ON q.query_id = m.query_id JOIN {CORPUS_SQL} c ON c.id = m.id {{where}}) WHERE sparse_rank <= 50)"""


def dense_sql(q: str = QUERIES_SQL, where: str = "") -> str:
    return DENSE_SQL.replace("{q}", q).replace("{where}", where)


def sparse_sql(q: str = QUERIES_SQL, where: str = "") -> str:
    return SPARSE_SQL.replace("{q}", q).replace("{where}", where)


def fused_sql(q: str = QUERIES_SQL, where: str = "") -> str:
    return f"""(SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id,
      coalesce(1.0 / (60.0 + d.dense_rank), 0.0) + coalesce(1.0 / (60.0 + s.sparse_rank), 0.0) AS rrf, coalesce(d.dense_sim, 0.5) AS dense_sim
      FROM {dense_sql(q, where)} d FULL OUTER JOIN {sparse_sql(q, where)} s ON d.query_id = s.query_id AND d.id = s.id)"""


def scored_sql(k: int = 25, q: str = QUERIES_SQL, where: str = "") -> str:
    return f"""(SELECT query_id, CAST(place AS INTEGER) AS place, id, round(rrf, 9) AS rrf, round(greatest(0.0, least(1.0, greatest(CASE WHEN dense_sim = 0 THEN 0.5 ELSE dense_sim END, least(1.0, rrf * 30.0)))), 6) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS place FROM {fused_sql(q, where)}) WHERE place <= {k})"""


def found(spark, sf, k=25):
    """One query set without facets: the list that later queries score and check."""
    return R.search(corpus(spark, sf), questions(spark, sf).drop("department"), k, facts(spark, sf))


@query("hybrid_search", f"SELECT * FROM {scored_sql()}")
def hybrid_search(spark, sf):
    return found(spark, sf).select("query_id", "place", "id", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"))


@query("dense_rank", f"SELECT query_id, id, CAST(dense_rank AS INTEGER) AS dense_rank, round(dense_sim, 6) AS dense_sim FROM {dense_sql()}")
def dense_rank(spark, sf):
    return R.dense_rank(corpus(spark, sf), questions(spark, sf).drop("department")).withColumn("dense_sim", F.round("dense_sim", 6))


@query("cosine", f"SELECT q.query_id, c.id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim FROM {QUERIES_SQL} q JOIN {CORPUS_SQL} c ON c.department = q.department AND c.embedding IS NOT NULL")
def cosine(spark, sf):
    q, c = questions(spark, sf).select("query_id", "department", F.col("embedding").alias("qe")), corpus(spark, sf).where("embedding IS NOT NULL").select("id", "department", "embedding")
    return c.join(sent(q), "department").select("query_id", "id", F.round(R.cosine(F.col("embedding"), F.col("qe")), 6).alias("sim"))


@query("sparse_match", f"SELECT m.query_id, m.id, m.score FROM {MATCH_SQL.replace('{q}', PHRASES_SQL)} m")
def sparse_match(spark, sf):
    return R.sparse_matches(facts(spark, sf), phrases(spark, sf)).select("query_id", "id", "score")


@query("sparse_rank", f"SELECT query_id, id, CAST(sparse_rank AS INTEGER) AS sparse_rank, round(sparse_score, 6) AS sparse_score FROM {sparse_sql(PHRASES_SQL)} UNION ALL SELECT query_id + 1000000, id, CAST(sparse_rank AS INTEGER), round(sparse_score, 6) FROM {sparse_sql()}")
def sparse_rank(spark, sf):
    both = phrases(spark, sf).unionByName(questions(spark, sf).select((F.col("query_id") + 1_000_000).alias("query_id"), "query_text"))
    return R.sparse_rank(facts(spark, sf), both).withColumn("sparse_score", F.round("sparse_score", 6))


@query("rrf_fusion", f"SELECT query_id, id, round(rrf, 9) AS rrf, round(dense_sim, 6) AS dense_sim FROM {fused_sql()}")
def rrf_fusion(spark, sf):
    q = questions(spark, sf).drop("department")
    return R.fuse(R.dense_rank(corpus(spark, sf), q), R.sparse_rank(facts(spark, sf), q.drop("embedding"))).select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("dense_sim", 6).alias("dense_sim"))


@query("rrf_hydrate", f"SELECT f.query_id, f.place, f.id, c.department, c.year, sha256(c.text) AS text_digest FROM {scored_sql(10)} f JOIN {CORPUS_SQL} c ON f.id = c.id")
def rrf_hydrate(spark, sf):
    ids = found(spark, sf, 10).select("query_id", "place", "id")
    return facts(spark, sf).join(ids, "id").select("query_id", "place", "id", "department", "year", F.sha2("text", 256).alias("text_digest"))


@query("topk", f"SELECT query_id, place, id FROM {scored_sql(5)}")
def topk(spark, sf):
    return found(spark, sf, 5).select("query_id", "place", "id")


@query("dense_only", f"SELECT query_id, id, round(greatest(0.0, least(1.0, greatest(CASE WHEN dense_sim = 0 THEN 0.5 ELSE dense_sim END, 0.6))), 6) AS score FROM {dense_sql()} WHERE dense_rank <= 25")
def dense_only(spark, sf):
    d = R.dense_rank(corpus(spark, sf), questions(spark, sf).drop("department"), 25)
    return d.select("query_id", "id", F.round(R.normalised(F.col("dense_sim"), F.lit(0.02)), 6).alias("score"))


SCORES = Fixture("row_id int, dense_sim double, rrf double, raw string", [(1, 0.0, 0.01, "0.7"), (2, 0.9, 0.02, "abc"), (3, None, None, "NaN"), (4, -0.4, 0.0328, "7"), (5, float("nan"), 0.02, "-2"), (6, 0.3, 0.0, None)])


@query("score_normalise", f"""SELECT row_id, CASE WHEN isnan(s) THEN 0.0 ELSE round(greatest(0.0, least(1.0, greatest(s, least(1.0, r * 30.0)))), 6) END AS score FROM (
  SELECT row_id, coalesce(nullif(dense_sim, 0.0), 0.5) AS s, coalesce(nullif(rrf, 0.0), 0.016) AS r FROM (SELECT * FROM (VALUES (1, 0.0::DOUBLE, 0.01::DOUBLE), (2, 0.9, 0.02), (3, NULL, NULL), (4, -0.4, 0.0328), (5, 'NaN'::DOUBLE, 0.02), (6, 0.3, 0.0)) v(row_id, dense_sim, rrf)))""")
def score_normalise(spark, sf):
    return SCORES.df(spark).select("row_id", F.round(R.normalised(F.col("dense_sim"), F.col("rrf")), 6).alias("score"))


@query("score_clamp", "SELECT row_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE greatest(0.0, least(1.0, v)) END AS score FROM (SELECT row_id, try_cast(raw AS DOUBLE) AS v FROM (VALUES (1, '0.7'), (2, 'abc'), (3, 'NaN'), (4, '7'), (5, '-2'), (6, NULL)) v(row_id, raw))")
def score_clamp(spark, sf):
    return SCORES.df(spark).select("row_id", X.clamp(F.col("raw")).alias("score"))


ORDERED_SQL = f"(SELECT *, CASE WHEN query_id % 3 = 0 THEN 'GO-' || query_id % 10 END AS go FROM {QUERIES_SQL})"
GO_WHERE = "AND (q.go IS NULL OR contains(lower(c.go_number), lower(substr(q.go, 4))))"


@query("relevance_threshold", f"SELECT s.query_id, s.id, s.score, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.place) AS INTEGER) AS place FROM {scored_sql(25, ORDERED_SQL, GO_WHERE)} s JOIN {ORDERED_SQL} o USING (query_id) WHERE o.go IS NOT NULL OR s.score >= 0.5")
def relevance_threshold(spark, sf):
    q = questions(spark, sf).drop("department").withColumn("go", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("GO-"), (F.col("query_id") % 10).cast("string"))))
    hits = R.search(corpus(spark, sf), q, facts=facts(spark, sf)).withColumn("score", F.round("score", 6))
    return R.relevant(hits, q).select("query_id", "id", "score", "place")


DEPT_WHERE = "AND c.department ILIKE '%' || q.department || '%'"


@query("facet_filter", f"SELECT q.query_id, c.id FROM {QUERIES_SQL} q JOIN {CORPUS_SQL} c ON q.department = c.department AND c.year BETWEEN 2003 AND 2015 AND c.status = 'CURRENT_ACTIVE'")
def facet_filter(spark, sf):
    q = questions(spark, sf).select("query_id", "department")
    c = facts(spark, sf).drop("text").where("year BETWEEN 2003 AND 2015 AND status = 'CURRENT_ACTIVE'")
    return c.join(sent(q), "department").select("query_id", "id")


@query("relax_dept", f"""WITH q AS (SELECT query_id, query_text, embedding, CASE WHEN query_id % 4 = 0 THEN 'nowhere' ELSE department END AS department FROM {QUERIES_SQL}),
  strict AS (SELECT *, FALSE AS relaxed FROM {scored_sql(5, 'q', DEPT_WHERE)}), loose AS (SELECT *, TRUE AS relaxed FROM {scored_sql(5)} WHERE query_id NOT IN (SELECT query_id FROM strict))
  SELECT query_id, place, id FROM strict UNION ALL SELECT query_id, place, id FROM loose""")
def relax_dept(spark, sf):
    q = questions(spark, sf).withColumn("department", F.when(F.col("query_id") % 4 == 0, "nowhere").otherwise(F.col("department")))
    return R.search(corpus(spark, sf), q, 5, facts(spark, sf)).select("query_id", "place", "id")


RELAX_SQL = f"(SELECT query_id, query_text, embedding, CASE WHEN query_id % 4 = 0 THEN 'nowhere' ELSE department END AS department, CASE WHEN query_id % 3 = 0 THEN 1990 ELSE 2000 + query_id % 9 END AS y1, CASE WHEN query_id % 3 = 0 THEN 1991 ELSE 2020 END AS y2, CASE WHEN query_id % 2 = 0 THEN '1' || query_id % 10 END AS go FROM {QUERIES_SQL})"
YEAR_WHERE = "AND c.year BETWEEN q.y1 AND q.y2 AND (q.go IS NULL OR contains(lower(c.go_number), q.go))"


@query("relax_go", f"""WITH q AS MATERIALIZED (SELECT * FROM {RELAX_SQL}), strict AS MATERIALIZED (SELECT * FROM {scored_sql(5, 'q', DEPT_WHERE + ' ' + YEAR_WHERE)}),
  q2 AS MATERIALIZED (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM strict)), loose AS MATERIALIZED (SELECT * FROM {scored_sql(5, 'q2', YEAR_WHERE)}),
  q3 AS MATERIALIZED (SELECT * FROM q2 WHERE go IS NOT NULL AND query_id NOT IN (SELECT query_id FROM loose)), last AS (SELECT * FROM {scored_sql(5, 'q3', "AND contains(lower(c.go_number), q.go)")})
  SELECT query_id, place, id FROM strict UNION ALL SELECT query_id, place, id FROM loose UNION ALL SELECT query_id, place, id FROM last""")
def relax_go(spark, sf):
    n = F.col("query_id")
    q = questions(spark, sf).withColumns({
        "department": F.when(n % 4 == 0, "nowhere").otherwise(F.col("department")), "year_from": F.when(n % 3 == 0, 1990).otherwise(2000 + n % 9).cast("int"),
        "year_to": F.when(n % 3 == 0, 1991).otherwise(2020).cast("int"), "go": F.when(n % 2 == 0, F.concat(F.lit("1"), (n % 10).cast("string"))),
    })
    return R.search(corpus(spark, sf), q, 5, facts(spark, sf)).select("query_id", "place", "id")


@query("context_top6", f"SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS r FROM {scored_sql()}) WHERE r <= 6")
def context_top6(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "place")
    return found(spark, sf).withColumn("s", F.round("score", 6)).withColumn("r", F.row_number().over(w)).where("r <= 6").select("query_id", "id")


@query("rerank_fallback", f"SELECT query_id, id, CAST(r AS INTEGER) AS r FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS r FROM {scored_sql()}) WHERE r <= 8")
def rerank_fallback(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "place")
    return found(spark, sf).withColumn("s", F.round("score", 6)).withColumn("r", F.row_number().over(w)).where("r <= 8").select("query_id", "id", "r")


@query("score_margin", f"SELECT query_id, round(max(CASE WHEN place = 1 THEN score END) - coalesce(max(CASE WHEN place = 2 THEN score END), max(CASE WHEN place = 1 THEN score END) / 2), 6) AS margin FROM {scored_sql(2)} GROUP BY query_id")
def score_margin(spark, sf):
    at = lambda k: F.max(F.when(F.col("place") == k, F.round("score", 6)))
    return found(spark, sf, 2).groupBy("query_id").agg(F.round(at(1) - F.coalesce(at(2), at(1) / 2), 6).alias("margin"))


CONFIDENCE_SQL = f"""(WITH p AS (SELECT s.query_id, s.place, s.score, lower(c.text) AS t FROM {scored_sql(3)} s JOIN {CORPUS_SQL} c ON s.id = c.id),
  words AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]{{2,}}')) AS ws FROM benchmark),
  g AS (SELECT query_id, max(CASE WHEN place = 1 THEN score END) AS a, max(CASE WHEN place = 2 THEN score END) AS b, string_agg(t, ' ' ORDER BY place) AS t FROM p GROUP BY query_id)
  SELECT g.query_id, round(0.5 * least(1.0, a) + 0.3 * least(1.0, 2 * greatest(0.0, a - coalesce(b, a / 2))) + 0.2 * CASE WHEN len(ws) = 0 THEN 0.5 ELSE len([w FOR w IN ws IF contains(t, w)]) / len(ws) END, 3) AS confidence
  FROM g JOIN words USING (query_id))"""


def confidence_rows(spark, sf):
    """query_id, confidence from the three best passages and the words of the whole benchmark text they hold."""
    p = facts(spark, sf).select("id", F.lower("text").alias("t")).join(found(spark, sf, 3).withColumn("score", F.round("score", 6)), "id")
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_\x{0900}-\x{097F}]{2,})"), F.lit(1))).alias("ws"))
    return L.confidence(p, words)


@query("confidence", f"SELECT * FROM {CONFIDENCE_SQL}")
def confidence(spark, sf):
    return confidence_rows(spark, sf)


@query("confidence_fallback", f"SELECT query_id, confidence, CASE WHEN query_id % 7 = 0 THEN 'SUPERSEDED' WHEN query_id % 11 = 0 THEN 'AMENDED' ELSE 'CURRENT_ACTIVE' END AS status FROM {CONFIDENCE_SQL}")
def confidence_fallback(spark, sf):
    status = F.when(F.col("query_id") % 7 == 0, "SUPERSEDED").when(F.col("query_id") % 11 == 0, "AMENDED").otherwise("CURRENT_ACTIVE")
    return confidence_rows(spark, sf).withColumn("status", status)


@query("confidence_fastpath", f"SELECT query_id, CASE WHEN query_id % 2 = 0 AND query_id % 7 <> 0 AND confidence >= 0.35 THEN greatest(0.92, confidence) ELSE confidence END AS confidence FROM {CONFIDENCE_SQL}")
def confidence_fastpath(spark, sf):
    one_order, conflict = F.col("query_id") % 2 == 0, F.col("query_id") % 7 == 0
    return confidence_rows(spark, sf).select("query_id", L.fast_path(F.col("confidence"), one_order, conflict).alias("confidence"))


@query("confidence_blend", f"SELECT query_id, ((100 * (query_id % 10) + CAST(round(confidence * 1000) AS BIGINT) + 1) // 2) / 1000.0 AS confidence FROM {CONFIDENCE_SQL}")
def confidence_blend(spark, sf):
    return confidence_rows(spark, sf).select("query_id", L.blend(F.col("confidence"), (F.col("query_id") % 10) / 10.0).alias("confidence"))


@query("lineage_lookup", f"SELECT q.query_id, e.old, e.new, e.status FROM {QUERIES_SQL} q JOIN {LINEAGE_SQL} e ON contains(CAST(e.old AS VARCHAR), CAST(q.query_id AS VARCHAR))")
def lineage_lookup(spark, sf):
    q = questions(spark, sf).select("query_id")
    return lineage(spark, sf).join(sent(q), F.col("old").cast("string").contains(F.col("query_id").cast("string"))).select("query_id", "old", "new", "status")


@query("lineage_status", f"""WITH k AS (SELECT query_id, CAST(query_id AS VARCHAR) AS key FROM {QUERIES_SQL}), e AS (SELECT CAST(old AS VARCHAR) AS go, status, new FROM {LINEAGE_SQL}), d AS (SELECT CAST(id AS VARCHAR) AS go, status FROM {CORPUS_SQL}),
  m AS (SELECT query_id, 1 AS rule, go, status, new FROM k JOIN e ON e.go = k.key UNION ALL SELECT query_id, 2, go, status, new FROM k JOIN e ON contains(e.go, k.key) OR contains(k.key, e.go)
    UNION ALL SELECT query_id, 3, go, status, NULL FROM k JOIN d ON d.go = k.key)
  SELECT k.query_id, coalesce(x.status, 'CURRENT_ACTIVE') AS status, x.new AS superseded_by FROM k LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rule, go) = 1) x USING (query_id)""")
def lineage_status(spark, sf):
    keys = questions(spark, sf).select("query_id", F.col("query_id").cast("string").alias("key"))
    edges = lineage(spark, sf).select(F.col("old").cast("string").alias("go"), "status", F.col("new").alias("superseded_by"))
    docs = facts(spark, sf).select(F.col("id").cast("string").alias("go"), "status")
    return L.statuses(keys, edges, docs)


VERSIONS_SQL = "(SELECT item_id AS query_id, CAST(item_id * k AS VARCHAR) AS go_number FROM benchmark, (VALUES (1), (7)) v(k) WHERE item_id > 0)"


@query("compare_versions", f"""WITH a AS (SELECT *, query_id % 3 > 0 AS accepted FROM {VERSIONS_SQL}), e AS (SELECT CAST(old AS VARCHAR) AS go, status, new FROM {LINEAGE_SQL}), d AS (SELECT CAST(id AS VARCHAR) AS go, status FROM {CORPUS_SQL}),
  k AS (SELECT DISTINCT go_number AS key FROM a WHERE accepted), m AS (SELECT key, CASE WHEN e.go = key THEN 1 ELSE 2 END AS rule, go, status, new FROM k JOIN e ON contains(e.go, k.key) OR contains(k.key, e.go) UNION ALL SELECT key, 3, go, status, NULL FROM k JOIN d ON d.go = k.key)
  SELECT a.query_id, a.go_number, a.accepted, CASE WHEN a.accepted THEN coalesce(x.status, 'CURRENT_ACTIVE') END AS status, CASE WHEN a.accepted THEN x.new END AS superseded_by FROM a LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY rule, go) = 1) x ON x.key = a.go_number""")
def compare_versions(spark, sf):
    """Two orders of each question; those of every third question are not all cited."""
    asked = table(spark, sf, "benchmark").where("item_id > 0").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.col("item_id").cast("string"), (F.col("item_id") * 7).cast("string"))).alias("go_number"))
    cited = asked.where((F.col("query_id") % 3 > 0) | (F.length("go_number") < 2))
    cited = cited.where((F.col("query_id") % 3 > 0) | (F.col("go_number") != F.col("query_id").cast("string")))
    edges = lineage(spark, sf).select(F.col("old").cast("string").alias("go"), "status", F.col("new").alias("superseded_by"))
    docs = facts(spark, sf).select(F.col("id").cast("string").alias("go"), "status")
    return L.compare_versions(asked, cited, edges, docs)


@query("lineage_closure", f"""WITH RECURSIVE e AS (SELECT old, new FROM {LINEAGE_SQL}), c AS (SELECT old AS root, new AS node, 1 AS depth FROM e
  UNION ALL SELECT c.root, e.new, c.depth + 1 FROM c JOIN e ON e.old = c.node WHERE c.depth < 20) SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node""")
def lineage_closure(spark, sf):
    return L.closure(lineage(spark, sf).select("old", "new"), 20).select("root", "node", F.col("depth").cast("int").alias("depth"))


@query("conflicts", f"SELECT old AS go_number, new AS other, 'Order ' || old || ' is ' || status || ' by ' || new AS description FROM {LINEAGE_SQL}")
def conflicts(spark, sf):
    return lineage(spark, sf).where("status IN ('SUPERSEDED', 'AMENDED')").select(F.col("old").alias("go_number"), F.col("new").alias("other"), F.concat_ws(" ", F.lit("Order"), F.col("old"), F.lit("is"), F.col("status"), F.lit("by"), F.col("new")).alias("description"))


@query("conflict_merge", f"SELECT count(*) AS n, count(DISTINCT description) AS n_distinct FROM (SELECT 'Order ' || old || ' is ' || status AS description FROM {LINEAGE_SQL} UNION ALL SELECT 'Order ' || old || ' is ' || status FROM {LINEAGE_SQL} WHERE old % 3 = 0)")
def conflict_merge(spark, sf):
    one = lineage(spark, sf).select("old", F.concat_ws(" ", F.lit("Order"), "old", F.lit("is"), "status").alias("description"))
    both = one.union(one.where("old % 3 = 0"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("description").alias("n_distinct"))


@query("lead_status", f"SELECT q.query_id, arg_min(c.status, c.id) AS status FROM {QUERIES_SQL} q JOIN {CORPUS_SQL} c ON q.department = c.department GROUP BY q.query_id")
def lead_status(spark, sf):
    q = questions(spark, sf).select("query_id", "department")
    return facts(spark, sf).select("id", "department", "status").join(sent(q), "department").groupBy("query_id").agg(F.min_by("status", "id").alias("status"))
