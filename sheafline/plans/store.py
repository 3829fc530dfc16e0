"""Queries of storage, sessions, audit and state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import indic
from ..operators import chunks as K
from ..operators import state as S
from ..sources import pdf
from ..sources import store as D
from ..sources.shared import folder
from ..streaming import reviews as V
from .base import CORPUS_SQL, facts
from .registry import Fixture, query, table


@query("scan_documents", "SELECT doc_id, source, lang, n_chars FROM documents")
def scan_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")


@query("scan_pages", "SELECT page_id, url, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages")
def scan_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n"))


@query("audit_detail", f"SELECT id, department, year, n_chars FROM {CORPUS_SQL} WHERE department ILIKE '%src1%' AND year = 2010 ORDER BY id LIMIT 20")
def audit_detail(spark, sf):
    return facts(spark, sf).where("department ILIKE '%src1%' AND year = 2010").orderBy("id").limit(20).select("id", "department", "year", "n_chars")


UPSERT_SQL = """WITH u AS (SELECT doc_id, upper(lang) AS lang, 'new' AS source, row_number() OVER (PARTITION BY doc_id ORDER BY seen DESC) AS r FROM (SELECT doc_id, lang, 1 AS seen FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 10000000, lang, 2 FROM documents WHERE doc_id % 10 = 0))
  SELECT coalesce(d.doc_id, u.doc_id) AS doc_id, coalesce(u.lang, d.lang) AS lang, coalesce(d.source, u.source) AS source FROM documents d FULL OUTER JOIN (SELECT * FROM u WHERE r = 1) u USING (doc_id)"""


def _upserted(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    u = d.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("source"), F.lit(1).alias("at"))
    u = u.union(d.where("doc_id % 10 = 0").select(F.col("doc_id") + 10000000, F.upper("lang"), F.lit("new"), F.lit(2)))
    return D.upsert(d, u, "doc_id", F.col("at"), keep=("source",))


@query("upsert_documents", UPSERT_SQL)
def upsert_documents(spark, sf):
    return _upserted(spark, sf)


@query("upsert_chunks", "SELECT coalesce(c.k, u.k) AS k, coalesce(u.n, c.n) AS n, coalesce(c.status, 'CURRENT_ACTIVE') AS status FROM (SELECT conv_id * 1000 + turn AS k, length(text) AS n, CASE WHEN conv_id % 2 = 0 THEN 'AMENDED' ELSE 'CURRENT_ACTIVE' END AS status FROM conversations) c FULL OUTER JOIN (SELECT conv_id * 1000 + turn AS k, CAST(0 AS BIGINT) AS n FROM conversations WHERE role = 'user') u USING (k)")
def upsert_chunks(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.length("text").cast("long").alias("n"), F.when(F.col("conv_id") % 2 == 0, "AMENDED").otherwise("CURRENT_ACTIVE").alias("status"), "role")
    u = c.where("role = 'user'").select("k", F.lit(0).cast("long").alias("n"), F.lit("CURRENT_ACTIVE").alias("status"))
    return D.upsert(c.drop("role"), u, "k", F.lit(1), keep=("status",))


@query("delete_document", "SELECT doc_id, source FROM documents WHERE NOT (source = 'src3' OR contains(source, 'c1'))")
def delete_document(spark, sf):
    return D.delete(table(spark, sf, "documents").select("doc_id", "source"), "source", "src3", "c1")


@query("chunk_count", "SELECT count(*) AS n FROM documents")
def chunk_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("sample_chunks", f"SELECT id, embedding IS NOT NULL AS embedded, left(text, 120) AS head FROM {CORPUS_SQL} ORDER BY id LIMIT 10")
def sample_chunks(spark, sf):
    """The first rows by id, cut before vectors are looked up."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id")
    rows = facts(spark, sf).orderBy("id").limit(10)
    return e.join(F.broadcast(rows), F.col("id") == F.col("vec_id"), "right").select("id", F.col("vec_id").isNotNull().alias("embedded"), F.substring("text", 1, 120).alias("head"))


@query("audit_count", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def audit_count(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("audit_summary", "SELECT source, lang, 2000 + doc_id % 25 AS y, count(*) AS chunks, count(DISTINCT n_chars % 10) AS pages FROM documents GROUP BY 1, 2, 3")
def audit_summary(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source", "lang", (2000 + F.col("doc_id") % 25).alias("y")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.col("n_chars") % 10).alias("pages"))


@query("ingest_metrics", "SELECT count(*) AS docs, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars < 30) AS failed FROM documents")
def ingest_metrics(spark, sf):
    pages = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    d = table(spark, sf, "documents")
    return d.agg(F.count(F.lit(1)).alias("docs"), F.sum(pages).alias("pages"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 30).alias("failed"))


TITLE_SQL = "CASE WHEN trim(text) = '' THEN 'New Query' WHEN length(trim(text)) > 60 THEN left(trim(text), 57) || '...' ELSE trim(text) END"
SESSIONS_SQL = f"(SELECT conv_id, coalesce(arg_min(title, turn) FILTER (WHERE title NOT IN ('New Query', '')), 'New Query') AS title, min(turn) AS created, max(turn) AS updated FROM (SELECT *, {TITLE_SQL} AS title FROM conversations) GROUP BY conv_id)"


@query("pdf_pages", "WITH p AS (SELECT item_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM benchmark) SELECT CAST(item_id AS VARCHAR) AS path, 1 AS page, trim(substr(t, 1, 40)) || chr(10) || trim(substr(t, 41, 40)) AS text, 1 AS n_boxes FROM p UNION ALL SELECT CAST(item_id AS VARCHAR), 2, trim(substr(t, 81, 40)), 1 FROM p")
def pdf_pages(spark, sf):
    """Every benchmark text set as a file of two pages, and read back."""
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    part = lambda k: F.trim(F.substring(t, 40 * k + 1, 40))
    page = lambda n, body: F.concat(F.lit(f"{n} 0 obj << /Type /Page /Parent 2 0 R /Contents {n + 1} 0 R >> endobj\n{n + 1} 0 obj << /Length 99 >>\nstream\nBT /F1 10 Tf 12 TL 20 360 Td "), body, F.lit(" ET\nendstream endobj\n"))
    line = lambda k: F.concat(F.lit("("), part(k), F.lit(") Tj "))
    head = F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 5 0 R] /MediaBox [0 0 400 400] >> endobj\n")
    files = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.concat(head, page(3, F.concat(line(0), F.lit("T* "), line(1))), page(5, line(2))).cast("binary").alias("content"))
    return pdf.read_pages(files).select("path", "page", "text", F.size("boxes").alias("n_boxes"))


@query("session_upsert", f"SELECT * FROM {SESSIONS_SQL}")
def session_upsert(spark, sf):
    return D.sessions(table(spark, sf, "conversations"))


@query("session_list", f"SELECT conv_id, title FROM {SESSIONS_SQL} WHERE conv_id % 5 = 2 ORDER BY updated DESC, conv_id")
def session_list(spark, sf):
    return D.sessions(table(spark, sf, "conversations")).where("conv_id % 5 = 2").orderBy(F.desc("updated"), "conv_id").select("conv_id", "title")


USERS = Fixture("user_id int, role string", [(0, "OFFICER"), (1, "ADMIN"), (2, "OFFICER")])


@query("session_access", f"SELECT s.conv_id, u.user_id, s.conv_id % 5 = u.user_id OR u.role = 'ADMIN' AS allowed FROM {SESSIONS_SQL} s JOIN {USERS.sql()} u ON u.user_id = s.conv_id % 3")
def session_access(spark, sf):
    """Every session is asked for by one user: the owner and administrators may see it."""
    s = D.sessions(table(spark, sf, "conversations")).select("conv_id", (F.col("conv_id") % 3).alias("user_id"))
    return s.join(USERS.df(spark), "user_id").select("user_id", "conv_id", ((F.col("conv_id") % 5 == F.col("user_id")) | (F.col("role") == "ADMIN")).alias("allowed"))


FILES = Fixture("path string, stem string, go string", [("a/8102018.pdf", "8102018", "GO-667/X-3"), ("a/order_115.pdf", "order_115", "115/XXX(4)/2018"), ("b/forest-notice.pdf", "forest-notice", "GO-99"), ("b/115x.pdf", "115x", "GO-1158")])
WANTED = Fixture("key string", [("115/XXX(4)/2018",), ("GO-667",), ("forest-notice",), ("xx notice yy",), ("zzz",), ("order 1158",)])


@query("resolve_document", f"""WITH k AS (SELECT key, clean, nullif(regexp_extract(clean, '\\b(\\d{{2,5}})\\b', 1), '') AS core FROM (SELECT key, trim(regexp_replace(trim(key), '^(?:UK-)?(?:GO|ORDER|NOTIFICATION)[-_/\\s:]*', '', 'i')) AS clean FROM {WANTED.sql()})),
  h AS (SELECT key, path, CASE WHEN go = key THEN 1 WHEN contains(go, clean) THEN 2 WHEN contains(go, core) THEN 3 WHEN lower(stem) IN (lower(key), lower(clean)) THEN 4 WHEN len([t FOR t IN regexp_split_to_array(clean, '[/\\-_\\s().]+') IF length(t) >= 3 AND contains(lower(stem), lower(t))]) > 0 THEN 5 END AS rule FROM k, {FILES.sql()})
  SELECT w.key, x.path FROM {WANTED.sql()} w LEFT JOIN (SELECT * FROM h WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rule, path) = 1) x USING (key)""")
def resolve_document(spark, sf):
    return D.resolve(WANTED.df(spark), FILES.df(spark))


CHUNKS_SQL = "(SELECT 'GO-' || conv_id % 40 AS go_number, turn AS page, conv_id AS chunk_index, CASE WHEN conv_id % 3 > 0 THEN [conv_id % 10 / 10.0::DOUBLE, turn / 100.0::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE] END AS box FROM conversations)"
ASKED_SQL = "(SELECT doc_id AS row_id, 'GO-' || doc_id % 45 AS go_number, doc_id % 4 AS page FROM documents)"
CITED_SQL = "(SELECT 'GO-' || item_id % 42 AS go_number, item_id % 4 AS page, CASE WHEN item_id % 6 = 0 THEN [0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, item_id / 1000.0::DOUBLE] END AS box FROM benchmark)"


def _go(column: str, n: int):
    return F.concat(F.lit("GO-"), (F.col(column) % n).cast("string")).alias("go_number")


@query("source_highlight", f"""WITH own AS (SELECT go_number, page, min(box) AS box FROM {CITED_SQL} WHERE box IS NOT NULL GROUP BY 1, 2), first AS (SELECT go_number, page, arg_min(box, chunk_index) AS box FROM {CHUNKS_SQL} WHERE box IS NOT NULL GROUP BY 1, 2), known AS (SELECT DISTINCT go_number FROM {CITED_SQL})
  SELECT row_id, CASE WHEN k.go_number IS NULL THEN 'violation' ELSE 'ok' END AS status, CASE WHEN k.go_number IS NOT NULL THEN array_to_string([round(x, 4) FOR x IN coalesce(own.box, first.box)], ' ') END AS box FROM {ASKED_SQL} a LEFT JOIN known k USING (go_number) LEFT JOIN own ON own.go_number = a.go_number AND own.page = a.page LEFT JOIN first ON first.go_number = a.go_number AND first.page = a.page""")
def source_highlight(spark, sf):
    chunks = table(spark, sf, "conversations").select(_go("conv_id", 40), F.col("turn").alias("page"), F.col("conv_id").alias("chunk_index"), F.when(F.col("conv_id") % 3 > 0, F.array(F.col("conv_id") % 10 / 10.0, F.col("turn") / 100.0, F.lit(0.5), F.lit(0.1))).alias("box"))
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), _go("doc_id", 45), (F.col("doc_id") % 4).alias("page"))
    cited = table(spark, sf, "benchmark").select(_go("item_id", 42), (F.col("item_id") % 4).alias("page"), F.when(F.col("item_id") % 6 == 0, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.col("item_id") / 1000.0)).alias("box"))
    out = D.highlights(asked, cited, chunks)
    return out.withColumn("box", F.array_join(F.transform("box", lambda x: F.round(x, 4).cast("string")), " "))


STATES_SQL = "(SELECT user_id AS thread_id, event_id AS seq, props AS state FROM events)"


@query("checkpoint_resume", f"SELECT t.thread_id, x.seq, x.state FROM (SELECT DISTINCT conv_id AS thread_id FROM conversations) t LEFT JOIN (SELECT thread_id, max(seq) AS seq, arg_max(state, seq) AS state FROM {STATES_SQL} GROUP BY thread_id) x USING (thread_id)")
def checkpoint_resume(spark, sf):
    """Two writes of thread states, then every conversation resumes what its thread has."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.col("props").alias("state"))
    stored = D.checkpointed(D.checkpointed(e.limit(0), e.where("seq % 2 = 0")), e.where("seq % 2 = 1"))
    return D.resumed(stored, table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id")).distinct())


@query("truncate_all", "SELECT 2 AS emptied, 0 AS left_over")
def truncate_all(spark, sf):
    """Two stored tables are emptied in a folder of their own; a third path has none."""
    at = f"{folder(spark)}/truncate-{uuid.uuid4().hex}"
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{at}/{name}")
    done = D.truncate(spark, f"{at}/labels", f"{at}/benchmark", f"{at}/absent")
    left = spark.read.parquet(f"{at}/labels").agg(F.count(F.lit(1)).cast("int").alias("left_over"))
    return left.select(F.lit(done).alias("emptied"), "left_over")


@query("embedding_dimension", "SELECT vec_id, len(embedding) = 64 AND vec_id % 9 <> 0 AS fits FROM embeddings")
def embedding_dimension(spark, sf):
    """Vectors of another length than the table's wait; a ninth of them are cut here."""
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    good, rest = indic.of_dimension(e, 64)
    return good.select("vec_id", F.lit(True).alias("fits")).unionByName(rest.select("vec_id", F.lit(False).alias("fits")))


@query("embed_texts")
def embed_texts(spark, sf):
    """No SQL: the stand-in for a model hashes in a chain."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("t"))
    return indic.embedded(d, dims=64).select("row_id", "embedding")


@query("legacy_decode_v1")
def legacy_decode_v1(spark, sf):
    """No SQL: replacements in sequence."""
    return RAW.df(spark).select("row_id", indic.decoded(F.col("t"), plain=True).alias("t"))


@query("recency_bucket", "SELECT event_id, CASE WHEN d <= 0 THEN 'Today' WHEN d <= 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 Days' ELSE 'Older' END AS bucket FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS d FROM events)")
def recency_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", D.recency(F.col("ts"), F.lit("2024-01-30")).alias("bucket"))


@query("note_paragraphs", "SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(p) AS digest FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, [regexp_replace(trim(x), '^[-*•]\\s*', '') FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS ps FROM documents))")
def note_paragraphs(spark, sf):
    ps = F.transform(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(F.trim(s), r"^[-*•]\s*", ""))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(ps).alias("i", "p"))
    return d.select("doc_id", (F.col("i") + 1).alias("i"), F.sha2("p", 256).alias("digest"))


@query("feedback_agg", "SELECT quality, toxic, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM labels GROUP BY quality, toxic")
def feedback_agg(spark, sf):
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good), 6).alias("score"))


LOG_SQL = "(SELECT user_id AS session, event_id AS seq, event_type AS field, props AS value FROM events)"


def log(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.col("props").alias("value"))


@query("reduce_immutable", f"SELECT session, field, arg_min(value, seq) AS value, count(DISTINCT value) > 1 AS violated FROM {LOG_SQL} WHERE value <> '' GROUP BY session, field")
def reduce_immutable(spark, sf):
    return S.immutable(log(spark, sf))


@query("reduce_append", f"SELECT session, field, count(value) AS n, md5(string_agg(value, '|' ORDER BY seq)) AS digest FROM {LOG_SQL} WHERE value IS NOT NULL GROUP BY session, field")
def reduce_append(spark, sf):
    x = S.appended(log(spark, sf))
    return x.select("session", "field", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "|").cast("binary")).alias("digest"))


@query("reduce_merge", f"SELECT session, field, value, CAST(row_number() OVER (PARTITION BY session ORDER BY first) AS INTEGER) AS place FROM (SELECT session, field, arg_max(value, seq) AS value, min(seq) AS first FROM {LOG_SQL} GROUP BY session, field)")
def reduce_merge(spark, sf):
    return S.merged(log(spark, sf))


@query("reduce_last", f"SELECT session, field, arg_max(value, seq) AS value FROM {LOG_SQL} WHERE value IS NOT NULL GROUP BY session, field")
def reduce_last(spark, sf):
    return S.last(log(spark, sf))


@query("breaker_fold", "WITH x AS (SELECT user_id AS session, event_id AS seq, value >= 5 AS ok, sum(CASE WHEN value >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events), s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session, run ORDER BY seq) AS streak FROM x) SELECT session, seq, CASE WHEN max(streak) OVER (PARTITION BY session ORDER BY seq) >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM s")
def breaker_fold(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("value") >= 5).alias("ok"))
    return S.breaker(e)


HITL_SQL = "(SELECT user_id AS session, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'request' ELSE 'decision' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'approve' WHEN event_id % 3 = 1 THEN 'deny' ELSE 'approve_with_edit' END AS action FROM events)"


def reviews(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "request").otherwise("decision")
    action = F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, "deny").otherwise("approve_with_edit")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), action.alias("action"))


@query("hitl_state", f"SELECT session, seq, CASE WHEN action IN ('approve', 'approve_with_edit') THEN 'grounded_synthesis' ELSE 'refusal_redirect' END AS status, action FROM (SELECT *, lag(kind) OVER (PARTITION BY session ORDER BY seq) AS before FROM {HITL_SQL}) WHERE kind = 'decision' AND before = 'request'")
def hitl_state(spark, sf):
    return V.review_batch(reviews(spark, sf))


@query("event_log", "SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_log(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), F.row_number().over(w).alias("seq"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("events_window", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_window(spark, sf):
    return V.windowed(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


RAW = Fixture("row_id int, t string", [
    (1, "दनिांक 12 जनवरी"), (2, "संस्ततुि सहित अधकिारी"), (3, "कार्मििक वभिाग"), (4, "सं० 146 दि० 12 रु० 50,000"), (5, "plain ascii  text"), (6, "क\u094d\u093cष"), (7, "शासना देश संख्\u200cया"), (8, ""), (9, None), (10, "e\u0301te\u0301"), (11, "प ् रति"), (12, "mRrjk[k.M 'kklu la[;k 146/XXVII(1)/2018 Dated 12-01-2018"), (13, "foHkkx fnukad nsgjknwu Department of Forest"),
])


@query("nfc", f"SELECT row_id, nfc_normalize(t) AS t FROM {RAW.sql()}")
def nfc(spark, sf):
    rows, plain = RAW.df(spark), F.coalesce(F.col("t").rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    return rows.where(plain).unionByName(rows.where(~plain).select("row_id", indic.nfc(F.col("t")).alias("t")))


@query("nukta_repair", f"SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\\x{{0915}}-\\x{{0939}}])\\x{{094D}}\\x{{093C}}', '\\1\u093c\u094d', 'g'), '([\\x{{0915}}-\\x{{0939}}])([\\x{{093E}}-\\x{{094C}}\\x{{0962}}\\x{{0963}}])\\x{{093C}}', '\\1\u093c\\2', 'g'), '(^|[\\s\\p{{P}}])\\x{{093C}}+', '\\1', 'g'), '(^|[\\s\\p{{P}}])\\x{{094D}}+', '\\1', 'g'), '\\x{{093C}}{{2,}}', '\u093c', 'g') AS t FROM {RAW.sql()}")
def nukta_repair(spark, sf):
    return RAW.df(spark).select("row_id", indic.nukta(F.col("t")).alias("t"))


@query("matra_repair")
def matra_repair(spark, sf):
    """No SQL: the rules look behind."""
    return RAW.df(spark).select("row_id", indic.matras(F.col("t")).alias("t"))


@query("phoneme_repair")
def phoneme_repair(spark, sf):
    return RAW.df(spark).select("row_id", indic.phonemes(F.col("t")).alias("t"))


@query("abbrev_sign")
def abbrev_sign(spark, sf):
    return RAW.df(spark).select("row_id", indic.abbreviations(F.col("t")).alias("t"))


@query("normalize_text")
def normalize_text(spark, sf):
    """The whole normaliser over all documents and the fixture."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("t"))
    both = d.unionByName(RAW.df(spark).select((-F.col("row_id")).cast("long").alias("row_id"), "t"))
    return both.select("row_id", indic.normalised(F.col("t")).alias("t"))


@query("legacy_decode")
def legacy_decode(spark, sf):
    return RAW.df(spark).select("row_id", indic.decoded(F.col("t")).alias("t"))


@query("triage")
def triage(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("t"))
    both = d.unionByName(RAW.df(spark).select((-F.col("row_id")).cast("long").alias("row_id"), "t"))
    return indic.triaged(both, K.garbage(F.col("t")))


@query("hash_embedding")
def hash_embedding(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", indic.hash_vector(F.col("text")).alias("embedding"))
