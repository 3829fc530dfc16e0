"""Queries of table arithmetic, table text, page text and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, indic, money
from ..functions import text as X
from ..operators import chunks as K
from ..operators import tables as T
from .registry import Fixture, case, literal, query, table

MONEY = Fixture("row_id int, t string", [
    (1, "1,25,50,000"), (2, "(50,000.00)"), (3, "15.5 लाख"), (4, "१२.५"), (5, "km 5"), (6, ""), (7, None), (8, "Rs. 2 crore"), (9, "-400"), (10, "abc"), (11, "₹ 3,000/-"), (12, "2 thousand"), (13, "1.5 करोड़"), (14, "0"), (15, "7 lacs"),
])
DIGITS = f"translate({{x}}, '{fixed.DEVANAGARI_DIGITS}', '{fixed.ASCII_DIGITS}')"


def money_sql(x: str) -> str:
    whens = " ".join(f"WHEN contains(b, {literal(w)}) THEN {{}}".format(v) for w, v in fixed.SCALES)
    rest = " ".join(f"WHEN contains(b, {literal(w)}) THEN trim(replace(b, {literal(w)}, ''))" for w, _ in fixed.SCALES)
    return f"""(SELECT CAST(CASE WHEN neg THEN -abs(v) ELSE v END * f AS DECIMAL(38,6)) FROM (SELECT neg, f, TRY_CAST(nullif(regexp_extract(regexp_replace(r, '[₹$£€]|rs\\.?|inr|[,/\\-''"\\s]', '', 'g'), '([-+]?\\d+(?:\\.\\d+)?)', 1), '') AS DECIMAL(18,6)) AS v
      FROM (SELECT neg, CASE {whens} ELSE 1 END AS f, CASE {rest} ELSE b END AS r FROM (SELECT neg, CASE WHEN neg THEN trim(m, '()- ') ELSE m END AS b FROM (SELECT m, regexp_matches(m, '^\\(.*\\)$') OR starts_with(m, '-') AS neg FROM (SELECT lower(trim({DIGITS.format(x=x)})) AS m))))))"""


@query("money_parse", f"SELECT row_id, CAST({money_sql('t')} AS DOUBLE) AS amount FROM {MONEY.sql()}")
def money_parse(spark, sf):
    return MONEY.df(spark).select("row_id", money.parse_money(F.col("t")).cast("double").alias("amount"))


HEADERS = Fixture("row_id int, h string", [(1, "धनराशि (लाख में)"), (2, "Amount in crores"), (3, "Rs. in thousands"), (4, "Name | Place"), (5, "राशि करोड़ में"), (6, "total k")])


@query("scale_detect", f"SELECT row_id, CASE {' '.join(f'WHEN regexp_matches(lower(h), {literal(chr(40) + chr(63) + chr(58) + w + chr(41) + chr(40) + chr(63) + chr(58) + chr(91) + chr(94) + chr(92) + chr(112) + chr(123) + chr(76) + chr(125) + chr(92) + chr(112) + chr(123) + chr(77) + chr(125) + chr(93) + chr(124) + chr(36) + chr(41))}) THEN {v}' for w, v, _ in fixed.HEADER_SCALES)} ELSE 1 END AS factor FROM {HEADERS.sql()}")
def scale_detect(spark, sf):
    return HEADERS.df(spark).select("row_id", money.scale_of(F.col("h"))[0].alias("factor"))


LINES_SQL = """(SELECT l_orderkey AS table_id, CAST(l_linenumber AS INTEGER) AS r, CAST(printf('%.2f', l_extendedprice) AS DECIMAL(38,6)) AS v FROM lineitem)"""
DECLARED_SQL = f"(SELECT table_id, CAST(CASE WHEN table_id % 11 = 0 THEN NULL ELSE sum(v) + CASE WHEN table_id % 5 = 0 THEN 100 ELSE 0 END END AS DECIMAL(38,6)) AS declared FROM {LINES_SQL} GROUP BY table_id)"
SUMS_SQL = f"(SELECT l.table_id, CASE WHEN max(declared) IS NOT NULL THEN CAST(sum(v) AS DOUBLE) END AS computed, CAST(max(declared) AS DOUBLE) AS declared, coalesce(abs(sum(v) - max(declared)) <= 0.01, TRUE) AS valid FROM {LINES_SQL} l JOIN {DECLARED_SQL} d USING (table_id) GROUP BY l.table_id)"


def order_cells(spark, sf):
    """Each order as a table of texts: a row for each line and, but for some orders, a row with a total as it is written by
    hand: grouped digits, and wrong by 100 for some."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("r"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("a"), F.format_string("%.2f", "l_extendedprice").alias("b"))
    wrong = F.when(F.col("table_id") % 5 == 0, F.lit(100)).otherwise(F.lit(0))
    total = x.where("table_id % 11 <> 0").groupBy("table_id").agg(F.sum(F.col("b").cast("decimal(18,2)")).alias("s"))
    total = total.select("table_id", F.lit(1000).alias("r"), F.lit("Grand Total").alias("a"), F.concat(F.lit("Rs. "), F.format_number((F.col("s") + wrong).cast("decimal(20,2)"), 2)).alias("b"))
    cells = x.unionByName(total).select("table_id", "r", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.lit("Item").alias("header"), F.col("a").alias("t")), F.struct(F.lit(1).alias("c"), F.lit("Amount").alias("header"), F.col("b").alias("t")))).alias("x"))
    return cells.select("table_id", "r", "x.*", F.lit(0.9).alias("confidence"))


@query("table_sum_check", f"SELECT * FROM {SUMS_SQL}")
def table_sum_check(spark, sf):
    return T.verified(order_cells(spark, sf)).select("table_id", F.col("computed").cast("double").alias("computed"), F.col("declared").cast("double").alias("declared"), "valid")


CELLS = Fixture("table_id int, r int, c int, header string, t string, confidence double", [
    (1, 0, 0, "Item", "A", 0.9), (1, 0, 1, "Sanctioned", "1000", 0.9), (1, 0, 2, "Expenditure", "400", 0.9), (1, 0, 3, "Balance", "600", 0.9), (2, 0, 0, "Item", "B", 0.9), (2, 0, 1, "Sanctioned", "1000", 0.9), (2, 0, 2, "Spent", "400", 0.9), (2, 0, 3, "Balance", "700", 0.9),
    (3, 0, 0, "Item", "x", 0.99), (3, 0, 1, "Amount", "80000", 0.7), (3, 1, 0, "Item", "y", 0.99), (3, 1, 1, "Amount", "20000", 0.995), (3, 2, 0, "Item", "कुल योग", 0.99), (3, 2, 1, "Amount", "50000", 0.99),
    (4, 0, 0, "Item", "p", 1.0), (4, 0, 1, "Amount", "10", 1.0), (4, 1, 0, "Item", "Grand Total", 1.0), (4, 1, 1, "Amount", "10", 1.0), (5, 0, 0, "Item", "no total", 1.0), (5, 0, 1, "Amount", "5", 1.0),
    (6, 0, 0, "Total heads", "total of nothing", 1.0), (6, 1, 0, "Total heads", "a", 1.0), (6, 1, 1, "Sanctioned", "9", 0.8), (6, 2, 0, "Total heads", "कुल", 1.0), (6, 2, 1, "Sanctioned", "9", 1.0),
    (7, 0, 0, "Sanctioned", "1", 1.0), (7, 0, 1, "Sanctioned revised", "1000", 1.0), (7, 0, 2, "Spent", "400", 1.0), (7, 0, 3, "Balance", "600", 1.0), (7, 1, 0, "Sanctioned", "Total", 1.0), (7, 1, 3, "Balance", "600", 1.0),
    (8, 0, 0, "Sanctioned", "10", 0.5), (8, 0, 1, "Spent", "5", 0.5), (8, 0, 2, "Balance", "4", 0.5), (8, 1, 0, "Sanctioned", "Total", 1.0), (8, 1, 2, "Balance", "4", 1.0),
])
CELLS_V = f"(SELECT *, {money_sql('t')} AS v, {' OR '.join(f'contains(lower(trim(t)), {literal(w)})' for w in fixed.TOTAL_WORDS)} AS tot FROM {CELLS.sql()})"
TOTALS_SQL = f"(SELECT table_id, r AS total_row, arg_max(c, c) AS total_col, arg_max(v, c) AS total FROM (SELECT c.* FROM {CELLS_V} c JOIN (SELECT table_id, min(r) AS r FROM (SELECT table_id, r FROM {CELLS_V} GROUP BY table_id, r HAVING bool_or(tot) AND count(v) > 0) GROUP BY table_id) t USING (table_id, r)) WHERE v IS NOT NULL GROUP BY table_id, r)"


@query("find_total", f"SELECT table_id, total_row, total_col, CAST(total AS DOUBLE) AS total FROM {TOTALS_SQL}")
def find_total(spark, sf):
    return T.totals(T.valued(CELLS.df(spark))).withColumn("total", F.col("total").cast("double"))


ROLE_SQL = " ".join(f"WHEN {' OR '.join(f'contains(lower(header), {literal(w)})' for w in ws)} THEN '{n}'" for n, ws in (("sanctioned", fixed.SANCTIONED), ("spent", fixed.SPENT), ("balance", fixed.BALANCE)))


BALANCE_SQL = f"""(SELECT table_id, bool_and(coalesce(abs(a - s - b) <= 0.01, TRUE)) AS valid FROM (SELECT table_id, r, max(CASE WHEN role = 'sanctioned' THEN v END) AS a, max(CASE WHEN role = 'spent' THEN v END) AS s, max(CASE WHEN role = 'balance' THEN v END) AS b
  FROM (SELECT x.*, CASE WHEN c = max(c) OVER (PARTITION BY table_id, kind) THEN kind END AS role FROM (SELECT *, CASE {ROLE_SQL} END AS kind FROM {CELLS_V}) x) GROUP BY table_id, r) GROUP BY table_id)"""


@query("horizontal_balance", f"SELECT * FROM {BALANCE_SQL}")
def horizontal_balance(spark, sf):
    return T.balances(T.valued(CELLS.df(spark)))


CHECK_SQL = f"""(SELECT table_id, computed, declared, declared IS NULL OR (abs(computed - declared) <= 0.01 AND b.valid) AS valid FROM (SELECT i.table_id, CAST(max(t.total) AS DOUBLE) AS declared, CASE WHEN max(t.total) IS NOT NULL THEN coalesce(CAST(sum(CASE WHEN x.c = t.total_col AND x.r <> t.total_row THEN x.v END) AS DOUBLE), 0.0) END AS computed
  FROM (SELECT DISTINCT table_id FROM {CELLS.sql()}) i JOIN {CELLS_V} x USING (table_id) LEFT JOIN {TOTALS_SQL} t USING (table_id) GROUP BY i.table_id) JOIN {BALANCE_SQL} b USING (table_id))"""


@query("table_check", f"SELECT * FROM {CHECK_SQL}")
def table_check(spark, sf):
    """Sum and balance of the fixture's tables: the balance counts only where the sum holds."""
    return T.verified(CELLS.df(spark)).select("table_id", F.col("computed").cast("double").alias("computed"), F.col("declared").cast("double").alias("declared"), "valid")


@query("reread_cells", "SELECT * FROM (VALUES (3, 80000.0::DOUBLE, 50000.0::DOUBLE, FALSE, 30000.0::DOUBLE, TRUE)) v(table_id, computed, declared, valid, healed, healed_valid)")
def reread_cells(spark, sf):
    """The doubtful cell of the table whose sum fails is read again, and the sum holds."""
    cells = CELLS.df(spark).where("table_id <> 3 OR r <> 1")
    readings = T.doubtful(cells).select("table_id", "r", "c", F.lit("50,000").alias("reading"))
    after = T.verified(T.reread(cells, readings)).select("table_id", F.col("computed").alias("healed"), F.col("valid").alias("healed_valid"))
    x = T.verified(cells).join(after, "table_id").where("NOT valid AND table_id = 3")
    return x.select("table_id", *[F.col(c).cast("double").alias(c) for c in ("computed", "declared")], "valid", (F.col("healed") - 20000).cast("double").alias("healed"), "healed_valid")


CONF_ROWS = ", ".join(f"({literal(a)}, {literal(b)}, {p})" for a, b, p in fixed.CONFUSIONS)


@query("confusion_candidates", f"""WITH f(d, alt, penalty) AS (VALUES {CONF_ROWS}) SELECT table_id, r, c, CAST(left(n, i - 1) || alt || substr(n, i + 1) AS DOUBLE) AS candidate, CAST(penalty AS DOUBLE) AS penalty
  FROM (SELECT table_id, r, c, n, unnest(range(1, length(n) + 1)) AS i FROM (SELECT table_id, r, c, regexp_replace(t, '[^0-9.]', '', 'g') AS n FROM {CELLS.sql()}) WHERE n <> '') JOIN f ON substr(n, i, 1) = f.d""")
def confusion_candidates(spark, sf):
    return T.candidates(CELLS.df(spark)).select("table_id", "r", "c", F.col("candidate").cast("double").alias("candidate"), "penalty")


@query("constraint_solve")
def constraint_solve(spark, sf):
    """No SQL: a bounded search. Tests compare it with exhaustive enumeration."""
    return T.solved(T.valued(CELLS.df(spark)))


STITCH = Fixture("page int, t int, headers array<string>, rows int", [(1, 0, ["a", "b"], 3), (2, 0, ["a", "b"], 2), (3, 0, [], 4), (4, 0, ["x", "y", "z"], 1), (5, 0, ["x", "y", "z"], 2), (6, 0, ["q"], 2), (7, 0, ["q"], 1)])


@query("stitch_tables", f"""SELECT page, t, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (ORDER BY page, t) AS BIGINT) AS grp FROM (SELECT page, t, coalesce(page = lag(page) OVER w + 1 AND ((len(headers) > 1 AND headers = lag(headers) OVER w) OR len(headers) = 0), FALSE) AS joins FROM {STITCH.sql()} WINDOW w AS (ORDER BY page, t))""")
def stitch_tables(spark, sf):
    return T.stitched(STITCH.df(spark).withColumn("doc", F.lit(1))).select("page", "t", F.col("grp").cast("long").alias("grp"))


ITEMS = Fixture("item int, y double, x double, t string, confidence double", [(1, 0.1, 0.1, "a", 0.9), (2, 0.11, 0.5, "b", 0.8), (3, 0.2, 0.1, "c", 0.9), (4, 0.22, 0.5, "", 0.9), (5, 0.5, 0.1, "d", 0.7), (6, 0.51, 0.9, "e", 0.95)])


@query("cluster_rows", f"SELECT item, CAST(sum(CASE WHEN y - prev < 0.025 THEN 0 ELSE 1 END) OVER (ORDER BY y, item) AS BIGINT) AS grp FROM (SELECT item, y, lag(y) OVER (ORDER BY y, item) AS prev FROM {ITEMS.sql()})")
def cluster_rows(spark, sf):
    return T.clustered(ITEMS.df(spark).withColumn("page", F.lit(1))).select("item", F.col("grp").cast("long").alias("grp"))


@query("fill_merged", f"SELECT item, coalesce(last_value(nullif(t, '') IGNORE NULLS) OVER (ORDER BY item ROWS UNBOUNDED PRECEDING), '') AS t, t = '' AS merged FROM {ITEMS.sql()}")
def fill_merged(spark, sf):
    w = Window.partitionBy(F.lit(1)).orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return ITEMS.df(spark).select("item", F.coalesce(F.last(F.nullif(F.col("t"), F.lit("")), ignorenulls=True).over(w), F.lit("")).alias("t"), (F.col("t") == "").alias("merged"))


GRID = Fixture("cell int, y0 double, x0 double, y1 double, x1 double", [(1, 0.0, 0.0, 0.15, 0.3), (2, 0.0, 0.3, 0.15, 1.0), (3, 0.15, 0.0, 0.6, 1.0)])


@query("box_join", f"SELECT cell, string_agg(t, ' ' ORDER BY item) AS t, min(confidence) AS confidence FROM {GRID.sql()} g JOIN {ITEMS.sql()} i ON i.y >= g.y0 AND i.y < g.y1 AND i.x >= g.x0 AND i.x < g.x1 GROUP BY cell")
def box_join(spark, sf):
    return T.boxed(ITEMS.df(spark), GRID.df(spark))


GFM = Fixture("page int, t string", [(1, "intro\n| a | b | c |\n| --- | :--- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 |\n\ntail"), (2, "no table"), (3, "| x | y |\n|---|---|\n| p | q |\n| r | s |\n| t | u |"), (4, None)])


@query("gfm_parse")
def gfm_parse(spark, sf):
    """No SQL: islands of lines with a delimiter row. Tests compare it with a line-by-line parser."""
    return T.parsed(GFM.df(spark))


@query("gfm_render", f"SELECT table_id, '| ' || string_agg(h, ' | ' ORDER BY c) || ' |' AS header FROM (SELECT table_id, c, coalesce(nullif(replace(any_value(header), '|', '-'), ''), 'Col_' || (c + 1)) AS h FROM {CELLS.sql()} GROUP BY table_id, c) GROUP BY table_id")
def gfm_render(spark, sf):
    return T.rendered_headers(CELLS.df(spark))


@query("table_to_json", f"SELECT table_id, r, c, CAST(v AS DOUBLE) AS v FROM {CELLS_V} WHERE v IS NOT NULL")
def table_to_json(spark, sf):
    j = T.valued(CELLS.df(spark)).where("v IS NOT NULL").select(F.to_json(F.struct("table_id", "r", "c", F.col("v").cast("double").alias("v"))).alias("j"))
    return j.select(F.from_json("j", "table_id int, r int, c int, v double").alias("x")).select("x.*")


JSONS = Fixture("row_id int, j string", [(1, "[0.1, 0.2, 0.3, 0.4]"), (2, "oops"), (3, None), (4, "[1,2]"), (5, "{}")])


@query("parse_bbox", f"SELECT row_id, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN len(CAST(j AS JSON)::DOUBLE[]) ELSE -1 END AS n FROM {JSONS.sql()}")
def parse_bbox(spark, sf):
    b = F.when(F.col("j").startswith("["), F.from_json("j", "array<double>"))
    return JSONS.df(spark).select("row_id", F.size(b).cast("long").alias("n")).withColumn("n", F.coalesce("n", F.lit(-1)))


@query("doc_all_valid", f"SELECT table_id % 10 AS doc, bool_and(valid) AS all_valid FROM {SUMS_SQL} x GROUP BY 1")
def doc_all_valid(spark, sf):
    return table_sum_check(spark, sf).groupBy((F.col("table_id") % 10).alias("doc")).agg(F.bool_and("valid").alias("all_valid"))


ENTROPY_SQL = "SELECT doc_id, round(-sum(n / t * log2(n / t)), 3) AS entropy FROM (SELECT doc_id, ch, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) AS t FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id"


@query("char_entropy", ENTROPY_SQL)
def char_entropy(spark, sf):
    return K.entropy(table(spark, sf, "documents").select("doc_id", "text"))


@query("script_ratios", "SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE len(regexp_extract_all(s, '[\\x{0900}-\\x{097F}]')) / n END, 6) AS devanagari, round(CASE WHEN n = 0 THEN 0.0 ELSE len(regexp_extract_all(s, '[^\\p{L}\\p{N}\\x{0900}-\\x{097F}]')) / n END, 6) AS punctuation FROM (SELECT doc_id, s, length(s) AS n FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM documents))")
def script_ratios(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(X.ratio_of(t, X.DEVANAGARI), 6).alias("devanagari"), F.round(X.ratio_of(t, r"[^\p{L}\p{N}\x{0900}-\x{097F}]"), 6).alias("punctuation"))


MIXED = Fixture("doc_id long, text string", [
    (-1, "वन विभाग kqxz wprtl mnbvc zxcvb qwrty plkjh"), (-2, "वन विभाग order of the forest department dated 2018"), (-3, "abc"), (-4, ""), (-5, "oe qff gibo and other words here"), (-6, "gibo " + "plain words " * 20), (-7, "!!! ??? --- abc def ,,, ;;; ..."), (-8, "क (kqxz), [wprtl]; mnbvc: zx one two"),
])
PAGES_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {MIXED.sql()})"


@query("garbage_detect", f"""SELECT doc_id, CASE WHEN text = '' THEN 'fine' WHEN n < 15 THEN 'too_short' WHEN m >= 2 OR (m >= 1 AND n < 100) THEN 'mojibake' WHEN d / n > 0 AND d / n < 0.35 AND odd / len(ts) > 0.4 THEN 'mixed_latin' WHEN p / n > 0.3 AND d / n < 0.2 THEN 'punctuation' ELSE 'fine' END AS verdict FROM (SELECT doc_id, text, ts, length(s) AS n, len([w FOR w IN {literal(fixed.MOJIBAKE)} IF contains(lower(text), w)]) AS m,
  len([t FOR t IN [trim(x, ' ,;:.()[]{{}}"' || chr(39)) FOR x IN ts] IF regexp_full_match(t, '[A-Za-z]{{3,}}') AND NOT list_contains({literal(indic.english_words())}, lower(t))]) AS odd,
  len(regexp_extract_all(s, '[^\\p{{L}}\\p{{N}}\\x{{0900}}-\\x{{097F}}]')) AS p, len(regexp_extract_all(s, '[\\x{{0900}}-\\x{{097F}}]')) AS d FROM (SELECT doc_id, text, regexp_replace(text, '\\s+', '', 'g') AS s, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS ts FROM {PAGES_SQL}))""")
def garbage_detect(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "text").unionByName(MIXED.df(spark))
    return both.select("doc_id", K.garbage(F.col("text")).alias("verdict"))


DATES = Fixture("row_id int, t string", [(1, "दिनांक 12 जनवरी, 2018"), (2, "Dated 08/10/2018"), (3, "दिनांक: 31-02-2019 x"), (4, "in the year 2015 only"), (5, "nothing"), (6, "दिनांक १९ मार्च, २०१८"), (7, "99/99/2018 and 05.06.2020"), (8, None), (9, "Dated 5 Foo 2018 2011")])


@query("date_extract")
def date_extract(spark, sf):
    """No SQL: the first match that passes its bounds decides. Tests compare it with a rule-by-rule version."""
    return DATES.df(spark).select("row_id", X.date_of(F.col("t")).alias("issued"))


@query("year_extract", f"SELECT row_id, coalesce(CAST(nullif(regexp_extract(t, '\\b(19\\d\\d|20\\d\\d)\\b', 1), '') AS INTEGER), 2018) AS y FROM {DATES.sql()}")
def year_extract(spark, sf):
    return DATES.df(spark).select("row_id", X.year_of(F.col("t")).alias("y"))


NUMBERS = Fixture("row_id int, t string", [
    (1, "संख्या-115/XXX(4)/2018-01(3)/2018\nदेहरादून : दिनांक 12 जनवरी"), (2, "संख्या 825 / XXXI(15)G/20-41(सा) / 2018 तददिनांक"), (3, "संख्या-___/XXXI(15)"), (4, "no number here"), (5, "GO: 146/XXVII(1)/2018 dated"), (6, ""), (7, "पत्रांक 98/XXXI/15G/2023-41\nविभाग"),
    (8, "कार्मिक अनुभाग-4\nसंख्या 115/XXX"), (9, "वित्त विभाग, उत्तराखण्ड"), (10, "forest office"), (11, "xyz"),
])


@query("order_no_extract")
def order_no_extract(spark, sf):
    """No SQL: ordered patterns with rejected candidates. Tests hold the expected numbers."""
    stem = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("scan (8) no."), F.col("row_id").cast("string")))
    return NUMBERS.df(spark).select("row_id", K.order_number(F.col("t"), stem).alias("go_number"))


@query("draft_flag", f"SELECT row_id, trim(t) = '' OR regexp_matches(t, {literal(fixed.DRAFT_NUMBER)}) OR (starts_with(t, 'GO-') AND length(t) <= 4) AS draft FROM {NUMBERS.sql()}")
def draft_flag(spark, sf):
    return NUMBERS.df(spark).select("row_id", K.is_draft(F.col("t")).alias("draft"))


@query("dept_extract", f"SELECT row_id, CASE WHEN regexp_matches(t, {literal(fixed.SECTION_NAMES)}) THEN rtrim(trim(regexp_replace(regexp_extract(t, {literal(fixed.SECTION_NAMES)}, 1), '\\s*[/\\\\]+.*$', '')), ' :-–—/\\,') ELSE {case(fixed.CANONICAL_DEPARTMENTS, 'regexp_matches(t, {p}, ' + chr(39) + 'i' + chr(39) + ')', literal('सामान्य'))} END AS department FROM {NUMBERS.sql()}")
def dept_extract(spark, sf):
    return NUMBERS.df(spark).select("row_id", K.department(F.col("t")).alias("department"))


PAGES = Fixture("doc int, page int, t string", [(1, 1, "संख्या-115/XXX(4)/2018\nदिनांक 12 जनवरी, 2018"), (1, 2, "body"), (1, 3, "संख्या 825/XXXI(15)G/2018 तददिनांक"), (2, 1, "nothing"), (2, 2, "कार्मिक अनुभाग-4\nDated 01/02/2019")])


@query("doc_metadata")
def doc_metadata(spark, sf):
    """No SQL: built on the extractors above."""
    return K.metadata(PAGES.df(spark))


@query("page_explode", "SELECT doc_id, CAST(i AS INTEGER) AS page, length(p) AS n FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents)")
def page_explode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    return d.select("doc_id", (F.col("i") + 1).alias("page"), F.length("p").cast("long").alias("n"))


@query("strip_table_lines", "SELECT doc_id, sha256(array_to_string([l FOR l IN string_split(text, chr(10)) IF NOT (starts_with(trim(l), '|') AND ends_with(trim(l), '|'))], chr(10))) AS digest FROM documents")
def strip_table_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(K.without_table_lines(F.col("text")), 256).alias("digest"))


CLAUSES = Fixture("row_id int, t string", [(1, "Intro text\n(1) first clause\n(2) second\n3. third"), (2, "2018-19 budget\nplain"), (3, "   "), (4, "one"), (5, "(10) ten\n\n(11) eleven")])


@query("clause_split")
def clause_split(spark, sf):
    """No SQL: the split looks ahead. Tests hold the expected parts."""
    return CLAUSES.df(spark).select("row_id", F.array_join(X.clauses(F.col("t")), "¦").alias("parts"))


PACK_SQL = """WITH RECURSIVE u AS (SELECT doc_id, list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> '') AS us FROM documents),
  s AS (SELECT doc_id, us, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM u UNION ALL
    SELECT doc_id, us, i + 1, CASE WHEN cur <> '' AND length(cur) + length(us[i]) > 500 THEN list_append(done, cur) ELSE done END, CASE WHEN cur = '' OR length(cur) + length(us[i]) > 500 THEN us[i] ELSE cur || chr(10) || chr(10) || us[i] END FROM s WHERE i <= len(us))
  SELECT doc_id, CAST(k AS INTEGER) AS k, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, generate_subscripts(cs, 1) AS k, unnest(cs) AS c FROM (SELECT doc_id, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS cs FROM s WHERE i = len(us) + 1))"""


@query("clause_pack", PACK_SQL)
def clause_pack(spark, sf):
    units = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(X.packed(units, 500)).alias("k", "c"))
    return d.select("doc_id", (F.col("k") + 1).alias("k"), F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("chunk_bbox", "SELECT doc_id, round(ymin, 4) AS ymin, round(least(ymin + greatest(h, step * 0.85), 0.92), 4) AS ymax FROM (SELECT doc_id, 0.8 / n AS step, greatest(0.08, least(0.08 + (doc_id % n) * 0.8 / n, 0.82)) AS ymin, greatest(1, n_chars // 75) * 0.032 AS h FROM (SELECT doc_id, n_chars, 1 + doc_id % 7 AS n FROM documents))")
def chunk_bbox(spark, sf):
    d = table(spark, sf, "documents").withColumn("n", 1 + F.col("doc_id") % 7)
    b = K.clause_box(F.col("n_chars"), F.col("doc_id") % F.col("n"), F.col("n"))
    return d.select("doc_id", b.alias("b")).select("doc_id", "b.ymin", "b.ymax")


CHUNKS_SQL = """WITH x AS (SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS INTEGER) - 1 AS r, '| ' || l_partkey || ' | ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' | ' || CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag || '-' || l_linestatus ELSE '' END || ' |' AS line FROM lineitem),
  y AS (SELECT *, '| Part | Quantity | Col_3 |' || chr(10) || '| --- | --- | --- |' AS head, count(*) OVER w AS n_rows, sum(length(line) + 1) OVER w AS body FROM x WINDOW w AS (PARTITION BY table_id)),
  z AS (SELECT *, length(head) + body AS long, CASE WHEN length(head) + body <= 150 THEN n_rows ELSE greatest(2, n_rows // greatest((length(head) + body) // 100, 1)) END AS per FROM y),
  g AS (SELECT table_id, CAST((r // per) * per AS INTEGER) AS first, count(*) AS n, any_value(head) AS head, any_value(n_rows) AS n_rows, any_value(long) AS long, string_agg(line, chr(10) ORDER BY r) AS rows FROM z GROUP BY 1, 2)
  SELECT table_id, first, n, head || chr(10) || rows || CASE WHEN long <= 150 THEN '' ELSE ' [Table Slice Rows ' || (first + 1) || '-' || (first + n) || ' of ' || n_rows || ']' END AS body FROM g"""


@query("table_chunks", CHUNKS_SQL)
def table_chunks(spark, sf):
    """The lines of each order as a table of two named columns and one without a name."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    flags = F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws("|", "l_returnflag", "l_linestatus"))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), flags)
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.row_number().over(w) - 1).alias("r"), cells.alias("cells"), F.array(F.lit("Part"), F.lit("Quantity")).alias("headers"))
    return T.table_texts(rows, 100)


PERCENTS = Fixture("row_id int, v double", [(1, 85.0), (2, 0.85), (3, 1.0), (4, 100.0), (5, 2.0), (6, 101.0), (7, 0.0), (8, None), (9, 50.5)])


@query("percent_normalise", f"SELECT row_id, CASE WHEN v = floor(v) AND v > 1 AND v <= 100 THEN v / 100 ELSE v END AS share FROM {PERCENTS.sql()}")
def percent_normalise(spark, sf):
    return PERCENTS.df(spark).select("row_id", X.as_share(F.col("v")).alias("share"))
