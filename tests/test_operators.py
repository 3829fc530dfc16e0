"""Literal cases and properties of the operators that SQL cannot check."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sheafline.functions import fixed, indic, money
from sheafline.functions import text as X
from sheafline.operators import answers, chunks, lineage, retrieval, tables
from sheafline.streaming import reviews


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "amount"), [("1,25,50,000", 12550000), ("(50,000.00)", -50000), ("15.5 लाख", 1550000), ("१२.५", 12.5), ("km 5", 5000), ("", None), (None, None)])
def test_money(spark, raw, amount):
    got = one(spark, raw, money.parse_money)
    assert (None if got is None else float(got)) == amount


@pytest.mark.parametrize(
    ("text", "issued"),
    [("दिनांक 12 जनवरी, 2018", "2018-01-12"), ("Dated 08/10/2018", "2018-10-08"), ("दिनांक: 31-02-2019", "2019-02-31"), ("only 2015", "2015-01-01"), ("nothing", None), ("99/99/2018 05.06.2020", "2020-06-05"), ("दिनांक १९ मार्च, २०१८", "2018-03-19")],
)
def test_dates(spark, text, issued):
    assert one(spark, text, X.date_of) == issued


@pytest.mark.parametrize(
    ("text", "number"),
    [("संख्या-115/XXX(4)/2018-01(3)/2018\nदेहरादून : दिनांक 12 जनवरी", "GO-115/XXX(4)/2018-01(3)/2018"), ("संख्या 825 / XXXI(15)G/20-41(सा) / 2018 तददिनांक", "GO-825/XXXI(15)G/20-41(सा)/2018"), ("no number", "GO-UNKNOWN")],
)
def test_order_numbers(spark, text, number):
    assert one(spark, text, chunks.order_number) == number


def test_clauses(spark):
    assert one(spark, "Intro\n(1) first\n(2) second\n3. third", X.clauses) == ["Intro", "(1) first", "(2) second", "3. third"]
    assert one(spark, "  \n ", X.clauses) == []


def test_packing_keeps_text(spark):
    random.seed(2)
    units = ["x" * random.randint(1, 300) for _ in range(40)]
    got = spark.createDataFrame([(units,)], "u array<string>").select(X.packed(F.col("u"), 500).alias("p")).first()["p"]
    assert "\n\n".join(got) == "\n\n".join(units)
    assert all(len(c.replace("\n\n", "")) <= 500 or c in units for c in got)


def test_excerpts(spark):
    assert one(spark, r"see C:\temp\a.txt" + "\nand aaaaaaa ~~~~ end", X.clean_excerpt) == "see and aa end"


def test_grounding(spark):
    d = spark.createDataFrame([("Transfers are allowed after three years", "Transfers are allowed after three years of service", ""), ("Zeppelins vanish quickly 99,123", "unrelated matter", "")], "c string, e string, q string")
    r, ok = X.grounding(F.col("c"), F.col("e"), F.col("q"))
    assert [x["ok"] for x in d.select(r.alias("r"), ok.alias("ok")).collect()] == [True, False]


LEGACY = {"mRrjk[k.M": "उत्तराखण्ड", "'kklu": "शासन", "la[;k": "संख्या", "foHkkx": "विभाग", "fnukad": "दिनांक", "nsgjknwu": "देहरादून"}


@pytest.mark.parametrize(("seen", "meant"), LEGACY.items())
def test_legacy_fonts(seen, meant):
    assert indic.decode(seen) == meant


def test_legacy_keeps_latin():
    for kept in ("146/XXVII(1)/2018", "Dated 12-01-2018", "Department of Forest"):
        assert indic.decode(kept) == kept


def test_normaliser(spark):
    assert indic.normalise("सं० 146 दि० 12 रु० 50,000").count("\u0970") == 3
    assert "दिनांक" in indic.normalise("दनिांक 5") and "विभाग" in indic.normalise("वभिाग")
    assert one(spark, "कार्मििक", X.strip) == "कार्मििक"
    assert one(spark, "कार्मििक", indic.matras) == "कार्मिक"


@pytest.mark.parametrize("section", ["phonemes", "abbreviations"])
def test_rule_chains_equal_the_patterns(spark, section):
    rng = random.Random(4)
    words = [w for line in indic._sections("indic_rules.txt")[section] for w in re.findall(r"[\u0900-\u097f]+", line)] + ["सं०", "दिo 5", "रु.", "अ० शा०", "विभाग", "plain", "x", "।", "50,000"]
    rows = [(i, rng.choice(["", "(", "-"]).join(rng.choice([" ", "", ", "]) + rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(400)]
    f = getattr(indic, section)
    for r in spark.createDataFrame(rows, "i int, t string").select("t", f(F.col("t")).alias("x")).collect():
        assert r["x"] == indic._apply(section, r["t"])


def test_triage(spark):
    texts = ["oe qff gibo siion xx yy", "वन विभाग द्वारा अनुमति दी जाएगी यहाँ सभी को", "", "mRrjk[k.M 'kklu foHkkx la[;k fnukad nsgjknwu", "plain English words of a scanned page", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id int, t string")
    got = {r["row_id"]: r["kind"] for r in indic.triaged(rows, chunks.garbage(F.col("t"))).collect()}
    assert [got[i] for i in range(6)] == ["scanned_image", "native_unicode", "scanned_image", "legacy_font", "scanned_image", "scanned_image"]


def test_garbage_rules(spark):
    cases = [("वन विभाग kqxz wprtl mnbvc zxcvb qwrty", "mixed_latin"), ("वन विभाग order of the forest department", "fine"), ("abc", "too_short"), ("", "fine"), ("!!! ??? --- abc def ,,, ;;;", "punctuation")]
    for text, verdict in cases:
        assert one(spark, text, chunks.garbage) == verdict


def test_cover_density(spark):
    def brute(tokens, terms):
        at = [(i, t) for i, t in enumerate(tokens) if t in terms]
        spans = [(x, y) for x in range(len(at)) for y in range(x, len(at)) if {t for _, t in at[x : y + 1]} == set(terms)]
        least = [(x, y) for x, y in spans if not any((a, b) != (x, y) and a >= x and b <= y for a, b in spans)]
        return sum(0.1 / (1 + (at[y][0] - at[x][0]) - (y - x)) for x, y in least) if least else None

    rng = random.Random(5)
    rows = [([rng.choice("abcdefg") for _ in range(rng.randint(0, 25))], rng.sample("abcde", rng.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "tokens array<string>, terms array<string>").select("tokens", "terms", retrieval.cover_density(F.col("tokens"), F.col("terms")).alias("x"))
    for r in df.collect():
        want = brute(r["tokens"], r["terms"])
        assert r["x"] == (None if want is None else pytest.approx(want)), r


def test_literal_questions(spark):
    docs = spark.createDataFrame([(1, "That and onesen erblest it"), (2, "xthat andx"), (3, "THAT AND one sen"), (4, "nothing")], "id long, text string")
    asked = spark.createDataFrame([(1, "that and"), (2, "t and onesen erb"), (3, "hin"), (4, "..."), (5, "one sen that and more")], "query_id long, query_text string")
    got = {(r["query_id"], r["id"]) for r in retrieval.sparse_matches(docs, asked).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 4)}


def test_sums_in_the_scale_of_the_header(spark):
    cells = [(1, 0, 0, "Item", "a"), (1, 0, 1, "Amount in lakh", "1.5"), (1, 1, 0, "Item", "b"), (1, 1, 1, "Amount in lakh", "50 thousand"), (1, 2, 0, "Item", "Total"), (1, 2, 1, "Amount in lakh", "2")]
    got = tables.verified(spark.createDataFrame(cells, "table_id int, r int, c int, header string, t string")).first()
    assert got["valid"] and float(got["computed"]) == 200_000 == float(got["declared"])


def test_table_texts(spark):
    rows = [(1, r, [f"item {r}", str(r * 1000)], ["Item", "Amount"]) for r in range(10)] + [(2, 0, ["a|b"], ["", "B"])]
    got = tables.table_texts(spark.createDataFrame(rows, "table_id int, r int, cells array<string>, headers array<string>"), 100).orderBy("table_id", "first").collect()
    assert got[-1]["body"] == "| Col_1 | B |\n| --- | --- |\n| a-b |  |"
    own = [r for r in got if r["table_id"] == 1]
    assert len(own) >= 2 and all(r["body"].startswith("| Item | Amount |\n| --- | --- |\n") for r in own)
    assert own[0]["body"].endswith(f" [Table Slice Rows 1-{own[0]['n']} of 10]") and sum(r["n"] for r in own) == 10


def test_dense_facets_equal_sparse_facets(spark):
    rng = random.Random(1)
    corpus = spark.createDataFrame([(i, [rng.random() for _ in range(4)], rng.choice(["Forest", "वन विभाग", "Finance", None]), rng.choice([2001, 2005, None]), rng.choice(["A", "B"]), f"GO-{i}/X") for i in range(60)], "id long, embedding array<double>, department string, year int, status string, go_number string")
    asked = spark.createDataFrame([(1, "Forest", None, None, None), (2, None, 2000, 2002, "A"), (3, None, None, None, "B"), (4, "", None, None, None)], "query_id long, department string, year_from int, year_to int, status string").withColumn("go", F.when(F.col("query_id") == 3, "GO-15")).withColumn("embedding", F.array(*[F.lit(0.5)] * 4))
    got = {(r["query_id"], r["id"]) for r in retrieval.dense_scores(corpus, asked, 100).collect()}
    wanted, facets = retrieval.facets_of(asked)
    ok = corpus.crossJoin(wanted).where(retrieval.allowed(F.col("department"), F.col("year"), F.col("status"), F.col("go_number"), facets))
    assert got == {(r["query_id"], r["id"]) for r in ok.collect()} and {q for q, _ in got} == {1, 2, 3, 4}


def test_hash_vector(spark):
    v = one(spark, "abc", indic.hash_vector)
    assert len(v) == 1024 and abs(sum(x * x for x in v) - 1) < 1e-9


def _solve(values, confidences, total):
    """Exhaustive form of the repair."""
    cells = [i for i, c in enumerate(confidences) if c < 0.99 or len(values) <= 10][:4]
    options = []
    for i in cells:
        raw = str(values[i])
        alts = [(float(raw[:k] + b + raw[k + 1 :]), p) for k, d in enumerate(raw) for a, b, p in fixed.CONFUSIONS if a == d]
        options.append([*alts, (float(values[i]), 0.0)])
    best = None
    for combo in itertools.product(*options):
        s = sum(float(v) for i, v in enumerate(values) if i not in cells) + sum(v for v, _ in combo)
        p = sum(p for _, p in combo)
        if abs(s - total) <= 0.01 and p <= 4 and (best is None or p < best):
            best = p
    return best


@pytest.mark.parametrize(("values", "total"), [((80000, 20000), 50000), ((10, 20, 30), 61), ((10, 20, 30), 60), ((13, 27, 58), 148), ((5, 5), 9999)])
def test_repair(spark, values, total):
    rows = [(1, i, 0, "Item", "x", 1.0) for i in range(len(values))] + [(1, i, 1, "Amount", str(v), 0.7) for i, v in enumerate(values)]
    rows += [(1, len(values), 0, "Item", "Total", 1.0), (1, len(values), 1, "Amount", str(total), 1.0)]
    got = tables.solved(tables.valued(spark.createDataFrame(rows, "table_id int, r int, c int, header string, t string, confidence double"))).first()
    best = _solve(values, [0.7] * len(values), total)
    assert (got["penalty"] is None) == (best is None)
    if best is not None:
        assert abs(got["penalty"] - best) < 1e-9 and abs(float(got["computed"]) - total) <= 0.01


def test_tables_from_text(spark):
    text = "a\n| h1 | h2 | h3 | h4 | h5 |\n|---|:-:|---|---|---|\n| 1 | 2 | 3 | 4 | 5 |\n| 6 | 7 |\n| 8 | 9 | 10 | 11 | 12 | 13 |\nend\n| x | y |\n| not a rule |\n"
    got = tables.parsed(spark.createDataFrame([(1, text)], "page int, t string")).collect()
    lines = [x.strip() for x in text.split("\n")]
    want = set()
    for i, line in enumerate(lines[:-1]):
        if line.startswith("|") and re.match(r"^\|(?:\s*:?-+:?\s*\|)+$", lines[i + 1]):
            head = [c.strip() for c in line.strip("|").split("|")]
            for r, row in enumerate(itertools.takewhile(lambda s: s.startswith("|"), lines[i + 2 :])):
                cells = [c.strip() for c in row.strip("|").split("|")] + [""] * len(head)
                want |= {(r, c, h, cells[c]) for c, h in enumerate(head)}
    assert {(x["r"], x["c"], x["header"], x["t"]) for x in got} == want


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, i, i, 0.5) for i in range(1, 6)], "query_id long, id long, dense_rank int, dense_sim double")
    b = spark.createDataFrame([(1, i, 6 - i) for i in range(3, 9)], "query_id long, id long, sparse_rank int")
    x = {r["id"]: r["rrf"] for r in retrieval.fuse(a, b).collect()}
    y = {r["id"]: r["rrf"] for r in retrieval.fuse(b.withColumnRenamed("sparse_rank", "dense_rank").withColumn("dense_sim", F.lit(0.5)), a.select("query_id", "id", F.col("dense_rank").alias("sparse_rank"))).collect()}
    assert x == y and abs(x[1] - 1 / 61) < 1e-12


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "old long, new long")
    got = {(r["root"], r["node"]): r["depth"] for r in lineage.closure(e, 20).collect()}
    assert got[1, 4] == 3 and got[1, 1] == 3 and got[2, 1] == 2


def test_answers(spark):
    assert one(spark, '```json\n{"answer": "yes"}\n```', answers.reply_json) == '{"answer": "yes"}'
    assert one(spark, "{broken", answers.reply_json) is None


def test_review_stream_equals_batch(spark, small, tmp_path):
    from sheafline.plans.store import reviews as log_of

    log = log_of(spark, small)
    # One file per session, so that each session's events arrive in order.
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = reviews.review_stream(stream, None).writeStream.format("memory").queryName("reviews").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    own = {tuple(r) for r in spark.table("reviews").collect()}
    assert own == {tuple(r) for r in reviews.review_batch(log).collect()} and own


def test_window_stream(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    q = reviews.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == e.count()


def test_sums_take_one_exchange_of_the_cells(spark):
    cells = [(1, 0, 0, "Item", "a"), (1, 0, 1, "Amount", "10"), (1, 0, 1, "Amount", "5"), (1, 1, 0, "Item", "Total"), (1, 1, 1, "Amount", "Rs. 1,015.00"), (1, 1, 1, "Amount", "15"), (1, 2, 1, "Amount", "1,000"), (2, 0, 0, "Item", None)]
    out = tables.verified(spark.createDataFrame(cells, "table_id int, r int, c int, header string, t string"))
    got = {r["table_id"]: (r["computed"], r["declared"], r["valid"]) for r in out.collect()}
    assert [None if x is None else float(x) for x in got[1][:2]] == [1015, 1015] and got[1][2] and got[2] == (None, None, True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 2  # the cells, and those of a role: not once for each sum


def test_sparse_matches_equal_the_fold_and_stay_in_place(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 25)))) for i in range(120)], "id long, text string")
    asked = spark.createDataFrame([(j, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))) for j in range(40)], "query_id long, query_text string")
    out = retrieval.sparse_matches(docs, asked)
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z])"), F.lit(1))
    both = docs.crossJoin(asked).withColumn("s", retrieval.cover_density(words(F.col("text")), F.array_distinct(words(F.col("query_text"))))).where("s IS NOT NULL OR contains(text, query_text)")
    want = {(r["query_id"], r["id"]): r["s"] or 0.0 for r in both.collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_search_matches_texts_once(spark, monkeypatch):
    calls, real = [], retrieval.sparse_matches
    monkeypatch.setattr(retrieval, "sparse_matches", lambda *a: calls.append(a) or real(*a))
    docs = spark.createDataFrame([(i, "one two three", "x", 2001, [1.0, float(i)]) for i in range(4)], "id long, text string, department string, year int, embedding array<double>")
    asked = spark.createDataFrame([(1, "one two", [1.0, 0.5], "nowhere")], "query_id long, query_text string, embedding array<double>, department string")
    assert retrieval.search(docs, asked, 2).count() == 2 and len(calls) == 1


def test_tokens_of_a_text_are_decoded_as_each_alone(spark):
    rng = random.Random(9)
    words = ["mRrjk[k.M", "'kklu", "la[;k", "fnukad", "fgUnh", "Zdk", "No.", "(GO)", "12-01-2018", "forest,", "वन", "kzee", "osllra"]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t　 "]) for _ in range(rng.randint(0, 9)))
        assert indic.decode(text) == re.sub(r"\S+", lambda m: indic.decode(m[0]), text)
    rows = spark.createDataFrame([(1, "plain words without a sign of fonts, and long enough"), (2, "xx ti yy qff and more of it")], "row_id int, t string")
    out = indic.triaged(rows, chunks.garbage(F.col("t")))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_count(solid") == 0  # the rules were computed before: both parts read their results
    assert out.count() == 2
