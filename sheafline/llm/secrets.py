"""Secret scan: fixed patterns, and Markov models of characters for strings that no pattern names.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples (token, label) and compared on every long token: the mean log-likelihood ratio per character pair decides.
Everything is columns: matches and the pieces between them come from the regular expression functions, positions from a
running sum over the matches of one text, the score from an array of log ratios indexed by a pair of characters.

Cases. Null text counts as empty. A text without a match gives counts 0, the digest of '' and ''. Positions are code
points, ends exclusive, so text outside the basic plane is counted once. Rows that repeat a doc_id are scanned one by
one. Very long texts and tokens cost time in proportion to their length. An empty table gives an empty result; without
any labelled sample both models are uniform and no token is added. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_sample, materialise

# The patterns of the base spans.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_letters + string.digits + "+/_=.-"
TOKEN = "[A-Za-z0-9+/_=.-]"


@dataclass(frozen=True)
class SecretSpec:
    """min_token: shortest token judged. threshold: least mean log ratio. train_docs: about how many documents' strings
    of token characters are the sample of ordinary identifiers (ordinary_length characters or more); random strings come from all base matches.
    made: how many random strings are made beside those found, so that kinds of which the texts hold none are known.
    prior: weight of single characters against pairs; floor: count added to each character in the smaller sample, in the
    other in proportion, so that a character neither holds weighs 0."""

    min_token: int = 20
    threshold: float = 0.7
    train_docs: int = 2000
    ordinary_length: int = 6
    made: int = 2000
    prior: float = 10.0
    floor: float = 0.1


def _found(text: Column, gate: Column, pattern: str, kind: int, ok, value=None) -> Column:
    """Array of (kind, i, gap, len, ok, val): gap is the number of code points since the match before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    rows = F.transform(
        F.arrays_zip(gaps.alias("g"), hits.alias("m"), values.alias("v")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
            ok(x["m"], x["v"]).alias("ok"), x["v"].alias("val"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,len:int,ok:boolean,val:string>>)")
    return F.when(gate, rows).otherwise(empty)


def candidates(docs: DataFrame, spec: SecretSpec) -> DataFrame:
    """__row, doc_id, kind, start, end, ok, val: every match and token; a text without any has one row of nulls."""
    x = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t, low = F.col("t"), F.lower("t")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    # A run of so many token characters holds every access key and hex string that counts, so one test serves all three.
    shortest = min(spec.min_token, 20)
    x = x.withColumn("long", t.rlike(f"{TOKEN}{{{shortest}}}"))
    every = F.concat(
        _found(t, named, ASSIGN, 0, lambda m, v: F.length(v) >= 6, 2),
        _found(t, F.col("long") & t.contains("AKIA"), ACCESS, 1, lambda m, v: F.length(m) >= 20),
        _found(t, F.col("long") & t.rlike("[0-9a-f]{24}"), "[0-9a-f]{24,}", 2, lambda m, v: F.lit(True)),
        _found(t, F.col("long"), f"{TOKEN}{{{spec.min_token},}}", 3, lambda m, v: F.lit(True)),
    )
    x = x.select("__row", "doc_id", F.explode_outer(every).alias("c")).select("__row", "doc_id", "c.*").repartition("__row")
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("end", end).select("__row", "doc_id", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "ok", "val")


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) of adjacent characters of the tokens; at most 2 * 128 * 128 rows whatever the input."""
    chars = F.split(F.col("token"), "")
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.ascii(a) * 128 + F.ascii(b))
    return samples.where(F.col("token").rlike("^[\\x21-\\x7E]{2,}$")).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame, spec: SecretSpec) -> list[float]:
    """Log ratio (random over ordinary) for each pair of ASCII characters, at index first * 128 + second."""
    counts = {0: {}, 1: {}}
    for r in pair_counts(samples).collect():  # bounded by the alphabet, not by the input
        counts[int(r["label"])][int(r["pair"])] = int(r["n"])
    out = [0.0] * (128 * 128)
    if not counts[0] or not counts[1]:
        return out
    letters = list(map(ord, ALPHABET))
    first = {k: {a: sum(c.get(a * 128 + b, 0) for b in letters) for a in letters} for k, c in counts.items()}
    alone = {}
    sizes = {k: max(1, sum(first[k].values())) for k in counts}
    for k, c in counts.items():
        floor = spec.floor * sizes[k] / min(sizes.values())
        n = {b: sum(c.get(a * 128 + b, 0) for a in letters) + floor for b in letters}
        alone[k] = {b: x / sum(n.values()) for b, x in n.items()}
    for a in letters:
        for b in letters:
            # Pairs rest on single characters where they are rare, so a character that identifiers lack tells by itself.
            p = {k: (c.get(a * 128 + b, 0) + spec.prior * alone[k][b]) / (first[k][a] + spec.prior) for k, c in counts.items()}
            out[a * 128 + b] = math.log(p[1] / p[0])
    return out


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log ratio over the pairs of a token. The table is one folded literal of 16384 numbers."""
    table = F.split(F.lit(",".join(f"{x:.5g}" for x in ratios)), ",").cast("array<double>")
    chars = F.split(token, "")
    n = F.size(chars)
    each = F.zip_with(
        F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.coalesce(F.get(table, F.ascii(a) * 128 + F.ascii(b)), F.lit(0.0)),
    )
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(n - 1, F.lit(1))


def made_strings(spark: SparkSession, n: int) -> DataFrame:
    """n strings of random characters, base 64 (with and without marks) and hexadecimal of both cases, from digests of numbers."""
    bits = F.sha2(F.concat(F.lit("made:"), F.col("id").cast("string")), 256)
    coded = F.regexp_replace(F.base64(F.unhex(bits)), "=+$", "")
    kinds = [coded, F.regexp_replace(coded, "[+/]", ""), F.translate(coded, "+/", "-_"), bits, F.upper(bits)]
    token = kinds[0]
    for i, k in enumerate(kinds[1:], 1):
        token = F.when(F.col("id") % 5 == i, k).otherwise(token)
    return spark.range(n).select(F.substring(token, F.lit(1), (F.lit(20) + F.col("id") % 20).cast("int")).alias("token"))


def made_rules(spark: SparkSession) -> DataFrame:
    """Rules and leaders: each character of the alphabet many times over."""
    at = F.expr("cast(id / 5 as int) + 1")
    return spark.range(5 * len(ALPHABET)).select(F.repeat(F.substring(F.lit(ALPHABET), at, F.lit(1)), (F.lit(20) + 5 * (F.col("id") % 5)).cast("int")).alias("token"))


def samples_of(docs: DataFrame, found: DataFrame, spec: SecretSpec) -> DataFrame:
    """Labelled samples: random strings are values of base matches that mix digits and letters ("changeme" teaches nothing)
    and made ones; ordinary are made rules and all other strings of token characters of the texts, the long ones unless they
    score as random beside the short ones."""
    mixed = F.col("val").rlike("[0-9]") & F.col("val").rlike("[A-Za-z]") & (F.length("val") >= 12)
    random = found.where(F.col("ok") & (F.col("kind") < 3) & mixed).select(F.col("val").alias("token")).distinct()
    random = random.union(made_strings(docs.sparkSession, spec.made)).withColumn("label", F.lit(1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for pattern in (ASSIGN, f"{ACCESS[:-1]}{{16,}}", "[0-9a-f]{24,}"):
        text = F.regexp_replace(text, pattern, " ")
    tokens = F.regexp_extract_all(text, F.lit(f"{TOKEN}{{{spec.ordinary_length},}}"), F.lit(0))
    texts = hash_sample(docs.select("doc_id", "text"), spec.train_docs)
    ordinary = materialise(texts.select(F.explode(tokens).alias("token")).distinct().withColumn("label", F.lit(0)), "ordinary-strings")
    rules = made_rules(docs.sparkSession).withColumn("label", F.lit(0))
    # Long ones may be the secrets that are sought: they are admitted by a model of the short ones.
    long = F.length("token") >= spec.min_token
    first = train(random.unionByName(ordinary.where(~long)).unionByName(rules), spec)
    ordinary = ordinary.where(~long | (score(F.col("token"), first) < spec.threshold))
    return random.unionByName(ordinary).unionByName(rules)


def scan(docs: DataFrame, spec: SecretSpec | None = None, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans (arrays of (start, k, end), in order): one row per row of docs."""
    spec = spec or SecretSpec()
    found = materialise(candidates(docs, spec), "secret-candidates")
    ratios = train(samples if samples is not None else samples_of(docs, found, spec), spec)
    judged = found.withColumn("ok", F.when(F.col("kind") < 3, F.col("ok")).when(F.col("kind") == 3, score(F.col("val"), ratios) >= spec.threshold))
    judged = judged.drop("val")
    base = F.col("ok") & (F.col("kind") < 3)
    order = Window.partitionBy("__row").orderBy("start", "kind")
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    judged = judged.repartition("__row").withColumns({"reach": reach, "ahead": ahead})
    # A token that touches a base span adds nothing: the base span stays as it is.
    clash = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    span = F.struct("start", F.col("kind").alias("k"), "end")
    both = judged.withColumn("base", base).withColumn("added", F.col("ok") & (F.col("kind") == 3) & ~clash)
    n = lambda k: F.count_if(F.col("base") & (F.col("kind") == k))
    return both.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"),
        F.sort_array(F.collect_list(F.when(F.col("base") | F.col("added"), span))).alias("spans"),
    ).drop("__row")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
