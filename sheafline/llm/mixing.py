"""Mixing sources to target weights by hierarchical budgeting.

1. Every document gets a token count, its leaf (domain, language, source) and an order key, a digest of seed, epoch and
   doc_id. Counts are summed per leaf (map-side combine), so the tree has one row per leaf, never one per document.
2. The token budget goes down the tree level by level. A node's budget is shared among its children by weight; a child
   cannot take more than its capacity (its tokens times max_epochs), and what it leaves goes to its siblings in
   proportion to their weights (water-filling) before anything is left over for the ancestors.
3. A leaf with budget b and t tokens gets floor(b / t) whole epochs and a prefix of the next seeded epoch: documents in
   key order until the running token count reaches the rest. The prefix is found without sorting a leaf in one task:
   tokens are summed per (leaf, key range), ranges are added up, and only the one range in which the cut falls is
   sorted. The cut is a key per leaf, so selecting documents is a filter, not a shuffle of texts.

Cases. Null domain, language, source count as ''. Null text has 0 tokens; documents of 0 tokens belong to the prefix as
soon as their key is within the cut. A child without a weight gets ``default_weight``; negative or null weights count as
0 and a weight of 0 takes nothing. Rows that repeat a doc_id have the same key and are taken together. Ties of keys are
settled by doc_id. An empty table gives an empty result. Extra columns are ignored (``plan_mix``) or returned unchanged
(``mix``), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixSpec:
    """Target weights by path prefix, e.g. {("web",): 3, ("web", "en"): 2}; the budget in tokens or as a share."""

    weights: dict = field(default_factory=dict)
    budget_share: float = 0.8
    budget_tokens: int | None = None
    max_epochs: int = 2
    seed: int = 17
    default_weight: float = 1.0
    docs_per_range: int = 2000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """28 bits from a digest, so that key ranges are even."""
    d = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(d, 1, 7), 16, 10).cast("long")


KEYS = 1 << 28


def _weights(df: DataFrame, level: int, spec: MixSpec) -> DataFrame:
    """Adds __w: the weight of each node of this level."""
    known = [(k, float(v)) for k, v in spec.weights.items() if len(k) == level + 1]
    out = F.lit(float(spec.default_weight))
    for path, w in known:
        at = F.lit(True)
        for name, value in zip(LEVELS, path, strict=False):
            at = at & (F.col(f"__{name}") == F.lit(value))
        out = F.when(at, F.lit(max(0.0, w or 0.0))).otherwise(out)
    return df.withColumn("__w", out)


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-filling within each parent: adds __b from __cap, __w and __parent_b.

    Children sorted by cap / weight saturate in that order. With R the budget left before a child and W the weight of it
    and those after, the child saturates if cap / w <= R / W; all after the first that doesn't share R by weight.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("__ratio"), *[F.col(f"__{n}") for n in LEVELS if f"__{n}" in nodes.columns])
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = nodes.withColumn("__ratio", F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(F.lit(float("inf"))))
    x = x.withColumn("__room", F.when(F.col("__w") > 0, F.col("__cap")).otherwise(F.lit(0.0)))
    x = x.withColumn("__rest", F.col("__parent_b") - F.coalesce(F.sum("__room").over(before), F.lit(0.0)))
    x = x.withColumn("__after", F.sum("__w").over(after))
    x = x.withColumn("__open", (F.col("__w") > 0) & (F.col("__ratio") * F.col("__after") > F.col("__rest")))
    # The level at which the first child that is not saturated stops.
    x = x.withColumn("__level", F.first(F.when(F.col("__open"), F.col("__rest") / F.col("__after")), ignorenulls=True).over(whole))
    share = F.when(F.col("__w") <= 0, F.lit(0.0)).when(F.col("__level").isNull(), F.col("__cap"))
    return x.withColumn("__b", share.otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__w")))).drop(
        "__ratio", "__room", "__rest", "__after", "__open", "__level", "__parent_b", "__w"
    )


def budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """From (__domain, __lang, __source, __tokens, __docs) to the same with __b, the leaf's budget in whole tokens."""
    names = [f"__{n}" for n in LEVELS]
    capped = leaves.withColumn("__cap", F.col("__tokens").cast("double") * spec.max_epochs)
    total = leaves.agg(F.sum("__tokens").cast("double").alias("__all"))
    want = F.lit(float(spec.budget_tokens)) if spec.budget_tokens is not None else F.col("__all") * spec.budget_share
    up = total.select(F.coalesce(want, F.lit(0.0)).alias("__parent_b"), F.lit(0).alias("__root"))
    # Capacities from the leaves up: a child of weight 0 takes nothing, so it gives its parent no capacity.
    levels = []
    for level in reversed(range(len(LEVELS))):
        own = names[: level + 1]
        nodes = _weights(capped.groupBy(*own).agg(F.sum("__cap").alias("__cap")), level, spec)
        capped = nodes.withColumn("__cap", F.when(F.col("__w") > 0, F.col("__cap")).otherwise(F.lit(0.0)))
        levels.insert(0, capped.withColumn("__root", F.lit(0)))
    for level, nodes in enumerate(levels):
        own = names[: level + 1]
        parent = own[:-1] or ["__root"]
        nodes = nodes.join(up, parent)
        filled = _fill(nodes, parent)
        up = filled.select(*own, F.col("__b").alias("__parent_b"))
    return leaves.join(up.select(*names, F.floor(F.col("__parent_b") + 1e-6).cast("long").alias("__b")), names)


def ledger(docs: DataFrame, domain: Column, spec: MixSpec) -> DataFrame:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"), blank(domain).alias("__domain"), blank(F.col("lang")).alias("__lang"), blank(F.col("source")).alias("__source"),
        token_count(F.col("text")).alias("__n"),
    )


def cuts(led: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per leaf: tokens, budget, whole epochs, and (__cut_key, __cut_id), the last of the prefix (null: none)."""
    names = [f"__{n}" for n in LEVELS]
    leaves = materialise(led.groupBy(*names).agg(F.sum("__n").alias("__tokens"), F.count(F.lit(1)).alias("__docs")), "leaves")
    plan = budgets(leaves, spec)
    plan = plan.withColumn("__epochs", F.when(F.col("__tokens") > 0, F.floor(F.col("__b") / F.greatest(F.col("__tokens"), F.lit(1)))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("__left", F.col("__b") - F.col("__epochs") * F.col("__tokens"))
    plan = plan.withColumn("__ranges", F.ceil(F.col("__docs") / spec.docs_per_range).cast("long"))
    plan = materialise(plan, "leaf-plan")
    keyed = led.join(plan.where("__left > 0").select(*names, "__epochs", "__left", "__ranges"), names)
    keyed = keyed.withColumn("__key", order_key(spec.seed, F.col("__epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("__range", F.floor(F.col("__key") * F.col("__ranges") / KEYS).cast("long"))
    sums = keyed.groupBy(*names, "__range", "__left").agg(F.sum("__n").alias("__t"))
    running = F.sum("__t").over(Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__before", F.coalesce(running, F.lit(0)))
    hit = materialise(sums.where("__before < __left AND __before + __t >= __left").select(*names, "__range", "__before"), "cut-ranges")
    inside = keyed.join(hit, [*names, "__range"])
    order = Window.partitionBy(*names, "__range").orderBy("__key", "doc_id")
    # Range frame: rows that repeat a document stand together.
    inside = inside.withColumn("__run", F.col("__before") + F.sum("__n").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    last = inside.where("__run >= __left").groupBy(*names).agg(F.min(F.struct("__key", "doc_id")).alias("__cut"))
    return materialise(
        plan.join(last, names, "left").select(*names, "__tokens", "__b", "__epochs", F.col("__cut.__key").alias("__cut_key"), F.col("__cut.doc_id").alias("__cut_id")),
        "leaf-cuts",
    )


def _with_copies(led: DataFrame, plan: DataFrame, spec: MixSpec) -> DataFrame:
    names = [f"__{n}" for n in LEVELS]
    x = led.join(plan, names)
    key = order_key(spec.seed, F.col("__epochs"), F.col("doc_id"))
    within = (key < F.col("__cut_key")) | ((key == F.col("__cut_key")) & F.coalesce(F.col("doc_id") <= F.col("__cut_id"), F.col("__cut_id").isNull(), F.lit(True)))
    return x.withColumn("__copies", F.col("__epochs") + F.coalesce(within, F.lit(False)).cast("int"))


def plan_mix(docs: DataFrame, domain: Column, spec: MixSpec) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, copies: one row per row of docs."""
    led = materialise(ledger(docs, domain, spec), "ledger")
    return _with_copies(led, cuts(led, spec), spec).select(
        "doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__n").alias("n_tokens"),
        F.col("__tokens").alias("leaf_tokens"), F.col("__b").alias("leaf_budget"), F.col("__copies").alias("copies"),
    )


def mix(docs: DataFrame, domain: Column, spec: MixSpec) -> DataFrame:
    """The rows of docs, each as often as the plan takes it (epochs repeat a row)."""
    led = materialise(ledger(docs, domain, spec), "ledger")
    plan = cuts(led, spec).select(*[f"__{n}" for n in LEVELS], "__epochs", "__cut_key", "__cut_id")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # The table's columns go by number meanwhile, so that no name of theirs meets a working column.
    own = [F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*own, F.col("doc_id"), blank(domain).alias("__domain"), blank(F.col("lang")).alias("__lang"), blank(F.col("source")).alias("__source"))
    taken = _with_copies(keyed, plan, spec).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(docs.columns)])
