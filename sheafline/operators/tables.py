"""Tables in long form (table_id, r, c, header, t, confidence): values, totals, balances, repair, stitching, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.money import DECIMAL, is_total, parse_money, role_of, scale_of, with_amount
from ..sources.shared import saved, sent


def valued(cells: DataFrame) -> DataFrame:
    return with_amount(cells, "t", "v")


def scaled(cells: DataFrame) -> DataFrame:
    """cells with v, written once: amounts in the scale that the table's headers or first row name, where a cell names
    none. Tables in which no cell or header names a scale, most of them, are read as they stand."""
    names = F.coalesce(scale_of(F.col("header"))[1], scale_of(F.col("t"))[1]).isNotNull()
    texts = saved(cells.select("table_id", "r", "c", "header", "t"), "cells")  # dealt evenly again, for the patterns
    all_cells = saved(valued(texts).withColumn("names", names), "amounts")
    some = saved(all_cells.where("names").select("table_id").distinct(), "scaled-tables")
    if some.isEmpty():
        return all_cells.drop("names")
    some, own = sent(some), Window.partitionBy("table_id")
    x = all_cells.drop("names", "v").join(some, "table_id", "left_semi").withColumn("head", F.when(F.col("r") == F.min("r").over(own), F.col("t")))
    x = x.withColumn("words", F.array_join(F.concat(F.collect_set("header").over(own), F.collect_list("head").over(own)), " "))
    x = x.withColumn("v", parse_money(F.col("t"), scale_of(F.col("words"))[0]))
    return saved(all_cells.drop("names").join(some, "table_id", "left_anti").unionByName(x.select("table_id", "r", "c", "header", "t", "v")), "scaled-amounts")


def totals(cells: DataFrame) -> DataFrame:
    """table_id, total_row, total_col, total: the right-most amount of the first row with a total word and an amount."""
    rows = cells.groupBy("table_id", "r").agg(F.bool_or(is_total(F.col("t"))).alias("named"), F.max(F.when(F.col("v").isNotNull(), F.struct("c", "v"))).alias("last"))
    best = rows.where("named AND last IS NOT NULL").groupBy("table_id").agg(F.min(F.struct("r", "last")).alias("x"))
    return best.select("table_id", F.col("x.r").alias("total_row"), F.col("x.last.c").alias("total_col"), F.col("x.last.v").alias("total"))


def sums(cells: DataFrame) -> DataFrame:
    """table_id, total (as ``totals`` finds it, null without one) and s, the sum of the other amounts of its column. One
    exchange and one sort of all cells: rows, tables and sums follow the same order."""
    row, own = Window.partitionBy("table_id", "r"), Window.partitionBy("table_id")
    x = cells.select("table_id", "r", "c", "v", is_total(F.col("t")).alias("named")).repartition("table_id").sortWithinPartitions("table_id", "r")
    x = x.select("table_id", "r", "c", "v", F.max("named").over(row).alias("named"), F.max(F.when(F.col("v").isNotNull(), F.col("c"))).over(row).alias("last"))
    x = x.withColumn("at", F.min(F.when(F.col("named") & F.col("last").isNotNull(), F.struct("r", F.col("last").alias("c")))).over(own))
    column = F.col("c") == F.col("at.c")
    total, others = F.when(column & (F.col("r") == F.col("at.r")), F.col("v")), F.when(column & (F.col("r") != F.col("at.r")), F.col("v"))
    return x.groupBy("table_id").agg(F.max(total).alias("total"), F.sum(others).alias("s"))


def balances(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """table_id, valid: sanctioned less spent is the balance in every row that has all three, each in the last column of
    its role; valid where a role has no column."""
    x = cells.withColumn("role", role_of(F.col("header")))
    x = x.withColumn("last", F.max(F.when(F.col("role").isNotNull(), F.col("c"))).over(Window.partitionBy("table_id", "role")))
    of = lambda n: F.max(F.when((F.col("role") == n) & (F.col("c") == F.col("last")), F.col("v")))
    rows = x.groupBy("table_id", "r").agg(of("sanctioned").alias("a"), of("spent").alias("s"), of("balance").alias("b"))
    return rows.groupBy("table_id").agg(F.bool_and(F.coalesce(F.abs(F.col("a") - F.col("s") - F.col("b")) <= tolerance, F.lit(True))).alias("valid"))


def verified(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """table_id, computed, declared, delta, valid. The amounts of the total's column but the total's row add up to it;
    then the rows balance. A table without a total is valid with nulls.

    Texts are read once, before the checks part; only cells under a header of a role are looked at for the balance."""
    v = scaled(cells)
    balanced = balances(v.where(role_of(F.col("header")).isNotNull()), tolerance).withColumnRenamed("valid", "balanced")
    x = sums(v).join(balanced, "table_id", "left").withColumn("balanced", F.coalesce("balanced", F.lit(True)))
    zero = F.lit(0).cast(DECIMAL)
    computed = F.when(F.col("total").isNotNull(), F.coalesce("s", zero).cast(DECIMAL))
    x = x.select("table_id", computed.alias("computed"), F.col("total").alias("declared"), "balanced").withColumn("delta", F.abs(F.col("computed") - F.col("declared")))
    valid = F.col("declared").isNull() | ((F.col("delta") <= tolerance) & F.col("balanced"))
    return x.select("table_id", "computed", "declared", "delta", valid.alias("valid"))


def doubtful(cells: DataFrame, least: float = 0.95, tolerance: float = 0.01) -> DataFrame:
    """Cells of tables whose sum fails that are worth reading again: amounts of the total's column below a confidence, the
    least sure first (place)."""
    v = valued(cells)
    failed = verified(cells, tolerance).where(F.col("delta") > tolerance).select("table_id")
    x = v.join(failed, "table_id", "left_semi").join(totals(v), "table_id").where((F.col("c") == F.col("total_col")) & (F.col("r") != F.col("total_row")) & F.col("v").isNotNull() & (F.col("confidence") < least))
    return x.select("table_id", "r", "c", "t", "confidence", F.row_number().over(Window.partitionBy("table_id").orderBy("confidence", "r")).alias("place"))


def reread(cells: DataFrame, readings: DataFrame) -> DataFrame:
    """cells with the texts of a second reading (table_id, r, c, reading) where that holds an amount, at full confidence.

    The reading itself is done outside, for the cells that ``doubtful`` names."""
    x = cells.join(readings.select("table_id", "r", "c", "reading"), ["table_id", "r", "c"], "left").withColumn("new", parse_money(F.col("reading")).isNotNull())
    return x.withColumns({"t": F.when(F.col("new"), F.col("reading")).otherwise(F.col("t")), "confidence": F.when(F.col("new"), 1.0).otherwise(F.col("confidence"))}).select(*cells.columns)


def candidates(cells: DataFrame) -> DataFrame:
    """cells with candidate, penalty: every amount that one confused digit could have meant."""
    swaps = F.broadcast(cells.sparkSession.createDataFrame(fixed.CONFUSIONS, "d string, alt string, penalty double"))
    x = cells.withColumn("n", F.regexp_replace("t", r"[^0-9.]", "")).where("n <> ''")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("n"))))
    x = x.join(swaps, F.col("d") == F.expr("substring(n, i, 1)"))
    value = F.concat(F.expr("substring(n, 1, i - 1)"), F.col("alt"), F.expr("substring(n, i + 1)"))
    return x.withColumn("candidate", value.try_cast("decimal(18,6)").cast(DECIMAL)).where("candidate IS NOT NULL")


def solved(cells: DataFrame, most_cells: int = 4, most_penalty: float = 4.0, tolerance: float = 0.01) -> DataFrame:
    """table_id, computed, declared, penalty, valid: the cheapest reading of at most four doubtful amounts that meets the
    total. Combinations grow by one cell at a time within a table, so their number is bounded by the cells' candidates."""
    total = totals(cells)
    x = cells.join(total, "table_id").where("c = total_col AND r <> total_row AND v IS NOT NULL")
    n = Window.partitionBy("table_id")
    x = x.withColumn("n", F.count(F.lit(1)).over(n)).withColumn("soft", (F.col("confidence") < 0.99) | (F.col("n") <= 10))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("table_id", "soft").orderBy("r")))
    doubtful = x.where((F.col("k") <= most_cells) & F.col("soft"))
    sums = x.groupBy("table_id").agg(F.sum("v").alias("s"), F.first("total").alias("declared"))
    options = candidates(doubtful).select("table_id", "k", F.col("v").alias("old"), F.col("candidate").alias("new"), "penalty")
    options = options.unionByName(doubtful.select("table_id", "k", F.col("v").alias("old"), F.col("v").alias("new"), F.lit(0.0).alias("penalty")))
    options = options.select("table_id", "k", (F.col("new") - F.col("old")).cast(DECIMAL).alias("change"), "penalty")
    # Of equal changes only the cheapest can be in a cheapest solution; sums so dear that they cannot pass are dropped.
    options = options.groupBy("table_id", "k", "change").agg(F.min("penalty").alias("penalty"))
    state = sums.select("table_id", F.lit(0).cast(DECIMAL).alias("change"), F.lit(0.0).alias("penalty"))
    for k in range(1, most_cells + 1):
        own = options.where(F.col("k") == k).select("table_id", F.col("change").alias("c2"), F.col("penalty").alias("p2"))
        step = state.join(own, "table_id", "left").select("table_id", (F.col("change") + F.coalesce("c2", F.lit(0).cast(DECIMAL))).cast(DECIMAL).alias("change"), (F.col("penalty") + F.coalesce("p2", F.lit(0.0))).alias("penalty"))
        state = step.where(F.col("penalty") <= most_penalty).groupBy("table_id", "change").agg(F.min("penalty").alias("penalty"))
    fit = state.join(sums, "table_id").where(F.abs(F.col("s") + F.col("change") - F.col("declared")) <= tolerance)
    best = fit.groupBy("table_id").agg(F.min_by(F.struct("change", "penalty"), F.struct("penalty", "change")).alias("b"))
    out = sums.join(best, "table_id", "left")
    return out.select("table_id", (F.col("s") + F.coalesce("b.change", F.lit(0).cast(DECIMAL))).cast(DECIMAL).alias("computed"), "declared", F.col("b.penalty").alias("penalty"), F.col("b").isNotNull().alias("valid"))


def stitched(tables: DataFrame) -> DataFrame:
    """tables (doc, page, t, headers, rows) with grp: a table goes on with the one before it on the page before, if it
    has the same two or more headers or none."""
    w = Window.partitionBy("doc").orderBy("page", "t")
    same = (F.size("headers") > 1) & (F.col("headers") == F.lag("headers").over(w))
    goes_on = F.coalesce((F.col("page") == F.lag("page").over(w) + 1) & (same | (F.size("headers") == 0)), F.lit(False))
    return tables.withColumn("goes_on", goes_on).withColumn("grp", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w)).drop("goes_on")


def clustered(items: DataFrame, gap: float = 0.025) -> DataFrame:
    """items (page, item, y, ...) with grp, the number of the row they stand in."""
    w = Window.partitionBy("page").orderBy("y", "item")
    new = F.when(F.col("y") - F.lag("y").over(w) < gap, 0).otherwise(1)
    return items.withColumn("new", new).withColumn("grp", F.sum("new").over(w)).drop("new")


def boxed(items: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, t, confidence: texts of the items whose middle lies in the cell, and their least confidence."""
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    hit = items.join(sent(cells), inside)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("item", "t"))), lambda s: s["t"])
    return hit.groupBy("cell").agg(F.array_join(texts, " ").alias("t"), F.min("confidence").alias("confidence"))


def parsed(pages: DataFrame) -> DataFrame:
    """page, tbl, r, c, header, t of every pipe table: a header line, a delimiter line, then rows, padded or cut to the
    header's width. Lines of a page are numbered and grouped by islands; nothing leaves the page."""
    x = pages.select("page", F.posexplode(F.split("t", "\r?\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("page").orderBy("i")
    pipe = F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 1)
    rule = F.col("line").rlike(r"^\|(?:\s*:?-+:?\s*\|)+$")
    x = x.withColumns({"pipe": pipe, "head": pipe & F.coalesce(F.lead(F.when(rule, True)).over(w), F.lit(False))})
    x = x.withColumn("island", F.sum(F.when(F.col("pipe") & F.coalesce(F.lag("pipe").over(w), F.lit(False)), 0).otherwise(1)).over(w)).where("pipe")
    # Within an island a table starts at its first header line.
    own = Window.partitionBy("page", "island")
    x = x.withColumn("at", F.min(F.when(F.col("head"), F.col("i"))).over(own)).where("at IS NOT NULL AND (i = at OR i > at + 1)")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda s: F.trim(s))
    x = x.withColumn("cells", cells)
    x = x.withColumn("headers", F.min_by("cells", "i").over(own)).where("i > at")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("page", "island").orderBy("i")) - 1)
    x = x.withColumn("c", F.explode(F.sequence(F.lit(0), F.size("headers") - 1)))
    tbl = F.dense_rank().over(Window.partitionBy("page").orderBy("at")) - 1
    return x.select("page", tbl.alias("tbl"), "r", "c", F.get("headers", F.col("c")).alias("header"), F.coalesce(F.get("cells", F.col("c")), F.lit("")).alias("t"))


def rendered_headers(cells: DataFrame) -> DataFrame:
    one = cells.groupBy("table_id", "c").agg(F.any_value("header").alias("h"))
    name = F.coalesce(F.nullif(F.replace("h", F.lit("|"), F.lit("-")), F.lit("")), F.concat(F.lit("Col_"), (F.col("c") + 1).cast("string")))
    names = F.transform(F.sort_array(F.collect_list(F.struct("c", name.alias("n")))), lambda s: s["n"])
    return one.groupBy("table_id").agg(F.concat(F.lit("| "), F.array_join(names, " | "), F.lit(" |")).alias("header"))


def table_texts(rows: DataFrame, size: int) -> DataFrame:
    """table_id, first, n, body: tables (table_id, headers, r from 0, cells) as text with header and delimiter lines.

    A table of at most one and a half times size is one text. A longer one is cut into windows of max(2, rows / (length /
    size)) rows, in whole numbers, each with the header and a tag that names its rows.
    """
    own = Window.partitionBy("table_id")
    wide = F.greatest(F.size("headers"), F.max(F.size("cells")).over(own))
    x = rows.withColumn("wide", wide).withColumn("n_rows", F.count(F.lit(1)).over(own))
    name = lambda i: F.coalesce(F.nullif(F.get(F.col("headers"), i), F.lit("")), F.concat(F.lit("Col_"), (i + 1).cast("string")))
    cell = lambda i: F.trim(F.replace(F.coalesce(F.get(F.col("cells"), i), F.lit("")), F.lit("|"), F.lit("-")))
    places = F.sequence(F.lit(0), F.col("wide") - 1)
    line = lambda of: F.concat(F.lit("| "), F.array_join(F.transform(places, of), " | "), F.lit(" |"))
    x = x.withColumns({"line": line(cell), "head": F.concat(line(name), F.lit("\n"), line(lambda i: F.lit("---")))})
    x = x.withColumn("long", F.length("head") + F.sum(F.length("line") + 1).over(own))
    per = F.greatest(F.lit(2), F.floor(F.col("n_rows") / F.greatest(F.floor(F.col("long") / size), F.lit(1)))).cast("int")
    x = x.withColumn("per", F.when(F.col("long") <= 1.5 * size, F.col("n_rows").cast("int")).otherwise(per)).withColumn("first", (F.floor(F.col("r") / F.col("per")) * F.col("per")).cast("int"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n")
    g = x.groupBy("table_id", "first").agg(F.count(F.lit(1)).alias("n"), F.first("head").alias("head"), F.first("n_rows").alias("n_rows"), F.first("long").alias("long"), body.alias("rows"))
    tag = F.format_string(" [Table Slice Rows %d-%d of %d]", F.col("first") + 1, F.col("first") + F.col("n"), F.col("n_rows"))
    return g.select("table_id", "first", "n", F.concat("head", F.lit("\n"), "rows", F.when(F.col("long") <= 1.5 * size, "").otherwise(tag)).alias("body"))
