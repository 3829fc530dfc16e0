"""Named queries, each with SQL for a second engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(v) -> str:
    """A Python value as a SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


class Fixture:
    """A small relation that both engines hold: a DataFrame here, VALUES there."""

    def __init__(self, schema: str, rows: Sequence[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.names = [c.strip().split()[0] for c in _columns(schema)]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) v({', '.join(self.names)}))"


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def case(pairs: Sequence[tuple[str, str]], test: str, otherwise: str = "NULL") -> str:
    """CASE over (name, pattern) in order; test has {p} for the pattern's literal."""
    whens = " ".join(f"WHEN {test.format(p=literal(p))} THEN {literal(n)}" for n, p in pairs)
    return f"CASE {whens} ELSE {otherwise} END"
