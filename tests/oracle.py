"""Comparison of a query with its SQL on DuckDB."""

import decimal
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(names: list[str], found: list[tuple]) -> list[str]:
    """Rows in one spelling: columns by name, numbers as numbers whatever their type."""

    def plain(v):
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (bool, str)) or v is None:
            return v
        if isinstance(v, (int, float, decimal.Decimal)):
            return None if v != v else float(round(v, 6)) if abs(v) < 2**53 else int(v)
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in found)
