"""Oracle comparison in the spirit of the driver: row count, column names and
types, and an order-insensitive hash of the values (exact, no tolerance)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        return "f" + (repr(v) if v == v else "nan")      # repr keeps the sign of zero: strict
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, decimal.Decimal):
        return "f" + repr(float(v))
    if isinstance(v, dt.datetime):
        return "t" + v.isoformat()
    if isinstance(v, dt.date):
        return "d" + v.isoformat()
    return "s" + str(v)


def digest(cols: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), [cols[i] for i in order], h


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def diff(spark_cols, spark_data, duck_cols, duck_data, limit: int = 5) -> str:
    """Human-readable first differences, for failing tests."""
    a = digest(spark_cols, spark_data)
    b = digest(duck_cols, duck_data)
    out = [f"rows {a[0]} vs {b[0]}", f"cols {a[1]} vs {b[1]}"]
    order_a = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    order_b = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    la = sorted("|".join(_norm(r[i]) for i in order_a) for r in spark_data)
    lb = sorted("|".join(_norm(r[i]) for i in order_b) for r in duck_data)
    only_a = sorted(set(la) - set(lb))[:limit]
    only_b = sorted(set(lb) - set(la))[:limit]
    out += ["spark only:"] + only_a + ["duck only:"] + only_b
    return "\n".join(out)
