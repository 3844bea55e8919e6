"""Order-insensitive comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


KINDS = {
    "int": "int", "bigint": "bigint", "string": "text", "double": "double",
    "boolean": "bool", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
    "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "text", "DOUBLE": "double",
    "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "DATE": "date", "JSON": "text",
}


def spark_result(df):
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    return kinds, names, rows


def duckdb_result(con, sql: str):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    rows = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    return kinds, names, rows


def difference(left, right) -> str | None:
    """None when equal, else a short description."""
    (lk, ln, lr), (rk, rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} <> {rn}"
    if lk != rk:
        return f"types {[(n, lk[n], rk[n]) for n in ln if lk[n] != rk[n]]}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} <> {len(rr)}"
    for a, b in zip(lr, rr):
        if a != b:
            return f"first difference in {ln}:\n{a}\n{b}"
    return None
