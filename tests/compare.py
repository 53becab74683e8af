"""Runs a registered query and its SQL and compares columns, types and rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "float": "FLOAT"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "~" if v is None else str(v)


def differences(df, db, sql: str) -> list[str]:
    """What differs; empty when the query and the SQL agree."""
    got = df.collect()
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, (str(d[1]) for d in result.description), strict=True))
    want = result.fetchall()
    order = sorted(df.columns)
    out = []
    if order != sorted(names):
        return [f"columns {order} and {sorted(names)}"]
    out += [f"{n}: {k} and {kinds[n]}" for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]]
    a = sorted(tuple(plain(r[c]) for c in order) for r in got)
    at = [names.index(c) for c in order]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, as {order}: {bad[0][0]} and {bad[0][1]}")
    return out
