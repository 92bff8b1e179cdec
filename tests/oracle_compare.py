"""Runs queries of the entry point beside their SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(names: list[str], values: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def difference(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want, got = rows(names, rel.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    if want != got:
        return f"{sum(got.values())} rows, SQL {sum(want.values())}; only ours {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
