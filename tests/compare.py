"""Strict comparison of a Spark result with DuckDB's answer to the oracle text."""

from __future__ import annotations

import contextlib
import datetime
import decimal
import io
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plan_text(df) -> str:
    """The formatted plan, untruncated."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return f"f:{0.0 if v == 0 else v!r}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return f"t:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return f"s:{v}"


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return sorted(df.columns), bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), bag(columns, cur.fetchall())


def difference(spark_side, duck_side) -> str | None:
    (sc, sb), (dc, db) = spark_side, duck_side
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if sb == db:
        return None
    only_s, only_d = list((sb - db).elements()), list((db - sb).elements())
    return f"rows {sum(sb.values())} vs {sum(db.values())}; only spark {sorted(only_s)[:3]}; only sql {sorted(only_d)[:3]} ({len(only_s)})"
