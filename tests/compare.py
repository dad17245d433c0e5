"""Run a query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a message."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if not _close(g, w)]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, cols {cols}, e.g. {bad[0][0]} != {bad[0][1]}"
    if not got:
        return "no rows"
    return None


def _close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b and type(a) is type(b)
