"""Search, sorting and paging (Q01-Q07). Limits here are the page a caller asks for."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(c: str = "severity") -> Column:
    return reduce(lambda acc, kv: acc.when(F.col(c) == kv[0], kv[1]), SEVERITY_RANK.items(), F).otherwise(0)


def page_of(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def find_detections(df: DataFrame, *, min_score: float | None = None, method: str | None = None,
                    acknowledged: bool | None = None, start=None, end=None, offset: int = 0, limit: int = 100
                    ) -> DataFrame:
    """Q01: newest first."""
    tests = [
        (min_score, lambda v: F.col("anomaly_score") >= v),
        (method, lambda v: F.col("detection_method") == v),
        (acknowledged, lambda v: F.col("acknowledged") == v),
        (start, lambda v: F.col("ts") >= F.lit(v)),
        (end, lambda v: F.col("ts") <= F.lit(v)),
    ]
    for value, test in tests:
        if value is not None:
            df = df.filter(test(value))
    return page_of(df, [F.desc("ts"), "event_id"], offset, limit)


def find_incidents(df: DataFrame, *, status: str | None = None, severity: str | None = None, assigned_to=None,
                   created_from=None, created_to=None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Q02: newest first."""
    tests = [
        (status, lambda v: F.col("status") == v),
        (severity, lambda v: F.col("severity") == v),
        (assigned_to, lambda v: F.col("assigned_to") == v),
        (created_from, lambda v: F.col("created_at") >= F.lit(v)),
        (created_to, lambda v: F.col("created_at") <= F.lit(v)),
    ]
    for value, test in tests:
        if value is not None:
            df = df.filter(test(value))
    return page_of(df, [F.desc("created_at"), "id"], offset, limit)


def criterion(schema: T.StructType, field: str, op: str, value) -> Column:
    """One search test; an unknown field or operation never matches, also not for ``neq``."""
    if field not in schema.names:
        return F.lit(False)
    c, kind = F.col(field), schema[field].dataType
    if op == "eq":
        return c.eqNullSafe(F.lit(value))
    if op == "neq":
        return ~c.eqNullSafe(F.lit(value))
    if op == "gt":
        return F.coalesce(c > F.lit(value), F.lit(False))
    if op == "lt":
        return F.coalesce(c < F.lit(value), F.lit(False))
    if op == "contains" and isinstance(kind, T.StringType):
        return F.coalesce(c.contains(value), F.lit(False))
    if op == "contains" and isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_contains(c, value), F.lit(False))
    if op == "startswith" and isinstance(kind, T.StringType):
        return F.coalesce(c.startswith(value), F.lit(False))
    return F.lit(False)


def search(df: DataFrame, criteria: list[tuple[str, str, object]], op: str = "and") -> DataFrame:
    """Q03: rows matching all ('and') or any ('or') of (field, operation, value)."""
    tests = [criterion(df.schema, *c) for c in criteria]
    if op == "and":
        return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))
    return df.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def paginate(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Q04: one page with total rows and total pages; page >= 1, size 1..100."""
    page, size = max(page, 1), min(max(size, 1), 100)
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = page_of(df, order, (page - 1) * size, size)
    return rows.withColumns({"total": total, "pages": F.ceil(total / size).cast("bigint")})


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """Q05: the row with this id."""
    return df.filter(F.col(key) == F.lit(value))


def exists_count(df: DataFrame, condition: Column) -> DataFrame:
    """Q05: whether rows match and how many."""
    counted = df.agg(F.count_if(condition).alias("matches"))
    return counted.select((F.col("matches") > 0).alias("found"), "matches")


def sort_incidents(df: DataFrame, mode: str = "severity_desc", text: str | None = None) -> DataFrame:
    """Q06: by severity rank or creation time, optionally only titles that contain a text (any case)."""
    if text:
        df = df.filter(F.lower("title").contains(text.lower()))
    rank = severity_rank()
    order = {"severity_desc": rank.desc(), "severity_asc": rank.asc(), "newest": F.desc("created_at"),
             "oldest": F.asc("created_at")}[mode]
    return df.orderBy(order, "id")


# The time ranges a dashboard offers.
RANGES = {"24h": datetime.timedelta(hours=24), "7d": datetime.timedelta(days=7), "30d": datetime.timedelta(days=30)}


def dash_filter(df: DataFrame, *, time_column: str, now: datetime.datetime, time_range: str = "24h", start=None,
                end=None, min_score: float | None = None, equals: dict | None = None) -> DataFrame:
    """Q07: time range (24h, 7d, 30d or custom start/end), equality filters ('all' keeps everything), score."""
    t = F.col(time_column)
    if time_range == "custom":
        df = df.filter((t >= F.lit(start)) & (t <= F.lit(end)))
    elif time_range in RANGES:
        df = df.filter((t >= F.lit(now - RANGES[time_range])) & (t <= F.lit(now)))
    for column, value in (equals or {}).items():
        if value not in (None, "all"):
            df = df.filter(F.col(column) == F.lit(value))
    if min_score is not None:
        df = df.filter(F.col("anomaly_score") >= min_score)
    return df
