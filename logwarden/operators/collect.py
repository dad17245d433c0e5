"""Collection-time filters, metadata and transforms."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

log = logging.getLogger(__name__)


def _usable(df: DataFrame, patterns: list[str]) -> list[str]:
    """Patterns that the engine which runs them accepts; Python's named groups are rewritten first.

    The engine's own compiler checks them on the driver, so no job runs.
    """
    out, compiler = [], df.sparkSession._jvm.java.util.regex.Pattern
    for p in patterns:
        p = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", p)
        try:
            compiler.compile(p)
            out.append(p)
        except Exception as e:
            log.warning("pattern %r skipped: %s", p, str(e).splitlines()[0])
    return out


def filter_patterns(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """the row as JSON text; any exclude match drops it, and one include must match when there are some."""
    text, keep = F.to_json(F.struct("*")), F.lit(True)
    for p in _usable(df, exclude or []):
        keep = keep & ~text.rlike(p)
    wanted = _usable(df, include or [])
    if wanted:
        hit = F.lit(False)
        for p in wanted:
            hit = hit | text.rlike(p)
        keep = keep & hit
    return df.filter(keep)


def with_metadata(df: DataFrame, collector: str, tags: list[str] | None = None) -> DataFrame:
    """collector, time, tags and an id from the content (the same row always gets the same id)."""
    return df.withColumns({
        "_collector": F.lit(collector),
        "_collected_at": F.current_timestamp(),
        "_id": F.sha2(F.to_json(F.struct("*")), 256),
        "_tags": F.array(*[F.lit(t) for t in tags or []]).cast("array<string>"),
    })


def apply_transform(df: DataFrame, column: str, change: Column | str) -> DataFrame:
    """replace a field by an expression (Column or SQL text); null keeps the original."""
    new = F.expr(change) if isinstance(change, str) else change
    return df.withColumn(column, F.coalesce(new.cast(df.schema[column].dataType), F.col(column)))


def json_path(column: str, path: str) -> Column:
    """a jq-like path (``.a.b[0]``) into a JSON text."""
    return F.get_json_object(column, "$" + path)


def record_udf(fn: Callable[[str], str | None]):
    """A user function on one text field as an Arrow function; an error or None keeps the original."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                out = fn(x)
            except Exception:
                return x
            return x if out is None else out

        return values.map(one, na_action="ignore")

    return run


def filter_in(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """every listed field must hold one of its values."""
    for column, values in allowed.items():
        df = df.filter(F.col(column).isin(values))
    return df


def collector_stats(df: DataFrame, kept: Column, error: Column, ts: str = "ts") -> DataFrame:
    """collected, filtered, errors and last success per collector."""
    return df.groupBy("_collector").agg(
        F.count_if(kept & ~error).alias("collected"), F.count_if(~kept & ~error).alias("filtered"),
        F.count_if(error).alias("errors"), F.max(F.when(kept & ~error, F.col(ts))).alias("last_success"))


def normalization_stats(df: DataFrame, error: Column) -> DataFrame:
    """processed, normalized and errors of the normalizers."""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if("_normalized").alias("normalized"),
                  F.count_if(error).alias("errors"))


def filter_by_source(df: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """events of enabled sources whose id, facility and severity lists (null: any) allow them."""
    rules = sources.filter("enabled").select(
        key, *[F.col(c).alias(f"_{c}") for c in ("event_ids", "facilities", "severities")])
    allows = lambda rule, c: F.col(rule).isNull() | F.coalesce(F.array_contains(rule, F.col(c)), F.lit(False))
    out = df.join(rules, key)
    out = out.filter(allows("_event_ids", "code") & allows("_facilities", "facility") & allows("_severities", "severity"))
    return out.drop("_event_ids", "_facilities", "_severities")


def preprocess(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The caller's preprocessing steps in order, each a function of one DataFrame; they join the query's plan."""
    for step in steps:
        df = df.transform(step)
        if not isinstance(df, DataFrame):
            raise TypeError(f"step {getattr(step, '__name__', step)} returned no DataFrame")
    return df
