"""Row-level, categorical and numerical features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.behaviour import behaviour_features
from logwarden.operators.ordered import arrange, census
from logwarden.operators.quantiles import quantiles


def counted_values(df: DataFrame, column: str, counted: DataFrame) -> DataFrame:
    """The column's values and their counts from a ``census``, in the column's own type."""
    return counted.filter((F.col("k") == column) & F.col("v").isNotNull()).select(
        F.col("v").cast(df.schema[column].dataType).alias(column), F.col("n").alias("count"))


def top_values(df: DataFrame, column: str, n: int, counted: DataFrame | None = None) -> tuple[list, bool]:
    """The ``n`` most frequent values (ties by value) and whether there are more; at most n+1 rows reach the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count() if counted is None else counted_values(df, column, counted)
    rows = counts.orderBy(F.desc("count"), column).limit(n + 1).collect()
    return [r[0] for r in rows[:n]], len(rows) > n


def top_n_other(df: DataFrame, column: str, n: int = 10, name: str | None = None, top: tuple[list, bool] | None = None
                ) -> DataFrame:
    """Values outside the ``n`` most frequent become 'other' (nulls too, once there are more)."""
    values, more = top or top_values(df, column, n)
    c = F.col(column)
    kept = F.when(c.isin(values), c).otherwise(F.lit("other")) if more else c
    return df.withColumn(name or column, kept)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """One 0/1 column per value and one for null; the column itself is dropped."""
    c = F.col(column)
    flags = {f"{column}_{v}": F.coalesce(c == F.lit(v), F.lit(False)).cast("bigint") for v in values}
    flags[f"{column}_nan"] = c.isNull().cast("bigint")
    return df.withColumns(flags).drop(column)


def value_dictionary(df: DataFrame, column: str, name: str = "code", counted: DataFrame | None = None, **how) -> DataFrame:
    """Distinct values numbered from 0 in value order, without a one-task window."""
    if counted is None:
        distinct = df.filter(F.col(column).isNotNull()).select(column).distinct()
    else:
        distinct = counted_values(df, column, counted).select(column)
    o = arrange(distinct, [], [column], **how).running(**{name: ("count", F.lit(1))})
    return o.derive(**{name: F.col(name) - 1}).done()


def label_encode(df: DataFrame, column: str, name: str | None = None, codes: DataFrame | None = None, **how) -> DataFrame:
    """Dense code of the value in value order, -1 for null."""
    name = name or f"{column}_encoded"
    out = df.join(value_dictionary(df, column, name, **how) if codes is None else codes, column, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def clean_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and NaN become null."""
    return df.withColumns({c: finite(c) for c in columns})


def impute_median(df: DataFrame, columns: list[str], medians: dict | None = None) -> DataFrame:
    """Nulls become the column's exact median."""
    medians = medians or quantiles(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0])) for c in columns})


def log_feature(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """ln(x + offset); offset 1, or abs(min) + 1 when the minimum is negative."""
    low = df.agg(F.min(column)).scalar()
    offset = F.when(low >= 0, F.lit(1.0)).otherwise(F.abs(low) + 1)
    return df.withColumn(name or f"{column}_log", F.log(F.col(column) + offset))


def quantile_bin(df: DataFrame, column: str, q: int, name: str | None = None) -> DataFrame:
    """0-based equal-frequency bin, right-closed; equal edges merge."""
    edges = sorted(set(quantiles(df, [column], [i / q for i in range(q + 1)])[column]))
    x = F.col(column)
    passed = sum(((x > F.lit(e)).cast("bigint") for e in edges[1:-1]), F.lit(0))
    return df.withColumn(name or f"{column}_binned", F.when(x.isNotNull(), passed))


def time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, day, weekday (Monday 0), month."""
    return df.withColumns({
        "hour": F.hour(ts).cast("bigint"),
        "day": F.dayofmonth(ts).cast("bigint"),
        "weekday": F.weekday(ts).cast("bigint"),
        "month": F.month(ts).cast("bigint"),
    })


def cyclic_time(df: DataFrame) -> DataFrame:
    """Hour and weekday on the unit circle; needs E08."""
    h, d = F.col("hour") * (2 * math.pi / 24), F.col("weekday") * (2 * math.pi / 7)
    return df.withColumns({"hour_sin": F.sin(h), "hour_cos": F.cos(h), "weekday_sin": F.sin(d), "weekday_cos": F.cos(d)})


def calendar_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    """day_of_week, is_weekend, is_business_hours (9 to 16, any day)."""
    day = F.weekday(ts).cast("bigint")
    return df.withColumns({
        "day_of_week": day,
        "is_weekend": day >= 5,
        "is_business_hours": F.hour(ts).between(9, 16),
    })


def extract_features(df: DataFrame, *, one_hot_columns: dict[str, int] | None = None,
                     label_columns: list[str] | None = None, numeric: list[str] | None = None,
                     temporal: bool = True, **how) -> DataFrame:
    """The feature frame. Behaviour comes first because encoding drops the entity columns it needs.

    Medians, frequent values and dictionaries are taken from the input, not from the derived frame.
    """
    numeric = ["duration"] if numeric is None else numeric
    medians = quantiles(clean_inf(df, numeric), numeric, [0.5]) if numeric else {}
    # One pass counts the values of every column that is asked for its frequent values, its codes or its hot keys.
    counted = census(df, ["source_ip", "username", "action", *(one_hot_columns or {}), *(label_columns or [])])
    tops = {c: top_values(df, c, n, counted) for c, n in (one_hot_columns or {}).items()}
    codes = {c: value_dictionary(df, c, f"{c}_encoded", counted, **how) for c in label_columns or []}
    df = behaviour_features(df, counted=counted, **how)
    if numeric:
        df = impute_median(clean_inf(df, numeric), numeric, medians)
    if temporal:
        df = cyclic_time(time_parts(df))
    for column, top in tops.items():
        df = one_hot(top_n_other(df, column, top=top), column, top[0] + (["other"] if top[1] else []))
    for column, dictionary in codes.items():
        df = label_encode(df, column, codes=dictionary).drop(column)
    return df


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Feature columns as one dense array, in the given order."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))
