"""Sinks, stored parameters and table descriptions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


def upsert(target: DataFrame, changes: DataFrame, key: str, *, partial: bool = True, ts: str | None = None,
           now: datetime.datetime | None = None) -> DataFrame:
    """Target with the changes merged by id; null change fields keep the old value when ``partial``.

    ``changes`` has one row per id. A missing time column value becomes ``now``.
    """
    cols = [c for c in target.columns if c != key]
    new = changes.select(key, *[(F.col(c) if c in changes.columns else F.lit(None).cast(target.schema[c].dataType))
                                .alias(f"_n_{c}") for c in cols], F.lit(True).alias("_changed"))
    out = target.join(new, key, "full_outer")
    pick = (lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(c))) if partial else (
        lambda c: F.when(F.col("_changed"), F.col(f"_n_{c}")).otherwise(F.col(c)))
    out = out.select(key, *[pick(c).alias(c) for c in cols])
    return out.withColumn(ts, F.coalesce(F.col(ts), F.lit(now))) if ts and now else out


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Target without the listed ids."""
    return target.join(ids.select(key).distinct(), key, "left_anti")


def write_features(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Feature rows partitioned by event date; a date's rows are spread over tasks, so a busy date is not one task."""
    df.withColumn("event_date", F.to_date(ts)).write.mode(mode).partitionBy("event_date").parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def describe_schema(df: DataFrame) -> DataFrame:
    """Position, name, type, declared nullability and counted nulls of every column, in one pass."""
    counted = df.agg(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(f.name).alias("column_name"),
                                F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
                                F.count_if(F.col(f"`{f.name}`").isNull()).alias("null_count"),
                                F.count(F.lit(1)).alias("row_count")).alias(f"c{i}")
                       for i, f in enumerate(df.schema.fields)])
    return counted.select(F.inline(F.array(*[f"c{i}" for i in range(len(df.columns))])))


PARAMS_SCHEMA = "model_id string, version string, kind string, feature string, name string, value double"


def save_params(spark: SparkSession, rows: list[tuple], model_id: str, version: str, path: str) -> None:
    """(kind, feature, name, value) parameters of one model version."""
    out = spark.createDataFrame([(model_id, version, *r) for r in rows], PARAMS_SCHEMA)
    out.write.mode("append").partitionBy("model_id").parquet(path)


def load_params(spark: SparkSession, path: str, model_id: str, version: str) -> DataFrame:
    """The stored parameters; the model id prunes the directory."""
    df = spark.read.schema(PARAMS_SCHEMA).parquet(path)
    return df.filter((F.col("model_id") == model_id) & (F.col("version") == version))
