"""Incremental reads and the JDBC source."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


def high_water(df: DataFrame, ts: str = "ts"):
    """The largest time seen."""
    return df.agg(F.max(ts)).first()[0]


def since(df: DataFrame, mark, ts: str = "ts") -> DataFrame:
    """Rows newer than the mark; a literal bound, so it reaches the scan."""
    return df if mark is None else df.filter(F.col(ts) > F.lit(mark))


def save_mark(spark: SparkSession, path: str, source: str, mark) -> None:
    """Append the mark to a small table; the newest entry of a source counts."""
    spark.createDataFrame([(source, mark)], "source string, mark timestamp").write.mode("append").parquet(path)


def load_mark(spark: SparkSession, path: str, source: str):
    return spark.read.schema("source string, mark timestamp").parquet(path).filter(F.col("source") == source).agg(
        F.max("mark")).first()[0]


def in_timespan(df: DataFrame, minutes: int, end: datetime.datetime, ts: str = "ts") -> DataFrame:
    """Rows of the last ``minutes`` before ``end``."""
    return df.filter(F.col(ts).between(F.lit(end - datetime.timedelta(minutes=minutes)), F.lit(end)))


def jdbc_options(url: str, query: str, *, ts: str | None = None, mark: datetime.datetime | None = None,
                 partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8,
                 **extra) -> dict[str, str]:
    """Reader options; the high-water filter is part of the remote query and a numeric column splits the read."""
    if ts and mark is not None:
        query = f"SELECT * FROM ({query}) t WHERE {ts} > TIMESTAMP '{mark:%Y-%m-%d %H:%M:%S.%f}'"
    options = {"url": url, **{k: str(x) for k, x in extra.items()}}
    if partition_column and bounds:
        options |= {"dbtable": f"({query}) q", "partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    else:
        options["query"] = query
    return options


def read_jdbc(spark: SparkSession, url: str, query: str, **how) -> DataFrame:
    """An audit table by query."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **how)).load()
