"""A pandas function per group, with large groups cut into bounded chunks where the caller allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHUNK_ROWS = 500_000


def apply_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn`` to every whole group, whatever its size; a group must fit the memory of one task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def apply_chunks(df: DataFrame, keys: list[str], row_id: str, fn, schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Apply a *mergeable* ``fn`` to every (group, chunk): its results are partial, and the caller merges them by a Spark aggregation.

    Calling this says that the function need not see its whole group; ``apply_groups`` is for those that must. A chunk
    holds about ``rows`` rows, chosen by a hash of ``row_id``; the chunk count comes from one grouped count joined back.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("bigint").alias("_chunks"))
    large = sizes.filter("_chunks > 1")
    cut = df.join(large, keys, "left").withColumn(
        "_chunk", F.when(F.col("_chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_id), F.col("_chunks"))))
    return cut.drop("_chunks").groupBy(*keys, "_chunk").applyInPandas(lambda pdf: fn(pdf.drop(columns="_chunk")), schema)
