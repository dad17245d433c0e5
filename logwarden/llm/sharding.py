"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order and get the fractional rank (rank - 1/2) / rows of the source. All rows in
order of that fraction are cut into shards of equal row counts (law ``rows``: sizes at most one apart), so every shard holds
the sources in their overall proportions.

Ranks come from bucket counts and a window inside each bucket, never from one sorted group: the shuffle key and the
fraction are spread evenly over a number of buckets that follows the row count, so a source with a third of all rows is
ranked by many tasks, and only the counts per bucket are summed in order. Where many small sources share a fraction (sources of one
row all have 1/2), its rows have buckets of their own, by runs of sources.

Edge cases: null sources form a stratum; null texts have size 16 and crc32 of nothing (0); null ids and repeated rows are
ranked like others (rows that are equal in id, text and source are interchangeable); very long texts count whole; an empty table gives an empty result;
extra columns are carried by ``assign`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.session import written

SHARDS, SEED = 40, 20_240_501
#: Rows per ranking bucket, and the least and largest number of buckets (of one source, and of all rows).
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 512, 16_384


def shuffle_key(doc_id: Column) -> Column:
    """A seeded 60-bit number per document id."""
    seeded = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 15), 16, 10).cast("bigint")


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[str], rank: str, rows: str, also: DataFrame | None = None) -> DataFrame:
    """Adds the rank (from 1) of every row within ``groups`` in ``order``, and the rows of the group.

    ``bucket`` must follow that order; ``groups`` hold no nulls, so the window and the join share one shuffle of the rows.
    ``also`` has further columns per group.
    """
    keys = [*groups, "_bucket"]
    df = df.withColumn("_bucket", bucket)
    group = Window.partitionBy(*groups)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = counts.select(
        *keys, F.sum("_n").over(group).alias(rows),
        (F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    if also is not None:
        starts = starts.join(also, groups)
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = df.withColumn("_inner", inner).join(starts, keys)
    return placed.withColumn(rank, F.col("_before") + F.col("_inner")).drop("_bucket", "_inner", "_before")


def crowded(sources: DataFrame, buckets: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Fractions that more than ``most`` sources share, by cell, and the sources in ordered runs of about ``most``.

    Each source has one row at most at a fraction, so it takes many sources of one size to crowd it: of n rows, at most n / ``most``
    fractions are listed.
    """
    sources = written(sources)
    runs = max(1, -(-sources.count() // most))
    chunks = written(sources.repartitionByRange(runs, "_none", "_name").select("_none", "_name", F.spark_partition_id().alias("_chunk")))
    sizes = sources.groupBy("_m").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    parts = sizes.select("_m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))).alias("_r")).select(
        ((F.col("_r") * 2 - 1) / (F.col("_m") * 2)).alias("_part")).distinct()
    cells = parts.groupBy(F.floor(F.col("_part") * buckets).cast("int").alias("_cell")).agg(F.sort_array(F.collect_list("_part")).alias("_crowded"))
    return written(cells), chunks


def interleave(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Adds shard and slot to ``n`` rows that carry doc_id, source, size and text_crc32 as _id, _source, size, text_crc32."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_ROWS))
    ties = ["_key", "_id", "text_crc32", "size"]
    rows = rows.withColumns({"_key": shuffle_key(F.col("_id")), "_none": F.col("_source").isNull(),
                             "_name": F.coalesce("_source", F.lit(""))})
    width = (1 << 60) // buckets + 1
    by_source = ["_none", "_name"]
    most = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    crowd, chunks = crowded(rows.groupBy(*by_source).agg(F.count("*").alias("_m")), buckets, most)
    rows = ranked(rows, by_source, F.expr(f"cast(_key div {width} as int)"), ties, "_rank", "_rows", chunks)
    # Equal doubles for equal fractions of sources of one size; ties go by source, nulls last.
    rows = rows.withColumn("_part", (F.col("_rank") * 2 - 1) / (F.col("_rows") * 2))
    rows = rows.withColumns({"_all": F.lit(0), "_cell": F.floor(F.col("_part") * buckets).cast("int")})
    # Rows at a crowded fraction have buckets of their own, by runs of sources in order.
    rows = rows.join(F.broadcast(crowd), "_cell", "left")
    below = F.coalesce(F.size(F.filter("_crowded", lambda x: x < F.col("_part"))), F.lit(0))
    own = F.coalesce(F.array_contains("_crowded", F.col("_part")), F.lit(False))
    bucket = F.struct("_cell", F.when(own, 2 * below + 1).otherwise(2 * below).alias("place"), F.when(own, F.col("_chunk")).otherwise(0).alias("chunk"))
    rows = ranked(rows, ["_all"], bucket, ["_part", *by_source, *ties], "_place", "_total").drop("_cell", "_crowded", "_chunk")
    # Places count from 0; shard s begins at place ceil(s * n / shards).
    rows = rows.withColumn("_place", F.col("_place") - 1).withColumn("shard", F.expr(f"cast(_place * {shards} div _total as int)"))
    first = F.expr(f"(cast(shard as bigint) * _total + {shards - 1}) div {shards}")
    return rows.withColumn("slot", F.col("_place") - first).drop(
        "_id", "_source", "_key", "_none", "_name", "_rank", "_rows", "_part", "_all", "_place", "_total")


def measures(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(*more, F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"))


def plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot per row; texts stay where they are read."""
    return interleave(measures(docs, F.col("doc_id").alias("doc")), docs.count(), shards).withColumnRenamed("doc", "doc_id")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs``, and shard and slot (which replace columns of these names)."""
    placed = interleave(measures(docs, F.struct("*").alias("doc")), docs.count(), shards)
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*own, "shard", "slot")


#: crc32 of a text in SQL: a table of 256 remainders, then one step per byte of the text's hexadecimal form.
SQL = f"""
with recursive steps(i, k, c) as (
  select range::bigint, 0, range::bigint from range(256)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
remainders as materialized (select list(c order by i) as t from steps where k = 8),
hexed as (select doc_id, source, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
  select doc_id, source, (length(h) // 2 + 16)::bigint as size,
    xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295)::bigint as text_crc32,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
  from hexed, remainders),
ranked as (
  select *, (2 * row_number() over (partition by source order by k, doc_id, text_crc32, size) - 1)::double
            / (2 * count(*) over (partition by source))::double as part
  from summed),
placed as (
  select *, row_number() over (order by part, source is null, source, k, doc_id, text_crc32, size) - 1 as p, count(*) over () as n
  from ranked),
sharded as (select *, (p * {SHARDS} // n)::int as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard, (p - (shard::bigint * n + {SHARDS - 1}) // {SHARDS})::bigint as slot,
       null::int as grown_shard
from sharded
"""
