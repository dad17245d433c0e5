"""A corpus pipeline of five operators: each stage reads the documents that the one before kept.

All stages take any row: null and empty texts are neither toxic, nor near copies, nor benchmark passages; they stay, have
no words in the mix, and are sharded. Null doc_ids are kept by the near-duplicate
stage. Rows that repeat an id are judged by their own text; rows repeated exactly stay once behind the near-duplicate stage.
Very long texts are read whole. Further columns pass through, but for ``shard`` and ``slot``, which the last stage sets.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import decontam, mixing, neardup, sharding, toxicity
from logwarden.plans.registry import query
from logwarden.session import configure, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from ``labels``, does not predict toxic."""
    return toxicity.keep_clean(docs, _table(configure(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    configure(spark)
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(docs, _table(configure(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    configure(spark)
    return mixing.draw(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    configure(spark)
    return sharding.assign(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark),
          ("mixing", mix_sources), ("sharding", cut_shards)]
#: The toxicity model and the MinHash components cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = _table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def register() -> None:
    query("pipeline", ORACLE_SQL)(run)
