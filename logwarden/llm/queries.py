"""Registered queries of the corpus operators: each derives its digest columns from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.llm import (decontam, exactdedup, filteraudit, hardneg, langid, linededup, mixing, neardup, ngramjoin, sharding,
                           tokencounts, toxicity, urlfilter)
from logwarden.llm.textops import fold
from logwarden.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    return (fold(F.col("doc_id")) == 2).alias("held_out")


@query("op1_toxicity")
def op1(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(), "score", "predicted", F.size("spans").cast("bigint").alias("n_spans"))


@query("op2_minhash_near_dedup")
def op2(spark, sf_dir):
    return neardup.link(table(spark, sf_dir, "documents"))


@query("op3_source_mixing", mixing.SQL)
def op3(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("copies")


@query("op4_token_counts", tokencounts.SQL)
def op4(spark, sf_dir):
    return tokencounts.maintain(table(spark, sf_dir, "documents"), tokencounts.Rollup(spark))


@query("op5_language_id")
def op5(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents")).select("doc_id", held_out(), "lang_pred", "score")


@query("op6_exact_dedup", exactdedup.SQL)
def op6(spark, sf_dir):
    return exactdedup.resolve(table(spark, sf_dir, "documents"))


@query("op7_url_filters", urlfilter.SQL)
def op7(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


@query("op8_sharding", sharding.SQL)
def op8(spark, sf_dir):
    return sharding.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_benchmark_decontamination", decontam.SQL)
def op9(spark, sf_dir):
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


@query("op10_line_dedup", linededup.SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.bitmaps(docs))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op11_filter_audit", filteraudit.SQL)
def op11(spark, sf_dir):
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_ngram_jaccard_join", ngramjoin.SQL)
def op12(spark, sf_dir):
    return ngramjoin.link(table(spark, sf_dir, "documents")).drop("class_size")


@query("op13_hard_negatives", hardneg.SQL)
def op13(spark, sf_dir):
    return hardneg.mine(table(spark, sf_dir, "embeddings"))
