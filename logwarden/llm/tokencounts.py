"""Token counts as delta-maintained rollups.

A batch is a table of signed changes: +1 for an inserted document, -1 for a deleted one, and both for a revised count (the
old count out, the new one in). A commit sums the changes by source, language and tokenizer version - partial sums first, so
a hot source is no burden - writes those sums under a new name, and publishes them by a manifest that remembers the batch. So a
batch that is committed twice, or again after a failure, counts once, and no commit reads texts. Totals are maintained: sums of
several batches are folded into one, level by level, so what a reader adds up stays small.

Edge cases: null sources and languages are groups of their own; null counts are 0; changes with a null sign are ignored; a
group without live documents is left out of the totals; an empty batch changes nothing; documents with a null id are no copies;
very long texts count whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logwarden.llm.mixing import word_count as spaced_words
from logwarden.session import scratch_path, written
from logwarden.sources.tables import BatchLog

GROUP = ["source", "lang", "version"]
DELTAS = "source string, lang string, version string, documents bigint, tokens bigint"
#: A digest of more than one row in so many is hot; there are at most so many.
HOT_SHARES = 50_000
#: Tokenizer versions that need no vocabulary.
VERSIONS = ("spaces-1", "letters-1", "bytes4-1")
MARKS = r"[%$&*#!|]+"


def letter_words(text: Column) -> Column:
    """Words of letters, digits and other alphabets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def counters(text: Column) -> dict[str, Column]:
    """Token counts of a text by tokenizer version."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return dict(zip(VERSIONS, (spaced_words(text), letter_words(text), F.ceil(size / 4).cast("bigint"))))


def bpe_counter(text: Column, path: str) -> Column:
    """Tokens of a text by a byte-pair vocabulary file (``tokenizers`` JSON), which every executor must be able to open."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        texts = [x or "" for x in column.to_pylist()]
        return pa.array([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], pa.int64())

    return run(text)


def changes(counted: DataFrame, sign: int, counts: Mapping[str, str]) -> DataFrame:
    """Signed change rows of documents whose counts by version stand in the named columns."""
    cells = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for v, c in counts.items()])
    return counted.select("source", "lang", F.inline(cells), F.lit(sign).alias("sign"))


def summed(deltas: DataFrame) -> DataFrame:
    """Additive deltas of several batches as one, without groups that cancel out."""
    return deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter(
        "documents <> 0 or tokens <> 0")


class Rollup:
    """Totals under a path of a file system that all executors share: a log of additive deltas, folded level by level.

    A batch is written under a new name and then published by one manifest, so a commit that dies leaves the totals as they were, and
    one that is repeated changes nothing. Every ``fanout`` parts of one level become one of the next, so a reader opens a logarithm
    of the batches.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 8):
        self.spark, self.path = spark, path or scratch_path(spark)
        self.log = BatchLog(spark, self.path, fold=summed, fanout=fanout)

    def commit(self, batch: str, signed: DataFrame, number: int = 0) -> bool:
        """Add a batch's deltas, unless it is known; whether it was new.

        ``batch`` names a feed whose batches have ascending ``number``; the manifest remembers the last number of every feed.
        """
        sign, tokens = F.col("sign").cast("bigint"), F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint")
        deltas = signed.filter("sign is not null").groupBy(*GROUP).agg(F.sum(sign).alias("documents"), F.sum(sign * tokens).alias("tokens"))
        return self.log.append(deltas, batch, number)

    def totals(self) -> DataFrame:
        """source, lang, version, documents and tokens over all committed batches."""
        deltas = self.log.read()
        return summed(self.spark.createDataFrame([], DELTAS) if deltas is None else deltas).filter("documents <> 0")


def without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: a smaller doc_id has the same digest.

    Digests with more than one row in ``HOT_SHARES`` are at most that many: their rows meet the first id by broadcast, all others by shuffle.
    """
    firsts = written(rows.filter("doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).filter("first_id < last_id"))
    hot = F.col("n") > max(rows.count() // HOT_SHARES, 1)
    hot, rest = (F.broadcast(firsts.filter(hot).select("digest", "first_id")), firsts.filter(~hot).select("digest", "first_id"))
    both = rows.join(hot, "digest").unionByName(
        rows.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    return both.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))


def maintain(docs: DataFrame, rollup: Rollup) -> DataFrame:
    """Totals after three batches: all documents in, later exact copies out, counts of the rest revised to the text without
    ornaments (runs of ``%$&*#!|``). The second batch is committed twice, as after a lost answer."""
    rows = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"),
                       *[c.alias(f"old_{i}") for i, c in enumerate(counters(F.col("text")).values())])
    # A text without ornaments is counted once.
    adorned, plain = F.col("text").rlike(MARKS), F.regexp_replace("text", MARKS, "")
    counted = written(rows.select("doc_id", "source", "lang", "digest", *[f"old_{i}" for i in range(len(VERSIONS))], *[
        F.when(adorned, c).otherwise(F.col(f"old_{i}")).alias(f"new_{i}") for i, c in enumerate(counters(plain).values())]))
    old, new = ({v: f"{k}_{i}" for i, v in enumerate(VERSIONS)} for k in ("old", "new"))
    placed = written(without_copies(counted))
    rollup.commit("load", changes(counted, 1, old))
    for _ in range(2):
        rollup.commit("copies", changes(placed.filter("copy"), -1, old))
    rest = placed.filter("not copy")
    rollup.commit("revise", changes(rest, -1, old).unionByName(changes(rest, 1, new)))
    return rollup.totals()


SQL = """
with live as (
  select source, lang, coalesce(regexp_replace(text, '[%$&*#!|]+', '', 'g'), '') as t
  from documents d
  where not coalesce(doc_id > (select min(doc_id) from documents e where coalesce(e.text, '') = coalesce(d.text, '')), false)),
counted as (
  select source, lang, unnest(['spaces-1', 'letters-1', 'bytes4-1']) as version,
    unnest([len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')),
            len(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
            (strlen(t) + 3) // 4])::bigint as tokens
  from live)
select source, lang, version, count(*)::bigint as documents, sum(tokens)::bigint as tokens from counted group by source, lang, version
"""
