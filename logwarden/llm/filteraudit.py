"""Audit of five filters in every order: truth-table survival words and carry-save positional popcounts.

A document fails some of the filters A to E. Its survival word has one bit per subset of the filters: bit s is set when no
filter of subset s would remove it. Counting the set bits per position over all words of a part therefore gives the survivors of
every subset at once, and whatever order the filters run in, the rows kept after a step are the survivors of one subset. All 120
orders follow from the 32 counts, for all documents and for those with a label.

Positions are counted with full adders on whole words (carry-save): level k holds at most two words whose bits weigh 2^k. Tasks
return 32 sums per part and label class, Spark adds these up; no task sees more than its own rows, however large a part is.

Filter E needs the smallest doc_id of each text: texts are compared by SHA-256. Digests that hold at least one row in
``HOT_SHARES`` are at most that many and travel by broadcast; the rows of all others meet their smallest id by a shuffle.

Edge cases: null text counts as empty; a null source and an empty one are the part ''; a null doc_id fails no E, is nobody's
smaller id and has no label; rows that repeat a doc_id all count, and equal texts under one id do not fail E by each other; several
labels of one id count when any of them is 1; very long texts count whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.textops import SPACES, Hasher, Words, chunks, map_texts
from logwarden.session import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")
#: A digest with more than one row in so many counts as hot; there are at most so many hot digests.
HOT_SHARES = 50_000
#: A task gives away its sums when it holds so many parts and classes.
MOST_HELD = 4096

# The characters of filter D.
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b"#$%&*|")] = True


def text_failures(data: np.ndarray, bounds: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Per text the bits of the failed filters A to D."""
    words = Words(data, bounds, SPACES)
    (h,) = hasher.spans(data, words.starts, words.ends)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[words.first[:-1][words.counts > 0]] = True

    def per_text(flags, at=bounds):
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[at])

    points = per_text((data & 0xC0) != 0x80)
    capitals = per_text((data >= 65) & (data <= 90))
    failed = [words.counts < 200, 100 * per_text(fresh, words.first) < 50 * words.counts, 100 * capitals > 2 * points,
              per_text(MARKS[data]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def marked(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, digest of the text, and the bits of the failed filters A to D."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    def make():
        hasher = Hasher()

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(3)):
                fails = text_failures(data, bounds, hasher)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(3)), pa.array(fails, pa.int32())],
                                                 names=["doc_id", "part", "digest", "fails"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return map_texts(rows, make, "doc_id bigint, part string, digest binary, fails int")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """``marked`` rows with the bit of filter E: a smaller doc_id has an identical text."""
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    firsts = written(firsts.select("digest", "first", "n"))
    hot = F.col("n") > max(rows.count() // HOT_SHARES, 1)
    hot, rest = F.broadcast(firsts.filter(hot).drop("n")), firsts.filter(~hot).drop("n")
    both = rows.join(hot, "digest").unionByName(
        rows.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", F.when(again, F.col("fails").bitwiseOR(DUPLICATE)).otherwise(F.col("fails")).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their label class: 1 for quality, plus 2 for toxic."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("_id")).agg(
        (flag("quality") + 2 * flag("toxic")).alias("class"))
    # Null ids find no label; the second key spreads them over all tasks.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    met = rows.withColumn("_k", spread).join(known.withColumn("_0", F.lit(0).cast("bigint")),
                                             (F.col("doc_id") == F.col("_id")) & (F.col("_k") == F.col("_0")), "left")
    return met.select("part", "fails", F.coalesce("class", F.lit(0)).alias("class"))


def survival_word(fails: int) -> int:
    """Bit s says whether a document with these failed filters survives the filters of subset s."""
    return sum(1 << s for s in range(SUBSETS) if not s & fails)


class Popcounts:
    """How often each of 32 positions is set in the words added so far, kept as carry-save levels."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level = 0
        while len(words):
            if level == len(self.levels):
                self.levels.append(np.zeros(0, dtype=np.uint32))
            held, carried = np.concatenate([self.levels[level], words]), []
            while len(held) > 2:
                third = len(held) // 3
                a, b, c = held[:3 * third].reshape(3, third)
                half = a ^ b
                carried.append(a & b | half & c)
                held = np.concatenate([half ^ c, held[3 * third:]])
            self.levels[level] = held
            words = np.concatenate([np.zeros(0, dtype=np.uint32), *carried])
            level += 1

    def counts(self) -> np.ndarray:
        out = np.zeros(SUBSETS, dtype=np.int64)
        for level, held in enumerate(self.levels):
            bits = held[:, None] >> np.arange(SUBSETS, dtype=np.uint32) & np.uint32(1)
            out += bits.sum(axis=0, dtype=np.int64) << level
        return out


def survivors(rows: DataFrame) -> DataFrame:
    """(part, class, counts): per task, the survivors of each of the 32 subsets; sums over tasks are the totals."""
    words = [survival_word(f) for f in range(SUBSETS)]

    def run(batches):
        truth, held = np.array(words, dtype=np.uint32), {}

        def give():
            keys = list(held)
            counts = [held[k].counts().tolist() for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                               pa.array(counts, pa.list_(pa.int64()))], names=["part", "class", "counts"])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key = code * 4 + batch.column(2).to_numpy(zero_copy_only=False)
            order = key.argsort(kind="stable")
            key, own = key[order], truth[batch.column(1).to_numpy(zero_copy_only=False)[order]]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for at, to in zip(cuts, [*cuts[1:], len(key)]):
                held.setdefault((names[key[at] // 4], int(key[at] % 4)), Popcounts()).add(own[at:to])
            if len(held) > MOST_HELD:
                yield give()
        if held:
            yield give()

    return rows.mapInArrow(run, "part string, class int, counts array<bigint>")


def steps() -> list[dict]:
    """Every step of every order: the subset applied before it, the one after it, and the place of its filter."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            i = FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": k + 1, "before": before, "after": before | 1 << i, "own": i})
            before |= 1 << i
    return out


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the ``survivors`` of all tasks."""
    of = lambda name, chosen: F.array(*[F.sum(F.when(chosen, F.col("counts")[s]).otherwise(0)) for s in range(SUBSETS)]).alias(name)
    per = counts.groupBy("part").agg(of("n", F.lit(True)), of("good", F.col("class").bitwiseAND(1) > 0),
                                     of("toxic", F.col("class").bitwiseAND(2) > 0))
    every, last = SUBSETS - 1, len(FILTERS) - 1

    def all_orders(i):
        """Rows removed by filter i, summed over all orders: each subset of the others comes first in so many of them."""
        others = [s for s in range(SUBSETS) if not s >> i & 1]
        weight = lambda s: factorial(s.bit_count()) * factorial(last - s.bit_count())
        return sum((F.col("n")[s] - F.col("n")[s | 1 << i]) * weight(s) for s in others)

    per = per.withColumn("shapleys", F.array(*map(all_orders, range(len(FILTERS)))))
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,before:int,after:int,own:int>>")
    rows = per.select("*", F.inline(table))
    n, at = (lambda s, c="n": F.element_at(c, s + 1)), F.col
    bit = F.call_function("shiftleft", F.lit(1), at("own"))
    removed = n(at("before")) - n(at("after"))
    lost = lambda c: (n(at("before"), c) - n(at("after"), c)).alias(f"{c}_lost")
    return rows.select("part", "filter_order", "step", n(at("after")).alias("kept"), removed.alias("removed"),
                       (n(F.lit(0)) - n(bit) - removed).alias("redundant"),
                       (n(F.lit(every) - bit) - n(F.lit(every))).alias("unique_fails"), lost("good"), lost("toxic"),
                       n(at("own"), "shapleys").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = with_labels(with_duplicates(written(marked(docs))), labels)
    return report(survivors(rows))


SQL = r"""
WITH RECURSIVE o(filter_order) AS (SELECT '' UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(filter_order, x) = 0),
s AS (SELECT filter_order, CAST(k AS INT) AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before
  FROM o, range(1, 6) r(k) WHERE length(filter_order) = 5),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
e AS (SELECT c.*, s.*, strpos(failed, own) > 0 AS fails, regexp_matches(before, '[' || failed || '-]') AS earlier FROM c, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT earlier AND NOT fails), 0) AS kept,
  coalesce(sum(n) FILTER (NOT earlier AND fails), 0) AS removed, coalesce(sum(n) FILTER (earlier AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT earlier AND fails AND good), 0) AS good_lost,
  coalesce(sum(n) FILTER (NOT earlier AND fails AND toxic), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
