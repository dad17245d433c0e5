"""Hard-negative mining: Strassen products of int64 tiles, then mergeable heaps of positives and of windows of negatives.

Vectors become integers, floor(256 x) per component. Anchors are a stated share of the rows (ids divisible by ``EVERY``), each against
all rows, in blocks: a cell holds at most about ``ANCHORS`` anchors and ``CANDIDATES`` candidates, and inside it tiles of scores are
products of int64 matrices by Strassen's recursion: operands are padded with zeros to even sides at every level, quadrants are added as
exact integers, seven products replace eight, and small leaves are multiplied directly.

Pass one keeps, per anchor, a heap of its best rows of the same label; heaps of tiles, cells and tasks merge (the best of the
union of the bests are the best of all). Pass two computes the tiles again, now with the scores of the positives known, and keeps
per anchor and positive a heap of the best rows of another label inside the window 30 * positive <= 100 * score <= 90 * positive.
No task holds more than a cell, and no row leaves a cell that is not among the best of it.

Exactness: integer arithmetic throughout; leaves use floating-point products only where every partial sum is below 2^53, where these
are exact, and int64 elsewhere. Scores must stay below 2^63 / 100.

Edge cases: rows with a null label, a null vector, or a null, NaN or infinite component take no part, nor do rows with a
null vec_id; rows that repeat vec_id, label and vector count once; rows that repeat a vec_id with something else are rows of their own,
but never partners of an anchor with the same id; shorter vectors are padded with zeros, empty ones score 0; ties go to the smaller
vec_id; very long vectors are cut into ``DEPTH`` components a time, whose products add up; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logwarden.session import written

EVERY, RELABEL, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows of a block, and components of all its vectors, at most about.
ANCHORS, CANDIDATES, BLOCK_VALUES = 2048, 8192, 1 << 22
TILE_ROWS, TILE_COLUMNS, DEPTH = 256, 2048, 1024
#: Sides at which Strassen's recursion ends.
LEAF = 32
EXACT = 1 << 53


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in exact integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices of any shape, by seven half-size products per level."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return leaf_product(a, b)
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * x, 2 * z), dtype=np.int64)
    out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def tile_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, ``DEPTH`` components a time."""
    total = np.zeros((len(anchors), len(candidates)), dtype=np.int64)
    for at in range(0, anchors.shape[1], DEPTH):
        total += strassen(anchors[:, at:at + DEPTH], np.ascontiguousarray(candidates[:, at:at + DEPTH].T))
    return total


def best(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The heap of these entries: the ``most`` highest scores, ties by the smaller id, in order."""
    if len(score) > 4 * most:
        floor = np.partition(score, len(score) - most)[len(score) - most]
        score, ids = score[score >= floor], ids[score >= floor]
    order = np.lexsort((ids, -score))[:most]
    return score[order], ids[order]


class Heaps:
    """One bounded heap per key; adding entries or another heap's entries is the same."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, key, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            if key in self.held:
                score, ids = (np.concatenate([x, y]) for x, y in zip(self.held[key], (score, ids)))
            self.held[key] = best(score, ids, self.most)


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, relabelled, with integer components."""
    x = lambda c: c.cast("double")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    return df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"),
        F.transform("embedding", lambda c: F.floor(x(c) * SCALE).cast("bigint")).alias("v")).distinct()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column as rows of one matrix, short rows filled up with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), lengths.max(initial=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def blocks(n: int, most: int, width: int) -> int:
    """Into how many blocks ``n`` vectors of at most ``width`` components are dealt."""
    return max(-(-n // most), -(-n * width // BLOCK_VALUES), 1)


def cells(anchors: DataFrame, rows: DataFrame, p: int, q: int) -> DataFrame:
    """Anchors and candidates dealt to cells (i, j): each of ``p`` blocks of anchors meets each of ``q`` blocks of candidates."""
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select(block(p).alias("i"), every(q).alias("j"), F.lit(True).alias("asks"), "anchor", "vec_id", "label", "v", "windows")
    held = rows.select(every(p).alias("i"), block(q).alias("j"), F.lit(False).alias("asks"), F.lit(0).cast("bigint").alias("anchor"), "vec_id",
                       "label", "v", F.array().cast("array<bigint>").alias("windows"))
    return asked.unionByName(held)


def mined(dealt: DataFrame, most: int, windows: bool) -> DataFrame:
    """(anchor, slot, score, id): the heaps of every cell, per anchor, or per anchor and window of negatives (slot)."""

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        v, label, ids = matrix(table.column("v")), table.column("label").to_numpy(), table.column("vec_id").to_numpy()
        a, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        known, name = table.column("windows").to_pylist() if windows else None, table.column("anchor").to_numpy()
        heaps = Heaps(most)
        for x in range(0, len(a), TILE_ROWS):
            for y in range(0, len(c), TILE_COLUMNS):
                rows, cols = a[x:x + TILE_ROWS], c[y:y + TILE_COLUMNS]
                scores = tile_scores(v[rows], v[cols])
                for r, line in zip(rows, scores):
                    if not windows:
                        fit = np.flatnonzero((label[cols] == label[r]) & (ids[cols] != ids[r]))
                        heaps.add((name[r], 0), *best(line[fit], ids[cols[fit]], most))
                        continue
                    other, at = label[cols] != label[r], ids[cols]
                    for slot, positive in enumerate(known[r]):
                        fit = np.flatnonzero(other & (100 * line >= LOW * positive) & (100 * line <= HIGH * positive))
                        heaps.add((name[r], slot), *best(line[fit], at[fit], most))
        keys = list(heaps.held)
        sizes = [len(heaps.held[k][0]) for k in keys]
        flat = lambda k: np.concatenate([np.zeros(0, dtype=np.int64), *(heaps.held[x][k] for x in keys)])
        of = lambda k: pa.array(np.repeat(np.array([x[k] for x in keys], dtype=np.int64), sizes))
        return pa.table({"anchor": of(0), "slot": of(1), "score": pa.array(flat(0)), "id": pa.array(flat(1))})

    found = dealt.groupBy("i", "j").applyInArrow(cell, "anchor bigint, slot bigint, score bigint, id bigint")
    # Heaps of cells merge: each side of the shuffle keeps the best only.
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def mine(df: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = written(vectors(df))
    # Each anchor row has a number of its own, as ids may repeat; 63 bits of a hash of the whole row.
    number = F.shiftrightunsigned(F.xxhash64("vec_id", "label", "v"), 1)
    anchors = written(rows.filter(F.col("vec_id") % EVERY == 0).withColumn("anchor", number))
    n_rows, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    p, q = blocks(anchors.count(), ANCHORS, width), blocks(n_rows, CANDIDATES, width)
    none = F.array().cast("array<bigint>").alias("windows")
    positives = written(mined(cells(anchors.select("*", none), rows, p, q), POSITIVES, False).select(
        "anchor", (F.col("rank") - 1).cast("bigint").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    windows = positives.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))),
                                                          lambda p: p["positive_score"]).alias("windows"))
    asked = anchors.join(windows, "anchor")
    negatives = mined(cells(asked, rows, p, q), NEGATIVES, True)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
