"""Isolation forest (M01-M06): sampling and tree building on executors, vectorized scoring in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from logwarden.operators.quantiles import quantiles
from logwarden.operators.stat import Baselines, add_up
from logwarden.session import written

EULER = 0.5772156649015329
AUTO_SAMPLE = 256
AUTO_OFFSET = -0.5
HASH_RANGE = 2**63


def average_path(n):
    """Mean path length of an unsuccessful search in a tree of n points (Liu, Ting, Zhou 2008)."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


SCORE_ROWS = 2048
#: Leaves per mask word (its lowest bit stays free), mask words a row may cost per tree, bytes of one block's masks, words at work.
WORD_LEAVES, MOST_WORDS, BLOCK_BYTES, WORK_WORDS = 63, 64, 1 << 20, 16_384
#: De Bruijn sequence: times a power of two, its top six bits tell the exponent.
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)


@dataclass
class Forest:
    """A fitted forest: flat node arrays of at most trees x 2 x sample entries, small enough to ship.

    Children are neighbours, so a step goes to ``below`` or the node after it. A leaf points at itself and
    its cut is infinite, so every row can take the same number of steps.
    """

    columns: list[str]
    sample: int
    roots: np.ndarray
    split: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    path: np.ndarray
    steps: int
    offset: float = AUTO_OFFSET
    nodes: pd.DataFrame = field(default=None, repr=False)
    rows: int = 0
    #: Key and depth score of the training rows, when a contamination share asked for them.
    trained: DataFrame = field(default=None, repr=False)

    def depth_scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-E[h] / c) for each row of x."""
        return Scorer([self]).depth_scores(x)[:, 0]

    def scaled(self, paths: np.ndarray) -> np.ndarray:
        return np.power(2.0, -paths / max(float(average_path(self.sample)), 1e-12))

    def walked(self, x: np.ndarray) -> np.ndarray:
        """Mean path of each row of x, node by node."""
        out = np.empty(len(x))
        for start in range(0, len(x), SCORE_ROWS):
            part = np.ascontiguousarray(x[start:start + SCORE_ROWS])
            base = (np.arange(len(part)) * part.shape[1])[:, None]
            flat = part.ravel()
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.steps):
                high = flat.take(base + self.split.take(at)) >= self.cut.take(at)
                at = self.below.take(at) + high
            out[start:start + len(part)] = self.path.take(at).mean(axis=1)
        return out

    def boxes(self) -> tuple[np.ndarray, ...]:
        """(tree, number within its tree, path, low, high) of every leaf: the values between two cuts of each feature end there."""
        low = np.full((len(self.split), len(self.columns)), -np.inf)
        high = np.full(low.shape, np.inf)
        at, leaves = self.roots.astype(np.int64), []
        while len(at):
            inner = self.below[at] != at
            leaves.append(at[~inner])
            at = at[inner]
            below, f, cut = self.below[at].astype(np.int64), self.split[at], self.cut[at]
            for child in (below, below + 1):
                low[child], high[child] = low[at], high[at]
            high[below, f], low[below + 1, f] = cut, cut
            at = np.concatenate([below, below + 1])
        leaf = np.sort(np.concatenate(leaves))
        tree = np.searchsorted(self.roots, leaf, side="right") - 1
        return tree, np.arange(len(leaf)) - np.searchsorted(tree, tree), self.path[leaf], low[leaf], high[leaf]


class Scorer:
    """Depth scores of several forests over the same columns.

    A value's place among all cuts of its feature tells which leaves of a tree it can reach, as a mask of bits; the masks of
    all features have one leaf in common. So a row costs a few words per tree and feature instead of a step per level.
    Trees share masks in blocks of bounded size; forests whose trees have too many leaves for that are walked.
    """

    def __init__(self, forests: list[Forest]):
        self.forests, self.blocks, boxed = forests, [], {}
        for i, f in enumerate(forests):
            splits = np.bincount(np.searchsorted(f.roots, np.flatnonzero(np.isfinite(f.cut)), side="right"), minlength=1)
            if -(-(int(splits.max()) + 1) // WORD_LEAVES) * len(f.columns) <= MOST_WORDS:
                boxed[i] = f.boxes()
        self.walked = [i for i in range(len(forests)) if i not in boxed]
        cuts = lambda low, f: np.unique(low[np.isfinite(low[:, f]), f])
        # Every cut is the lower end of some leaf's box.
        self.cuts = [np.unique(np.concatenate([cuts(b[3], f) for b in boxed.values()])) for f in range(len(forests[0].columns))] if boxed else []
        for i, (tree, number, path, low, high) in boxed.items():
            trees, most = len(forests[i].roots), -(-(int(number.max()) + 1) // WORD_LEAVES)
            inner = max(1, len(tree) // trees)
            size = max(1, min(trees, int((BLOCK_BYTES / (8 * most * inner)) ** 0.5)))
            for first in range(0, trees, size):
                mine = (tree >= first) & (tree < first + size)
                width = min(size, trees - first)
                words = -(-(int(number[mine].max()) + 1) // WORD_LEAVES)
                word = number[mine] // WORD_LEAVES
                column = word * width + tree[mine] - first
                bit = 1 + number[mine] % WORD_LEAVES
                paths = np.zeros((words * width, 64))
                # The place that the sequence gives to a mask with this bit alone; an empty mask gets place 0, where the path is 0.
                paths[column, (DE_BRUIJN << bit.astype(np.uint64)) >> np.uint64(58)] = path[mine]
                masks = []
                for f, known in enumerate(self.cuts):
                    own = cuts(low[mine], f)
                    if not len(own):
                        continue
                    # A leaf's bit is turned on where its box begins and off where it ends.
                    mask = np.zeros((len(own) + 2, words * width), np.uint64)
                    one = np.uint64(1) << bit.astype(np.uint64)
                    begin = np.searchsorted(own, low[mine][:, f], side="right")
                    end = np.where(np.isinf(high[mine][:, f]), len(own) + 1, np.searchsorted(own, high[mine][:, f], side="right"))
                    np.bitwise_xor.at(mask, (begin, column), one)
                    np.bitwise_xor.at(mask, (end, column), one)
                    place = np.concatenate([[0], np.searchsorted(own, known, side="right")])
                    masks.append((f, place, np.bitwise_xor.accumulate(mask, axis=0)))
                self.blocks.append((i, first, width, words, masks, paths.ravel()))

    def depth_scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-E[h] / c) for each row of x and forest."""
        out = np.empty((len(x), len(self.forests)))
        for i in self.walked:
            out[:, i] = self.forests[i].walked(x)
        places = [np.searchsorted(known, x[:, f], side="right") for f, known in enumerate(self.cuts)]
        found = {}
        for i, first, width, words, masks, paths in self.blocks:
            if not first:
                found = np.empty((len(x), len(self.forests[i].roots)))
            columns = words * width
            own = [(place.take(places[f]), mask) for f, place, mask in masks]
            base = (np.arange(columns, dtype=np.uint64) * np.uint64(64))[None, :]
            step = max(16, WORK_WORDS // columns)
            both, more, depth = np.empty((step, columns), np.uint64), np.empty((step, columns), np.uint64), np.empty((step, columns))
            for start in range(0, len(x), step):
                n = min(step, len(x) - start)
                at, other, h = both[:n], more[:n], depth[:n]
                if own:
                    own[0][1].take(own[0][0][start:start + n], axis=0, out=at, mode="clip")
                else:
                    at[:] = np.uint64(2)
                for place, mask in own[1:]:
                    mask.take(place[start:start + n], axis=0, out=other, mode="clip")
                    np.bitwise_and(at, other, out=at)
                np.multiply(at, DE_BRUIJN, out=at)
                np.right_shift(at, np.uint64(58), out=at)
                np.add(at, base, out=at)
                paths.take(at.view(np.int64), out=h, mode="clip")
                total = found[start:start + n, first:first + width]
                # All words of a tree but one add 0.
                np.add(h[:, :width], h[:, width:2 * width] if words > 1 else 0.0, out=total)
                for w in range(2, words):
                    np.add(total, h[:, w * width:(w + 1) * width], out=total)
            if first + width == found.shape[1]:
                out[:, i] = found.mean(axis=1)
        for i, f in enumerate(self.forests):
            out[:, i] = f.scaled(out[:, i])
        return out


NODE_SCHEMA = ("config int, tree int, node int, split int, cut double, left_node int, right_node int, size int, depth int")


def grow(x: np.ndarray, rng: np.random.Generator, limit: int, features: np.ndarray) -> list[tuple]:
    """Nodes (node, split, cut, left, right, size, depth) of one random tree; a leaf has split -1."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = features[low[features] < high[features]] if depth < limit and len(rows) > 1 else []
        if not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        if cut <= low[f]:
            cut = float(np.nextafter(low[f], high[f]))
        below = part[:, f] < cut
        nodes.append((node, f, cut, used, used + 1, len(rows), depth))
        todo += [(used, rows[below], depth + 1), (used + 1, rows[~below], depth + 1)]
        used += 2
    return nodes


POOL = 131_072


def tree_samples(df: DataFrame, columns: list[str], key: list[str], trees: int, sample: int, rows: int, seed: int
                 ) -> DataFrame:
    """(tree, place, columns): the ``sample`` rows with the smallest hash per tree; ``key`` must be unique.

    A first hash of the key draws a pool of about ``POOL`` rows, or eight samples if that is more (all rows of a smaller table);
    then every tree hashes the pool anew. So one scheme serves all sizes, and a few more rows change only a few members of the
    pool. About 4 x sample rows per tree reach the shuffle.
    """
    most = max(POOL, 8 * sample)
    hashed = lambda *salt: F.xxhash64(*salt, *key).bitwiseAND(HASH_RANGE - 1) / float(HASH_RANGE)
    base = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *key)
    pool = base.filter(hashed(F.lit(seed)) < min(1.0, most / rows))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    share = 4.0 * sample / min(rows, most)
    drawn = drawn.withColumn("_h", hashed(F.lit(seed + 1), F.col("tree"))).filter(F.col("_h") < min(share, 1.0))
    w = Window.partitionBy("tree").orderBy("_h", *key)
    placed = drawn.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= sample)
    return placed.select("tree", "place", *[f"x{i}" for i in range(len(columns))])


def _build(samples: DataFrame, configs: list[dict], width: int, seed: int) -> pd.DataFrame:
    """Node table of all configurations; every group holds at most ``sample`` rows."""
    wanted = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(c["trees"]).alias("t"), F.lit(c["sample"]).alias("s"))
                       for i, c in enumerate(configs)])
    grid = samples.withColumn("_g", F.explode(wanted)).filter("tree < _g.t and place <= _g.s")
    grid = grid.withColumn("config", F.col("_g.config")).drop("_g")
    names = [f"x{i}" for i in range(width)]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        config, tree = int(pdf["config"].iloc[0]), int(pdf["tree"].iloc[0])
        c = configs[config]
        rng = np.random.default_rng([seed, config, tree])
        count = max(1, int(round(c.get("max_features", 1.0) * width)))
        features = np.sort(rng.choice(width, count, replace=False))
        x = np.nan_to_num(pdf.sort_values("place")[names].to_numpy(dtype=float))
        rows = grow(x, rng, max(1, math.ceil(math.log2(max(c["sample"], 2)))), features)
        out = pd.DataFrame(rows, columns=["node", "split", "cut", "left_node", "right_node", "size", "depth"])
        out.insert(0, "tree", tree)
        out.insert(0, "config", config)
        return out

    # Bounded by configurations x trees x 2 x sample, not by the data.
    return grid.groupBy("config", "tree").applyInPandas(one, NODE_SCHEMA).toPandas()


def _assemble(nodes: pd.DataFrame, columns: list[str], sample: int) -> Forest:
    trees = np.sort(nodes["tree"].unique())
    width = int(nodes["node"].max()) + 1
    place = np.searchsorted(trees, nodes["tree"]) * width + nodes["node"].to_numpy()
    leaf = nodes["split"].to_numpy() < 0
    n = len(trees) * width
    split, below, cut, path = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.full(n, np.inf), np.zeros(n)
    split[place] = np.where(leaf, 0, nodes["split"])
    below[place] = np.where(leaf, place, place - nodes["node"].to_numpy() + nodes["left_node"].to_numpy())
    cut[place] = np.where(leaf, np.inf, nodes["cut"])
    path[place] = nodes["depth"] + average_path(nodes["size"])
    roots = (np.arange(len(trees)) * width).astype(np.int32)
    return Forest(columns, sample, roots, split, cut, below, path, int(nodes["depth"].max()), nodes=nodes)


def fit_iforest(df: DataFrame, columns: list[str], key: list[str], *, trees: int = 100, sample: int | str = "auto",
                contamination: float | str = "auto", max_features: float = 1.0, seed: int = 42) -> Forest:
    """A forest of ``trees`` trees; with a contamination share, the offset is that quantile of the training scores."""
    rows = df.count()
    if not rows:
        raise ValueError("cannot fit on an empty table")
    size = min(AUTO_SAMPLE if sample == "auto" else int(sample), rows)
    samples = tree_samples(df, columns, key, trees, size, rows, seed)
    nodes = _build(samples, [{"trees": trees, "sample": size, "max_features": max_features}], len(columns), seed)
    forest = _assemble(nodes, columns, size)
    forest.rows = rows
    if contamination != "auto":
        forest.trained = written(spread_small(df.select(*key, *columns), rows).select(*key, (-raw_score(forest)).alias("_s")))
        forest.offset = quantiles(forest.trained, ["_s"], [float(contamination)], rows=rows)["_s"][0]
    return forest


def training_scores(forest: Forest, name: str = "forest_score") -> DataFrame:
    """M02 for the rows that a forest with a contamination share was fitted on: their scores exist already."""
    return forest.trained.withColumn(name, (F.lit(1.0) - F.col("_s") + F.lit(forest.offset)) / 2).drop("_s")


SMALL_ROWS = 10_000_000


def spread_small(df: DataFrame, rows: int) -> DataFrame:
    """A small table may sit in one file, hence one task; share it between the cores before Python work.

    A large table already has a task per file split and is left alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SMALL_ROWS else df


def raw_score(forest: Forest) -> Column:
    """Depth score s in (0, 1] as an Arrow function over the feature columns."""
    shipped = replace(forest, nodes=None, trained=None)

    @F.pandas_udf(T.DoubleType())
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        scorer = Scorer([shipped])
        for frame in frames:
            yield pd.Series(scorer.depth_scores(np.nan_to_num(frame.to_numpy(dtype=float)))[:, 0])

    return run(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(forest.columns)]))


def score_iforest(df: DataFrame, forest: Forest, name: str = "forest_score") -> DataFrame:
    """(1 - decision) / 2 with decision = -s - offset; higher is more anomalous."""
    return df.withColumn(name, (F.lit(1.0) + raw_score(forest) + F.lit(forest.offset)) / 2)


def predict_labels(df: DataFrame, threshold: float, score: str = "forest_score", name: str = "label") -> DataFrame:
    """M03."""
    return df.withColumn(name, F.when(F.col(score) >= threshold, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def split_importance(spark, forest: Forest) -> DataFrame:
    """Share of the split nodes per feature and whether it passes the selection limit."""
    inner = forest.nodes[forest.nodes["split"] >= 0]
    counts = inner.groupby("split").size()
    rows = [(c, float(counts.get(i, 0)) / max(len(inner), 1)) for i, c in enumerate(forest.columns)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.withColumn("selected", F.col("importance") > 0.01)


def explain_iforest(df: DataFrame, params: Baselines, name: str = "explanation") -> DataFrame:
    """Map feature -> share of the absolute standardized value."""
    parts = [F.abs((F.col(b.feature) - F.lit(b.mean)) / F.lit(b.std)) for b in params.values()]
    total = add_up(parts)
    shares = [F.when(total > 0, p / total).otherwise(F.lit(0.0)) for p in parts]
    return df.withColumn(name, F.map_from_arrays(F.array(*[F.lit(f) for f in params]), F.array(*shares)))


def tune_iforest(df: DataFrame, columns: list[str], key: list[str], grid: list[dict], *, label: str | None = None,
                 seed: int = 42) -> DataFrame:
    """Every configuration with its F1 at 0.5 (with labels) or its negated mean score, best first.

    One sampling pass and one scoring pass serve the whole grid; a configuration uses the first trees and
    the first sample rows of the shared draw.
    """
    rows = df.count()
    configs = [{"trees": g.get("n_estimators", 100),
                "sample": min(AUTO_SAMPLE if g.get("max_samples", "auto") == "auto" else g["max_samples"], rows),
                "max_features": g.get("max_features", 1.0)} for g in grid]
    most_trees, most_rows = max(c["trees"] for c in configs), max(c["sample"] for c in configs)
    samples = written(tree_samples(df, columns, key, most_trees, most_rows, rows, seed))
    nodes = _build(samples, configs, len(columns), seed)
    forests = [replace(_assemble(nodes[nodes["config"] == i], columns, c["sample"]), nodes=None)
               for i, c in enumerate(configs)]

    names = [f"s{i}" for i in range(len(grid))]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def all_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(forests)
        for frame in frames:
            yield pd.DataFrame(scorer.depth_scores(np.nan_to_num(frame.to_numpy(dtype=float))), columns=names)

    scored = written(spread_small(df.select(*columns, *([label] if label else [])), rows).select(all_scores(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
                               .alias("s"), *([F.col(label).alias("y")] if label else [])))
    shares = [g.get("contamination", "auto") for g in grid]
    wide = scored.select("s.*")
    fixed = sorted({(i, c) for i, c in enumerate(shares) if c != "auto"})
    offsets = {i: AUTO_OFFSET for i in range(len(grid))}
    for share in sorted({c for _, c in fixed}):
        cols = [f"s{i}" for i, c in fixed if c == share]
        for c, q in quantiles(wide, cols, [1 - share], rows=rows).items():
            offsets[int(c[1:])] = -q[0]
    aggs = []
    for i in range(len(grid)):
        score = (F.lit(1.0) + F.col(f"s.s{i}") + F.lit(offsets[i])) / 2
        if label:
            hit, good = score >= 0.5, F.col("y") == 1
            tp, fp, fn = F.count_if(hit & good), F.count_if(hit & ~good), F.count_if(~hit & good)
            aggs.append(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias(f"m{i}"))
        else:
            aggs.append((-F.avg(score)).alias(f"m{i}"))
    result = scored.agg(*aggs).first()
    out = [(i, g.get("n_estimators", 100), str(g.get("max_samples", "auto")), str(g.get("contamination", "auto")),
            float(g.get("max_features", 1.0)), float(result[f"m{i}"])) for i, g in enumerate(grid)]
    schema = "config int, n_estimators int, max_samples string, contamination string, max_features double, metric double"
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: (-r[5], r[0])), schema)
