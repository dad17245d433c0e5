"""Combining detectors, cross-validation and the detection step."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.evaluate import hash_bucket, ratio
from logwarden.operators.ordered import arrange
from logwarden.operators.stat import FLOOR, add_up
from logwarden.session import written


def kfold(df: DataFrame, columns: list[str], key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Mean z-score of each held-out fold under the baseline of the other folds.

    One pass gives each fold's count, mean and centred square sum (k rows); those of the other folds are merged, so large
    values with a small spread keep their digits.
    """
    folded = df.withColumn("_fold", hash_bucket(key, k, seed))
    parts = folded.groupBy("_fold").agg(
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), (F.var_pop(c) * F.count(c)).alias("q")).alias(f"p{i}")
          for i, c in enumerate(columns)]).collect()

    def merged(fold, i: int) -> tuple[float, float]:
        n, mean, square = 0, 0.0, 0.0
        for r in parts:
            p = r[f"p{i}"]
            if r["_fold"] != fold and p["n"]:
                gap, both = p["m"] - mean, n + p["n"]
                square += p["q"] + gap * gap * n * p["n"] / both
                mean, n = mean + gap * p["n"] / both, both
        return mean, max((square / n) ** 0.5 if n else 0.0, FLOOR)

    score = F
    for r in parts:
        z = []
        for i, c in enumerate(columns):
            mean, std = merged(r["_fold"], i)
            z.append(F.abs((F.col(c) - F.lit(mean)) / F.lit(std)))
        score = score.when(F.col("_fold") == r["_fold"], add_up(z) / len(z))
    return folded.groupBy(F.col("_fold").alias("fold")).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def cross_validate(df: DataFrame, key: list[str], fit: Callable, score: Callable, k: int = 5, seed: int = 42) -> DataFrame:
    """M11 for any model: (fold, mean_score, std_score, n) of every held-out fold.

    ``fit(train) -> model`` sees the other folds, ``score(held_out, model) -> Column`` gives the fold's scores.
    """
    folded = df.withColumn("_fold", hash_bucket(key, k, seed))
    out = None
    for fold in range(k):
        held = folded.filter(F.col("_fold") == fold)
        model = fit(folded.filter(F.col("_fold") != fold).drop("_fold"))
        s = score(held, model)
        one = held.agg(F.lit(fold).cast("bigint").alias("fold"), F.avg(s).alias("mean_score"), F.stddev_pop(s).alias("std_score"),
                       F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def top_anomalies(df: DataFrame, score: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` highest scores (ties by id); each task keeps n rows."""
    return df.orderBy(F.desc(score), *order).limit(n)


def combine(models: list[str], method: str = "average", weights: dict[str, float] | None = None,
            thresholds: dict[str, float] | None = None) -> Column:
    """One score from several; an unknown method is the plain mean."""
    cols = [F.col(m) for m in models]
    if method in ("average", "weighted_average"):
        w = {m: (weights or {}).get(m, 1.0) for m in models}
        total = sum(w.values())
        whole = add_up([F.col(m) * F.lit(float(x)) for m, x in w.items()])
        return whole / total if total > 0 else whole
    if method == "maximum":
        return F.greatest(*cols) if len(cols) > 1 else cols[0]
    if method == "minimum":
        return F.least(*cols) if len(cols) > 1 else cols[0]
    if method == "median":
        ordered, n = F.array_sort(F.array(*cols)), len(cols)
        return (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    if method == "majority_vote":
        return add_up([(F.col(m) >= (thresholds or {}).get(m, 0.5)).cast("double") for m in models]) / len(models)
    return add_up(cols) / len(cols)


def f1_weights(df: DataFrame, models: list[str], label: str = "label", thresholds: dict[str, float] | None = None
               ) -> DataFrame:
    """F1 per model and its share of the sum; all models in one aggregation."""
    y, cells = F.col(label) == 1, []
    for m in models:
        hit = F.col(m) >= (thresholds or {}).get(m, 0.5)
        tp, fp, fn = F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        cells.append(ratio(2 * precision * recall, precision + recall).alias(m))
    row = df.agg(*cells)
    total = add_up([F.col(m) for m in models]) + 1e-10
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("f1"), (F.col(m) / total).alias("weight")) for m in models])))


def simplex(n: int, step: float) -> list[tuple[float, ...]]:
    """Weight vectors on the unit simplex in steps, in ascending order."""
    parts = round(1 / step)
    out = []
    # n - 1 bars among the parts: what lies between two bars is one model's share.
    for bars in itertools.combinations(range(parts + n - 1), n - 1):
        edges = (-1, *bars, parts + n - 1)
        out.append(tuple((b - a - 1) / parts for a, b in zip(edges, edges[1:])))
    return out


def optimize_weights(df: DataFrame, models: list[str], label: str = "label", step: float = 0.1, threshold: float = 0.5
                     ) -> DataFrame:
    """The weight vector with the best F1 on a simplex grid (first on ties).

    Each row meets the literal list of vectors; the counts per vector are combined inside each task, so the
    shuffle holds one row per vector and task.
    """
    grid = simplex(len(models), step)
    hits = []
    for i, w in enumerate(grid):
        hits.append(F.when(add_up([F.col(m) * F.lit(x) for m, x in zip(models, w)]) >= threshold, F.lit(i)))
    y = F.col(label) == 1
    reached = df.select(y.alias("y"), F.explode(F.array_compact(F.array(*hits))).alias("i"))
    counts = reached.groupBy("i").agg(F.count_if("y").alias("tp"), F.count_if(~F.col("y")).alias("fp"))
    positives = df.agg(F.count_if(y)).scalar()
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + positives)
    vectors = F.array(*[F.array(*[F.lit(x) for x in w]) for w in grid])
    best = counts.withColumn("f1", f1).orderBy(F.desc("f1"), "i").limit(1)
    return best.select(*[F.get(F.get(vectors, F.col("i")), F.lit(j)).alias(m) for j, m in enumerate(models)], "f1")


def sweep_line(df: DataFrame, models: list[str], weights: list[float], up: int, down: int, label: str, threshold: float, **how
               ) -> tuple[float, list[float]]:
    """Best F1 on the line that moves weight from model ``down`` to model ``up``, and the weights there.

    On this line a row's score changes steadily, so its verdict flips at one place. Rows are counted per place of flipping,
    and the running counts over the ordered places give the F1 at every place: one pass, one ordered scan, whatever the number of
    weights between.
    """
    total = weights[up] + weights[down]
    fixed = add_up([F.col(m) * F.lit(float(w)) for k, (m, w) in enumerate(zip(models, weights)) if k not in (up, down)] or [F.lit(0.0)])
    # Score at share t of the two models' weight for ``up``: begin + t * rise.
    begin, rise = fixed + F.col(models[down]) * total, (F.col(models[up]) - F.col(models[down])) * total
    y, at = (F.col(label) == 1).cast("bigint"), F.when(rise != 0, (F.lit(threshold) - begin) / rise)
    rising, now = rise > 0, begin >= threshold
    # Rising rows count from their place on, falling ones until it; what flips outside 0..1 never flips.
    place = F.when(at.isNull() | (at > 1) & rising | (at < 0) & ~rising | (at <= 0) & rising | (at >= 1) & ~rising, F.lit(0.0)).otherwise(at)
    step = F.when(at.isNull(), now.cast("int")).when(rising, (at <= 1).cast("int")).otherwise(
        F.when(at < 0, 0).when(at >= 1, 1).otherwise(-1))
    flips = df.select(place.alias("t"), step.alias("step"), y.alias("y"))
    # A falling row counts at its place still, and no longer behind it.
    cells = flips.filter("step <> 0").groupBy("t", (F.col("step") < 0).cast("int").alias("behind")).agg(
        F.sum(F.col("step") * F.col("y")).alias("pos"), F.sum(F.col("step") * (1 - F.col("y"))).alias("neg"))
    falling = flips.filter("step < 0").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("n"))
    # The left end of the line is a place as well.
    end = df.sparkSession.createDataFrame([(0.0, 0, 0, 0)], "t double, behind int, pos bigint, neg bigint")
    cells = written(cells.unionByName(end).groupBy("t", "behind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    base = falling.first()
    positives = df.agg(F.count_if(F.col(label) == 1)).first()[0]
    o = arrange(cells, [], ["t", "behind"], **{"rows": cells.count(), **how}).running(tp=("sum", F.col("pos")), fp=("sum", F.col("neg")))
    curve = o.done().withColumns({"tp": F.col("tp") + base["p"], "fp": F.col("fp") + base["n"]})
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + positives)
    best = curve.agg(F.max_by(F.struct(f1.alias("f1"), "t", "behind"), F.struct(f1, -F.col("t"), -F.col("behind"))).alias("b")).first()["b"]
    t = best["t"]
    if best["behind"]:
        # Between this place and the next one.
        after = cells.filter(F.col("t") > t).agg(F.min("t")).first()[0]
        t = (t + (1.0 if after is None else after)) / 2
    moved = list(weights)
    moved[up], moved[down] = total * t, total * (1 - t)
    return best["f1"], moved


def f1_of(df: DataFrame, models: list[str], weights: list[list[float]], label: str, threshold: float) -> list[float]:
    """F1 of each weight vector, in one pass."""
    y, cells = F.col(label) == 1, []
    for k, w in enumerate(weights):
        hit = add_up([F.col(m) * F.lit(float(x)) for m, x in zip(models, w)]) >= threshold
        cells.append(ratio(2 * F.count_if(hit & y), F.count_if(hit) + F.count_if(y)).alias(f"f{k}"))
    return list(df.agg(*cells).first())


def sweep_weights(df: DataFrame, models: list[str], label: str = "label", threshold: float = 0.5, start: list[float] | None = None,
                  rounds: int = 3, **how) -> DataFrame:
    """M15 beyond a grid: from a start, the exact best F1 on each line between two models, until no line gets better.

    The start is the best of single models, pairs in equal parts, and the plain mean, or ``start`` (say, the best of a grid: the
    result is never below it). A round reads the rows once per pair of models; its work does not grow with a number of vectors.
    """
    n = len(models)
    unit = lambda *on: [1.0 / len(on) if k in on else 0.0 for k in range(n)]
    starts = [start] if start else [unit(k) for k in range(n)] + [unit(a, b) for a, b in itertools.combinations(range(n), 2)] + [unit(*range(n))]
    found = f1_of(df, models, starts, label, threshold)
    best, weights = max(zip(found, starts), key=lambda x: x[0])
    for _ in range(rounds):
        before = best
        for up, down in itertools.combinations(range(n), 2):
            if weights[up] + weights[down] == 0:
                continue
            _, moved = sweep_line(df, models, weights, up, down, label, threshold, **how)
            # What the line promises is measured: a row exactly at the threshold may round either way.
            (f1,) = f1_of(df, models, [moved], label, threshold)
            if f1 > best:
                best, weights = f1, moved
        if best == before:
            break
    return df.sparkSession.createDataFrame([(*weights, best)], ", ".join(f"`{m}` double" for m in models) + ", f1 double")


def explain_ensemble(explanations: dict[str, str], features: list[str], weights: dict[str, float] | None = None) -> Column:
    """Map feature -> weighted importance averaged over the models that explain it, normalized to sum 1."""
    parts = []
    for f in features:
        values = [F.try_element_at(c, F.lit(f)) for c in explanations.values()]
        weighted = add_up([F.coalesce(v * F.lit(float((weights or {}).get(m, 1.0))), F.lit(0.0))
                           for m, v in zip(explanations, values)])
        known = add_up([v.isNotNull().cast("int") for v in values])
        parts.append(F.coalesce(F.try_divide(weighted, known), F.lit(0.0)))
    total = add_up(parts)
    shares = [F.when(total != 0, p / total).otherwise(p) for p in parts]
    return F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*shares))


def contributions(df: DataFrame, models: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The combined score beside every model score."""
    return df.withColumn("combined", combine(models, "weighted_average", weights))


def pair_names(models: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(models, 2))


def row_std(models: list[str]) -> Column:
    """Population standard deviation across the models of one row."""
    mean = add_up([F.col(m) for m in models]) / len(models)
    return F.sqrt(add_up([F.pow(F.col(m) - mean, 2) for m in models]) / len(models))


def disagreement(df: DataFrame, models: list[str]) -> DataFrame:
    """Correlation of each pair, their mean and the mean row deviation, in one aggregation."""
    pairs = pair_names(models)
    row = df.agg(F.avg(row_std(models)).alias("mean_disagreement"),
                 *[F.corr(a, b).alias(f"{a}_vs_{b}") for a, b in pairs])
    mean = add_up([F.col(f"{a}_vs_{b}") for a, b in pairs]) / len(pairs)
    return row.withColumn("mean_correlation", mean)


def topk_jaccard(df: DataFrame, models: list[str], key: list[str], k: int = 10) -> DataFrame:
    """Jaccard similarity of each pair's top-k sets; only k rows per model leave the scan."""
    tops = [df.orderBy(F.desc(m), *key).limit(k).select(*key, F.lit(m).alias("model")) for m in models]
    stacked = tops[0]
    for t in tops[1:]:
        stacked = stacked.unionByName(t)
    member = stacked.groupBy(*key).agg(*[F.bool_or(F.col("model") == m).alias(m) for m in models])
    cells = []
    for a, b in pair_names(models):
        both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
        cells.append(F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), ratio(both, either).alias("jaccard")).alias(f"{a}_{b}"))
    row = member.agg(*cells)
    return row.select(F.inline(F.array(*[f"{a}_{b}" for a, b in pair_names(models)])))


def importance_summary(df: DataFrame, explanation: str = "explanation") -> DataFrame:
    """Importance summed over the rows per feature, normalized."""
    long = df.select(F.explode(explanation).alias("feature", "share"))
    sums = long.groupBy("feature").agg(F.sum("share").alias("importance"))
    total = long.agg(F.sum("share")).scalar()
    return sums.withColumn("importance", F.col("importance") / total)


def detect(df: DataFrame, scores: list[str], *, weights: dict[str, float] | None = None, threshold: float = 0.7,
           explanations: dict[str, str] | None = None) -> DataFrame:
    """Rows whose weighted mean score exceeds the threshold, with the strongest model, its plain score and explanation.

    Related events and the reported-before filter follow as ``joins.related_events`` and ``joins.new_only``.
    """
    w = {m: float((weights or {}).get(m, 1.0)) for m in scores}
    best = F.array_max(F.array(*[F.struct((F.col(m) * w[m]).alias("weighted"), F.lit(-i).alias("first"), F.lit(m).alias("model"),
                                          F.col(m).alias("plain")) for i, m in enumerate(scores)]))
    out = df.withColumn("anomaly_score", combine(scores, "weighted_average", w)).filter(F.col("anomaly_score") > threshold)
    out = out.withColumn("_best", best).withColumns({"detection_method": F.col("_best.model"), "confidence": F.col("_best.plain")})
    if explanations:
        why = F
        for m, c in explanations.items():
            why = why.when(F.col("detection_method") == m, F.col(c))
        out = out.withColumn("explanation", why)
    return out.drop("_best")


def version_parts(version: str = "version") -> Column:
    """Version text as numbers, so that 1.10.0 follows 1.2.0."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def latest_models(models: DataFrame) -> DataFrame:
    """Newest version and number of versions per model."""
    return models.groupBy("model_id", "model_type").agg(
        F.max_by("version", version_parts()).alias("latest"), F.count_distinct("version").alias("versions"))


def diff_models(a: DataFrame, b: DataFrame, key: str = "stat", value: str = "value") -> DataFrame:
    """Stats that differ between two models, either side possibly missing."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).withColumn("delta", F.col("b") - F.col("a"))


def top_comparison(df: DataFrame, models: list[str], order: list[str], n: int = 20, weights: dict[str, float] | None = None
                   ) -> DataFrame:
    """The ``n`` highest combined scores with every model's score, one row per model."""
    top = top_anomalies(contributions(df, models, weights), "combined", order, n)
    return top.unpivot([*order, "combined"], models, "model", "score")
