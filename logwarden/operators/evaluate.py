"""Evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.ordered import arrange
from logwarden.operators.quantiles import quantiles
from logwarden.session import written


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
    }


def confusion_counts(hit: Column, positive: Column) -> dict[str, Column]:
    return {"tp": F.count_if(hit & positive), "fp": F.count_if(hit & ~positive),
            "tn": F.count_if(~hit & ~positive), "fn": F.count_if(~hit & positive)}


def with_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Counts and metrics at score >= threshold, in one aggregation."""
    counts = confusion_counts(F.col(score) >= threshold, F.col(label) == 1)
    return with_metrics(df.agg(*[c.alias(n) for n, c in counts.items()]))


def _passed(score: Column, start: float, step: float, n: int, strict: bool) -> Column:
    """How many of the thresholds start + i*step the score reaches: a guess corrected by one comparison each way."""
    ts = [round(start + i * step, 10) for i in range(n)]
    array = F.array(*[F.lit(t) for t in ts])
    guess = F.greatest(F.lit(0), F.least(F.lit(n), (F.floor((score - start) / step) + 1).cast("int")))
    reaches = (lambda i: score > F.get(array, i)) if strict else (lambda i: score >= F.get(array, i))
    up = F.when((guess < n) & reaches(guess), 1).otherwise(0)
    down = F.when((guess > 0) & ~reaches(guess - 1), 1).otherwise(0)
    return guess + up - down


def threshold_sweep(df: DataFrame, start: float, step: float, n: int, *, score: str = "score", label: str = "label",
                    strict: bool = False) -> DataFrame:
    """Confusion and metrics at each of ``n`` thresholds from one histogram of at most 2(n+1) cells.

    The cumulative window runs over the n+1 cells, never over rows.
    """
    from pyspark.sql import Window

    cells = (df.groupBy(_passed(F.col(score), start, step, n, strict).alias("i"))
             .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i"))
    full = F.broadcast(cells).join(every, "i", "right").na.fill(0, ["pos", "neg"])
    above, below = Window.orderBy(F.desc("i")), Window.orderBy("i")
    swept = full.select(
        "i",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        (F.sum("neg").over(below) - F.col("neg")).alias("tn"),
        (F.sum("pos").over(below) - F.col("pos")).alias("fn"),
    ).filter("i > 0")
    return with_metrics(swept.withColumn("threshold", F.round(F.lit(start) + (F.col("i") - 1) * F.lit(step), 10)))


def best_threshold(df: DataFrame, metric: str = "f1", n: int = 99, start: float = 0.01, step: float = 0.01,
                   **how) -> DataFrame:
    """First threshold with the best metric."""
    swept = threshold_sweep(df, start, step, n, **how)
    return swept.orderBy(F.desc(metric), "threshold").limit(1).drop("i")


def auto_threshold(df: DataFrame, score: str, label: str = "label", default: float = 3.0) -> DataFrame:
    """First best F1 over 1.0, 1.1 .. 5.0 with a strict comparison; the default when no F1 is positive."""
    best = best_threshold(df, "f1", 41, 1.0, 0.1, score=score, label=label, strict=True)
    return best.select(F.lit(score).alias("score"), F.when(F.col("f1") > 0, F.col("threshold"))
                       .otherwise(F.lit(default)).alias("threshold"), "f1")


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", **how) -> DataFrame:
    """Counts, precision and recall at every distinct score.

    Rows are combined per score first; the cumulative counts are an ordered scan, not a one-task window.
    """
    cells = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    # Written once: the count, the slices and the totals read the cells, not the rows.
    cells = written(cells.withColumn("_down", -F.col("threshold")))
    o = arrange(cells, [], ["_down"], **{"rows": cells.count(), **how})
    totals = o.df.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    curve = o.running(tp=("sum", F.col("pos")), fp=("sum", F.col("neg"))).done()
    return curve.select(
        "threshold", "pos", "neg", "tp", "fp", (totals["n"] - F.col("fp")).alias("tn"), (totals["p"] - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), totals["p"]).alias("recall"),
    )


def auc_of() -> Column:
    """V05 as an aggregate over the curve: a positive beats the negatives below it and half of those beside it."""
    won = F.sum(F.col("pos") * (F.col("tn") + F.col("neg") / 2))
    return F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))


def ap_of() -> Column:
    """V07 as an aggregate over the curve."""
    return ratio(F.sum(F.col("pos") * F.col("precision")), F.sum("pos"))


def best_of() -> Column:
    """V08 as an aggregate over the curve: the point with the highest F1, the lowest threshold on ties."""
    p, r = F.col("precision"), F.col("recall")
    point = F.struct("threshold", "tp", "fp", "tn", "fn", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"))
    return F.max_by(point, F.struct(ratio(2 * p * r, p + r + 1e-10), -F.col("threshold")))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", **how) -> DataFrame:
    """Area under the ROC curve."""
    return pr_curve(df, score, label, **how).agg(auc_of().alias("auc_roc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", **how) -> DataFrame:
    """Sum of precision times the recall step."""
    return pr_curve(df, score, label, **how).agg(ap_of().alias("average_precision"))


def optimal_point(df: DataFrame, score: str = "score", label: str = "label", **how) -> DataFrame:
    """Lowest threshold with the highest F1 of the curve, and the counts there."""
    return pr_curve(df, score, label, **how).agg(best_of().alias("b")).select("b.*")


def evaluate(df: DataFrame, weights: dict[str, float], label: str = "label", **how) -> DataFrame:
    """All score-level metrics of a weighted combination of model scores, from one curve, as one row."""
    combined = sum((F.col(m) * F.lit(float(w)) for m, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    curve = pr_curve(df.select(combined.alias("score"), F.col(label).alias("label")), **how)
    row = curve.agg(best_of().alias("b"), auc_of().alias("auc_roc"), ap_of().alias("average_precision"))
    return row.select("b.*", "auc_roc", "average_precision")


def hash_bucket(key: list[str], n: int, seed: int = 42) -> Column:
    """Reproducible bucket 0..n-1 of a row id."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def train_test_split(df: DataFrame, key: list[str], label: str, ratio_: float = 0.2, seed: int = 42) -> DataFrame:
    """``part`` is 'test' for the given share of ids; the label leaves the features."""
    cut = int(round(ratio_ * 10000))
    part = F.when(hash_bucket(key, 10000, seed) < cut, "test").otherwise("train")
    return df.withColumn("part", part).withColumn("target", F.col(label)).drop(label)


def threshold_for_fpr(df: DataFrame, fpr: float = 0.01, floor: float = 0.7, score: str = "score",
                      label: str = "label") -> float:
    """Score cut that keeps false positives within ``fpr`` of the normal rows, at least ``floor``."""
    normal = df.filter(F.col(label) != 1).select(score)
    return max(quantiles(normal, [score], [1 - fpr])[score][0], floor)
