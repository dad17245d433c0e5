"""The statistical detector.

Fitting returns a small driver-side parameter set (one entry per feature), so scoring is a pure
projection with literals: no join, no shuffle, one code-generated stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.quantiles import measured, quantiles

FLOOR = 1e-10
MAD_SCALE = 1.4826
ROBUST_SCALE = 0.6745
IQR_REACH = 1.5
METHOD_WEIGHTS = {"zscore": 1.0, "mad": 1.0, "iqr": 0.0, "robust": 0.0}


@dataclass(frozen=True)
class Baseline:
    """D01 parameters of one feature."""

    feature: str
    mean: float
    std: float
    median: float
    mad: float
    q1: float
    q3: float
    iqr: float


class Baselines(dict):
    """Feature name -> Baseline, in fitting order, plus the maximum raw score seen at fit time."""

    max_score: float | None = None

    def table(self, spark) -> DataFrame:
        schema = "feature string, mean double, std double, median double, mad double, q1 double, q3 double, iqr double"
        return spark.createDataFrame([tuple(vars(b).values()) for b in self.values()], schema)


def fit_statistical(df: DataFrame, columns: list[str], *, fit_max: bool = False) -> Baselines:
    """Mean, population std, median, scaled MAD, quartiles and IQR per feature, each spread floored."""
    also = [f(c).alias(f"{p}_{i}") for p, f in (("mean", F.avg), ("std", F.stddev_pop)) for i, c in enumerate(columns)]
    quartiles, moments = measured(df, columns, [0.25, 0.5, 0.75], also)
    off = df.select(*[F.abs(F.col(c) - F.lit(quartiles[c][1])).alias(f"d{i}") for i, c in enumerate(columns)])
    deviations = quantiles(off, off.columns, [0.5])
    out = Baselines()
    for i, c in enumerate(columns):
        q1, median, q3 = quartiles[c]
        out[c] = Baseline(c, moments[f"mean_{i}"], max(moments[f"std_{i}"], FLOOR), median,
                          max(deviations[f"d{i}"][0] * MAD_SCALE, FLOOR), q1, q3, max(q3 - q1, FLOOR))
    if fit_max:
        out.max_score = df.agg(F.max(raw_score(out))).first()[0]
    return out


def z_of(b: Baseline) -> Column:
    return F.abs((F.col(b.feature) - F.lit(b.mean)) / F.lit(b.std))


def mad_of(b: Baseline) -> Column:
    return F.abs((F.col(b.feature) - F.lit(b.median)) / F.lit(b.mad))


def iqr_of(b: Baseline) -> Column:
    x = F.col(b.feature)
    below = (F.lit(b.q1 - IQR_REACH * b.iqr) - x) / F.lit(b.iqr)
    above = (x - F.lit(b.q3 + IQR_REACH * b.iqr)) / F.lit(b.iqr)
    return F.greatest(F.lit(0.0), below, above)


def robust_of(b: Baseline) -> Column:
    return ROBUST_SCALE * mad_of(b)


PER_FEATURE = {"zscore": z_of, "mad": mad_of, "iqr": iqr_of, "robust": robust_of}


def add_up(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def method_score(params: Baselines, method: str) -> Column:
    """Mean over the features of one method's deviation."""
    return add_up([PER_FEATURE[method](b) for b in params.values()]) / len(params)


def score_z(df: DataFrame, params: Baselines, name: str = "z_score") -> DataFrame:
    """D02."""
    return df.withColumn(name, method_score(params, "zscore"))


def score_mad(df: DataFrame, params: Baselines, name: str = "mad_score") -> DataFrame:
    """D03."""
    return df.withColumn(name, method_score(params, "mad"))


def score_iqr(df: DataFrame, params: Baselines, name: str = "iqr_score") -> DataFrame:
    """D04."""
    return df.withColumn(name, method_score(params, "iqr"))


def score_robust(df: DataFrame, params: Baselines, name: str = "robust_score") -> DataFrame:
    """D05."""
    return df.withColumn(name, method_score(params, "robust"))


def raw_score(params: Baselines, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the enabled methods, z-score when none is enabled."""
    weights = {m: w for m, w in (weights or METHOD_WEIGHTS).items() if w > 0} or {"zscore": 1.0}
    total = sum(weights.values())
    return add_up([method_score(params, m) * w for m, w in weights.items()]) / total


def score_statistical(df: DataFrame, params: Baselines, weights: dict[str, float] | None = None,
                      name: str = "anomaly_score") -> DataFrame:
    """Combined score divided by its maximum (of this data, or of the fit when stored)."""
    if params.max_score is not None:
        return df.withColumn(name, raw_score(params, weights) / F.lit(max(params.max_score, FLOOR)))
    return score_together(df, params, {name: weights})


def score_together(df: DataFrame, params: Baselines, named: dict[str, dict[str, float] | None]) -> DataFrame:
    """D06 for several weightings: one pass finds all their maxima."""
    raw = {name: raw_score(params, weights) for name, weights in named.items()}
    tops = df.agg(F.struct(*[F.max(c).alias(f"t{i}") for i, c in enumerate(raw.values())])).scalar()
    return df.withColumns({name: c / F.greatest(tops[f"t{i}"], F.lit(FLOOR)) for i, (name, c) in enumerate(raw.items())})


def _shares(parts: list[Column]) -> list[Column]:
    total = add_up(parts)
    return [F.when(total > 0, p / total).otherwise(F.lit(0.0)) for p in parts]


def explanation(params: Baselines, weights: dict[str, float] | None = None) -> Column:
    """Map feature -> weighted mean of its share in the z, MAD and IQR deviations."""
    weights = {m: w for m, w in (weights or METHOD_WEIGHTS).items() if w > 0 and m != "robust"}
    names = F.array(*[F.lit(f) for f in params])
    if not weights:
        return F.map_from_arrays(names, F.array(*[F.lit(1.0 / len(params))] * len(params)))
    by_method = [[s * w for s in _shares([PER_FEATURE[m](b) for b in params.values()])] for m, w in weights.items()]
    total = sum(weights.values())
    return F.map_from_arrays(names, F.array(*[add_up(list(parts)) / total for parts in zip(*by_method)]))


def explain_statistical(df: DataFrame, params: Baselines, weights: dict[str, float] | None = None) -> DataFrame:
    """D07."""
    return df.withColumn("explanation", explanation(params, weights))


def top_features(df: DataFrame, params: Baselines, n: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """The ``n`` features with the largest weighted deviation, ties by name."""
    weights = {m: w for m, w in (weights or METHOD_WEIGHTS).items() if w > 0 and m != "robust"}
    total = sum(weights.values()) or 1.0
    cells = [
        F.struct((-(add_up([PER_FEATURE[m](b) * w for m, w in weights.items()]) / total)).alias("neg"),
                 F.lit(b.feature).alias("feature"))
        for b in params.values()
    ]
    best = F.slice(F.array_sort(F.array(*cells)), 1, n)
    pairs = F.transform(best, lambda s: F.struct(s["feature"].alias("feature"), (-s["neg"]).alias("score")))
    return df.withColumn("top_features", pairs)


def feature_bounds(params: Baselines, method: str = "zscore", k: float = 3.0) -> list[tuple[str, float, float]]:
    """(feature, lower, upper) by zscore, mad or iqr."""
    if method not in ("zscore", "mad", "iqr"):
        raise ValueError(f"unknown method {method}")
    sides = {"zscore": lambda b: (b.mean, b.mean, b.std), "mad": lambda b: (b.median, b.median, b.mad),
             "iqr": lambda b: (b.q1, b.q3, b.iqr)}[method]
    out = []
    for b in params.values():
        low, high, spread = sides(b)
        out.append((b.feature, low - k * spread, high + k * spread))
    return out


def is_outlier_z(b: Baseline, threshold: float = 3.0) -> Column:
    """Abs z above the threshold; false for a constant feature."""
    return F.lit(False) if b.std <= FLOOR else z_of(b) > threshold


def is_outlier_mad(b: Baseline, threshold: float = 3.0) -> Column:
    """Modified z on the unscaled MAD."""
    if b.mad <= FLOOR:
        return F.lit(False)
    return ROBUST_SCALE * F.abs((F.col(b.feature) - F.lit(b.median)) / F.lit(b.mad / MAD_SCALE)) > threshold


def is_outlier_iqr(b: Baseline, reach: float = IQR_REACH) -> Column:
    """Strictly outside the whiskers."""
    x = F.col(b.feature)
    return (x < F.lit(b.q1 - reach * b.iqr)) | (x > F.lit(b.q3 + reach * b.iqr))


def profile_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, std, min, max, p25, p75, iqr, skewness and excess kurtosis per feature."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"s{i}"), F.min(c).alias(f"l{i}"),
                 F.max(c).alias(f"h{i}"), F.skewness(c).alias(f"k{i}"), F.kurtosis(c).alias(f"t{i}")]
    m = df.agg(*aggs).first()
    qs = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [
        (c, m[f"a{i}"], qs[c][1], m[f"s{i}"], float(m[f"l{i}"]), float(m[f"h{i}"]), qs[c][0], qs[c][2],
         qs[c][2] - qs[c][0], m[f"k{i}"], m[f"t{i}"])
        for i, c in enumerate(columns)
    ]
    schema = ("feature string, mean double, median double, std double, min double, max double, p25 double, p75 double, "
              "iqr double, skewness double, kurtosis double")
    return df.sparkSession.createDataFrame(rows, schema)


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jarque-Bera statistic, p = exp(-JB/2), normal when p > 0.05; one pass over the data."""
    wide = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.skewness(c).alias("s"),
                             F.kurtosis(c).alias("k")).alias(f"x{i}") for i, c in enumerate(columns)])
    rows = wide.select(F.inline(F.array(*[f"x{i}" for i in range(len(columns))])))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    out = rows.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
    return out.select("feature", "jarque_bera", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))


def standardize(df: DataFrame, params: Baselines, prefix: str = "") -> DataFrame:
    """(x - mean) / std, std 1 when the feature is constant."""
    return df.withColumns({
        prefix + b.feature: (F.col(b.feature) - F.lit(b.mean)) / F.lit(1.0 if b.std <= FLOOR else b.std)
        for b in params.values()
    })


def destandardize(df: DataFrame, params: Baselines, prefix: str = "") -> DataFrame:
    """Back to the original scale."""
    return df.withColumns({
        prefix + b.feature: F.col(prefix + b.feature) * F.lit(1.0 if b.std <= FLOOR else b.std) + F.lit(b.mean)
        for b in params.values()
    })


def importance_corr(df: DataFrame, feature_scores: list[str], total: str) -> DataFrame:
    """Abs correlation of each feature score with the total score, normalized to sum 1."""
    row = df.agg(*[F.abs(F.corr(c, total)).alias(c) for c in feature_scores])
    whole = add_up([F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in feature_scores])
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.when(whole > 0, F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) / whole).otherwise(0.0)
                      .alias("importance")) for c in feature_scores]
    return row.select(F.inline(F.array(*cells)))
