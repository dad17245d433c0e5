"""The statistical detector on the numeric line features."""

from pyspark.sql import functions as F

from logwarden.operators import stat
from logwarden.plans.bindings import FEATURES, table
from logwarden.plans.registry import query

IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
R = lambda c: F.round(F.col(c), 6).alias(c)

LONG = """x AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
  l_discount, l_tax FROM lineitem),
l AS (UNPIVOT x ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v),
p0 AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd, median(v) AS med, quantile_cont(v, 0.25) AS q1,
  quantile_cont(v, 0.75) AS q3 FROM l GROUP BY feature),
p1 AS (SELECT l.feature, median(abs(v - med)) * 1.4826 AS mad FROM l JOIN p0 USING (feature) GROUP BY 1),
p AS (SELECT feature, mu, greatest(sd, 1e-10) AS sd, med, greatest(mad, 1e-10) AS mad, q1, q3,
  greatest(q3 - q1, 1e-10) AS iqr FROM p0 JOIN p1 USING (feature)),
d AS (SELECT l.*, mu, sd, med, mad, q1, q3, iqr, abs((v - mu) / sd) AS z, abs((v - med) / mad) AS m,
  greatest(0, (q1 - 1.5 * iqr - v) / iqr, (v - q3 - 1.5 * iqr) / iqr) AS i FROM l JOIN p USING (feature)),
s AS (SELECT rid, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber,
  any_value(l_partkey) AS l_partkey, avg(z) AS z, avg(m) AS m, avg(i) AS i, 0.6745 * avg(m) AS r FROM d GROUP BY rid)"""
ID_SQL = "l_orderkey, l_linenumber, l_partkey"


def wide(expr: str, source: str = "d") -> str:
    """SQL: one column per feature from the long form."""
    ids = ", ".join(f"any_value({c}) AS {c}" for c in IDS)
    cells = ", ".join(f"any_value({expr}) FILTER (feature = '{c}') AS {c}" for c in FEATURES)
    return f"SELECT {ids}, {cells} FROM {source} GROUP BY rid"


def per_feature(column: str = "explanation"):
    """The entries of an explanation map as one rounded column per feature."""
    return [F.round(F.try_element_at(column, F.lit(c)), 6).alias(c) for c in FEATURES]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*IDS, *FEATURES)


def _fitted(spark, sf):
    df = _lines(spark, sf)
    return df, stat.fit_statistical(df, FEATURES)


@query("D01_fit_baseline", f"""WITH {LONG}
SELECT feature, round(mu, 8) AS mean, round(sd, 8) AS std, round(med, 8) AS median, round(mad, 8) AS mad,
  round(q1, 8) AS q1, round(q3, 8) AS q3, round(iqr, 8) AS iqr FROM p""")
def fit_baseline(spark, sf):
    _, params = _fitted(spark, sf)
    t = params.table(spark)
    return t.select("feature", *[F.round(c, 8).alias(c) for c in t.columns[1:]])


def _score_query(name, fn, expr):
    @query(name, f"WITH {LONG} SELECT {ID_SQL}, round({expr}, 6) AS score FROM s")
    def run(spark, sf):
        df, params = _fitted(spark, sf)
        return fn(df, params, "score").select(*IDS, R("score"))


_score_query("D02_zscore_score", stat.score_z, "z")
_score_query("D03_mad_score", stat.score_mad, "m")
_score_query("D04_iqr_score", stat.score_iqr, "i")
_score_query("D05_robust_score", stat.score_robust, "r")


@query("D06_combine_methods", f"""WITH {LONG}, c AS (SELECT *, (z + m) / 2 AS a, (z + 2 * m + i + 0.5 * r) / 4.5 AS b FROM s)
SELECT {ID_SQL}, round(a / greatest(max(a) OVER (), 1e-10), 6) AS anomaly_score,
  round(b / greatest(max(b) OVER (), 1e-10), 6) AS weighted_score FROM c""")
def combine_methods(spark, sf):
    df, params = _fitted(spark, sf)
    weights = {"zscore": 1.0, "mad": 2.0, "iqr": 1.0, "robust": 0.5}
    df = stat.score_together(df, params, {"anomaly_score": None, "weighted_score": weights})
    return df.select(*IDS, R("anomaly_score"), R("weighted_score"))


SHARES = """sh AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, feature,
  (coalesce(z / nullif(sum(z) OVER (PARTITION BY rid), 0), 0) + coalesce(m / nullif(sum(m) OVER (PARTITION BY rid), 0), 0)) / 2
  AS importance FROM d)"""


@query("D07_explain_statistical", f"WITH {LONG}, {SHARES} {wide('round(importance, 6)', 'sh')}")
def explain_statistical(spark, sf):
    df, params = _fitted(spark, sf)
    return stat.explain_statistical(df, params).select(*IDS, *per_feature())


@query("D08_top_anomalous_features", f"""WITH {LONG}, k AS (
  SELECT *, (z + m) / 2 AS dev, row_number() OVER (PARTITION BY rid ORDER BY (z + m) / 2 DESC, feature) AS place FROM d)
SELECT {ID_SQL}, place, feature, round(dev, 6) AS score FROM k WHERE place <= 3""")
def top_anomalous_features(spark, sf):
    df, params = _fitted(spark, sf)
    top = stat.top_features(df, params, 3).select(*IDS, F.posexplode("top_features").alias("place", "t"))
    return top.select(*IDS, (F.col("place") + 1).cast("bigint").alias("place"), "t.feature",
                      F.round("t.score", 6).alias("score"))


@query("D09_feature_thresholds", f"""WITH {LONG}
SELECT 'zscore' AS method, feature, round(mu - 3 * sd, 6) AS lower, round(mu + 3 * sd, 6) AS upper FROM p
UNION ALL SELECT 'mad', feature, round(med - 3 * mad, 6), round(med + 3 * mad, 6) FROM p
UNION ALL SELECT 'iqr', feature, round(q1 - 3 * iqr, 6), round(q3 + 3 * iqr, 6) FROM p""")
def feature_thresholds(spark, sf):
    _, params = _fitted(spark, sf)
    rows = [(m, *r) for m in ("zscore", "mad", "iqr") for r in stat.feature_bounds(params, m)]
    out = spark.createDataFrame(rows, "method string, feature string, lower double, upper double")
    return out.select("method", "feature", R("lower"), R("upper"))


def _flag_query(name, fn, expr, reach):
    @query(name, f"WITH {LONG} {wide(expr)}")
    def run(spark, sf):
        df, params = _fitted(spark, sf)
        return df.select(*IDS, *[fn(b, reach).alias(b.feature) for b in params.values()])


# Reaches chosen so that both outcomes occur in this data.
_flag_query("D10_flag_outlier_zscore", stat.is_outlier_z, "z > 1.5", 1.5)
_flag_query("D11_flag_outlier_mad", stat.is_outlier_mad, "0.6745 * abs((v - med) / (mad / 1.4826)) > 1.2", 1.2)
_flag_query("D12_flag_outlier_iqr", stat.is_outlier_iqr, "v < q1 - 0.3 * iqr OR v > q3 + 0.3 * iqr", 0.3)


@query("D13_feature_distribution", f"""WITH {LONG}, c AS (SELECT l.feature, v - mu AS e FROM l JOIN p0 USING (feature)),
k AS (SELECT feature, avg(e ** 3) / (avg(e ** 2) ** 1.5) AS skewness, avg(e ** 4) / (avg(e ** 2) ** 2) - 3 AS kurtosis
  FROM c GROUP BY feature)
SELECT feature, round(avg(v), 8) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, min(v) AS min,
  max(v) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(any_value(skewness), 6) AS skewness,
  round(any_value(kurtosis), 6) AS kurtosis FROM l JOIN k USING (feature) GROUP BY feature""")
def feature_distribution(spark, sf):
    t = stat.profile_features(_lines(spark, sf), FEATURES)
    return t.select("feature", F.round("mean", 8).alias("mean"), *[R(c) for c in t.columns[2:]])


@query("D14_normality_check", f"""WITH {LONG}, c AS (SELECT l.feature, v - mu AS e FROM l JOIN p0 USING (feature)),
k AS (SELECT feature, count(*) / 6 * ((avg(e ** 3) / (avg(e ** 2) ** 1.5)) ** 2
  + (avg(e ** 4) / (avg(e ** 2) ** 2) - 3) ** 2 / 4) AS jb FROM c GROUP BY feature)
SELECT feature, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM k""")
def normality_check(spark, sf):
    t = stat.normality(_lines(spark, sf), FEATURES)
    return t.select("feature", F.round("jarque_bera", 4).alias("jarque_bera"), R("p_value"), "is_normal")


@query("D15_standardize", f"WITH {LONG} {wide('round((v - mu) / sd, 6)')}")
def standardize(spark, sf):
    df, params = _fitted(spark, sf)
    return stat.standardize(df, params).select(*IDS, *[R(c) for c in FEATURES])


@query("D16_destandardize", f"SELECT {ID_SQL}, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def destandardize(spark, sf):
    df, params = _fitted(spark, sf)
    back = stat.destandardize(stat.standardize(df, params), params)
    return back.select(*IDS, *[F.round(c, 4).alias(c) for c in FEATURES])


@query("D17_feature_importance_corr", f"""WITH {LONG}, t AS (SELECT rid, (z + m) / 2 AS total FROM s),
c AS (SELECT feature, abs(corr(z, total)) AS a FROM d JOIN t USING (rid) GROUP BY feature)
SELECT feature, round(a / sum(a) OVER (), 6) AS importance FROM c""")
def feature_importance_corr(spark, sf):
    df, params = _fitted(spark, sf)
    df = df.withColumns({f"z_{b.feature}": stat.z_of(b) for b in params.values()})
    df = stat.score_statistical(df, params, name="total")
    out = stat.importance_corr(df, [f"z_{c}" for c in FEATURES], "total")
    return out.select(F.substring("feature", 3, 100).alias("feature"), R("importance"))
