"""Cross-validation, ensembles, detection and the model catalogue."""

from pyspark.sql import functions as F

from logwarden.operators import ensemble as e, forest, stat
from logwarden.plans.bindings import DET, EV, FEATURES, SCORED, detections, events, scored, table
from logwarden.plans.detector_queries import LONG, SHARES, per_feature, wide
from logwarden.plans.registry import query
from logwarden.session import scratch_path
from logwarden.sources import sinks

R = lambda c: F.round(F.col(c), 6).alias(c)
MODELS = ["stat", "forest", "recon"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEY_SQL = ", ".join(KEY)


@query("M11_kfold_score", """WITH x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem),
f AS (SELECT DISTINCT fold FROM x),
p AS (SELECT f.fold, avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2,
  avg(l_discount) AS m3, stddev_pop(l_discount) AS s3, avg(l_tax) AS m4, stddev_pop(l_tax) AS s4
  FROM f JOIN x ON x.fold <> f.fold GROUP BY f.fold)
SELECT fold, round(avg((abs((l_quantity - m1) / s1) + abs((l_extendedprice - m2) / s2) + abs((l_discount - m3) / s3)
  + abs((l_tax - m4) / s4)) / 4), 6) AS mean_score, count(*) AS n FROM x JOIN p USING (fold) GROUP BY fold""")
def kfold_score(spark, sf):
    return e.kfold(table(spark, sf, "lineitem"), FEATURES, KEY).select("fold", R("mean_score"), "n")


@query("M11_cross_validate", """WITH x AS (SELECT l_quantity AS q, l_extendedprice AS e,
  CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8) AS BIGINT) % 3 AS fold FROM lineitem),
f AS (SELECT DISTINCT fold FROM x),
p AS (SELECT f.fold, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.75) AS q3, quantile_cont(e, 0.25) AS e1, quantile_cont(e, 0.75) AS e3
  FROM f JOIN x ON x.fold <> f.fold GROUP BY f.fold),
s AS (SELECT fold, (abs(q - (q1 + q3) / 2) / (q3 - q1) + abs(e - (e1 + e3) / 2) / (e3 - e1)) / 2 AS score FROM x JOIN p USING (fold))
SELECT fold, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, count(*) AS n FROM s GROUP BY fold""")
def cross_validate(spark, sf):
    """A caller's own model: distance from the middle of the quartiles, in quartile ranges."""
    from logwarden.operators.quantiles import quantiles

    cols = ["l_quantity", "l_extendedprice"]
    away = lambda c, q: F.abs(F.col(c) - (q[0] + q[1]) / 2) / (q[1] - q[0])
    out = e.cross_validate(table(spark, sf, "lineitem"), KEY, lambda train: quantiles(train, cols, [0.25, 0.75]),
                           lambda _, m: sum((away(c, m[c]) for c in cols), F.lit(0.0)) / len(cols), k=3)
    return out.select("fold", R("mean_score"), R("std_score"), "n")


@query("M12_top_anomalies", f"""WITH {DET} SELECT event_id, round(anomaly_score, 6) AS anomaly_score FROM det
ORDER BY det.anomaly_score DESC, event_id LIMIT 25""")
def top_anomalies(spark, sf):
    return e.top_anomalies(detections(spark, sf), "anomaly_score", ["event_id"], 25).select("event_id", R("anomaly_score"))


@query("M13_ensemble_combine", f"""WITH {SCORED} SELECT {KEY_SQL}, round((stat + forest + recon) / 3, 6) AS average,
  round((2 * stat + forest + 0.5 * recon) / 3.5, 6) AS weighted, round(greatest(stat, forest, recon), 6) AS maximum,
  round(least(stat, forest, recon), 6) AS minimum, round(list_median([stat, forest, recon]), 6) AS median,
  round(((stat >= 0.5)::INT + (forest >= 0.6)::INT + (recon >= 0.5)::INT) / 3, 6) AS majority,
  round((stat + forest + recon) / 3, 6) AS other FROM scored""".replace("list_median([stat, forest, recon])", "list_aggregate([stat, forest, recon], 'median')"))
def ensemble_combine(spark, sf):
    r = lambda c: F.round(c, 6)
    return scored(spark, sf).select(
        *KEY, r(e.combine(MODELS)).alias("average"),
        r(e.combine(MODELS, "weighted_average", {"stat": 2, "recon": 0.5})).alias("weighted"),
        r(e.combine(MODELS, "maximum")).alias("maximum"), r(e.combine(MODELS, "minimum")).alias("minimum"),
        r(e.combine(MODELS, "median")).alias("median"),
        r(e.combine(MODELS, "majority_vote", thresholds={"forest": 0.6})).alias("majority"),
        r(e.combine(MODELS, "unknown")).alias("other"))


F1 = "2 * count(*) FILTER ({h} AND label = 1) / nullif(2 * count(*) FILTER ({h} AND label = 1) + count(*) FILTER ({h} AND label = 0) + count(*) FILTER (NOT {h} AND label = 1), 0)"


@query("M14_weights_by_f1", f"""WITH {SCORED}, f AS (SELECT {F1.format(h='(stat >= 0.5)')} AS a, {F1.format(h='(forest >= 0.5)')} AS b,
  {F1.format(h='(recon >= 0.5)')} AS c FROM scored)
SELECT 'stat' AS model, round(a, 6) AS f1, round(a / (a + b + c + 1e-10), 6) AS weight FROM f
UNION ALL SELECT 'forest', round(b, 6), round(b / (a + b + c + 1e-10), 6) FROM f
UNION ALL SELECT 'recon', round(c, 6), round(c / (a + b + c + 1e-10), 6) FROM f""")
def weights_by_f1(spark, sf):
    return e.f1_weights(scored(spark, sf), MODELS).select("model", R("f1"), R("weight"))


@query("M15_optimize_weights", f"""WITH {SCORED}, g AS (SELECT i / 4 AS a, j / 4 AS b, (4 - i - j) / 4 AS c FROM range(5) AS r(i), range(5) AS s(j) WHERE i + j <= 4),
f AS (SELECT a, b, c, {F1.format(h='(stat * a + forest * b + recon * c >= 0.5)')} AS f1 FROM scored, g GROUP BY a, b, c)
SELECT a AS stat, b AS forest, c AS recon, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, a, b LIMIT 1""")
def optimize_weights(spark, sf):
    return e.optimize_weights(scored(spark, sf), MODELS, step=0.25).select(*MODELS, R("f1"))


Z_SHARE = "coalesce(z / nullif(sum(z) OVER (PARTITION BY rid), 0), 0)"


@query("M16_explain_ensemble", f"""WITH {LONG}, {SHARES}, b AS (SELECT rid, feature, {Z_SHARE} AS share FROM d),
m AS (SELECT sh.rid, {', '.join('sh.' + c for c in KEY)}, feature, (2 * importance + 1 * share) / 2 AS w FROM sh JOIN b USING (rid, feature)),
n AS (SELECT *, round(w / sum(w) OVER (PARTITION BY rid), 6) AS importance FROM m) {wide('importance', 'n')}""")
def explain_ensemble(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, *FEATURES)
    params = stat.fit_statistical(df, FEATURES)
    df = forest.explain_iforest(stat.explain_statistical(df, params), params, "forest_why")
    why = e.explain_ensemble({"stat": "explanation", "forest": "forest_why"}, FEATURES, {"stat": 2.0, "forest": 1.0})
    return df.withColumn("why", why).select(*KEY, *per_feature("why"))


@query("M05_explain_iforest", f"""WITH {LONG}, b AS (SELECT *, {Z_SHARE} AS share FROM d) {wide('round(share, 6)', 'b')}""")
def explain_iforest(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, *FEATURES)
    return forest.explain_iforest(df, stat.fit_statistical(df, FEATURES)).select(*KEY, *per_feature())


@query("M17_model_contributions", f"""WITH {SCORED} SELECT {KEY_SQL}, round((2 * stat + forest + recon) / 4, 10) AS combined,
  round(stat, 6) AS stat, round(forest, 6) AS forest, round(recon, 6) AS recon FROM scored""")
def model_contributions(spark, sf):
    df = e.contributions(scored(spark, sf), MODELS, {"stat": 2})
    return df.select(*KEY, F.round("combined", 10).alias("combined"), R("stat"), R("forest"), R("recon"))


@query("M18_disagreement", f"""WITH {SCORED}, c AS (SELECT corr(stat, forest) AS a, corr(stat, recon) AS b, corr(forest, recon) AS c,
  avg(list_aggregate([stat, forest, recon], 'stddev_pop')) AS d FROM scored)
SELECT round(d, 6) AS mean_disagreement, round(a, 6) AS stat_vs_forest, round(b, 6) AS stat_vs_recon, round(c, 6) AS forest_vs_recon,
  round((a + b + c) / 3, 6) AS mean_correlation FROM c""")
def disagreement(spark, sf):
    df = e.disagreement(scored(spark, sf), MODELS)
    return df.select(*[R(c) for c in df.columns])


@query("M18_row_disagreement", f"WITH {SCORED} SELECT {KEY_SQL}, round(list_aggregate([stat, forest, recon], 'stddev_pop'), 6) AS disagreement FROM scored")
def row_disagreement(spark, sf):
    return scored(spark, sf).select(*KEY, F.round(e.row_std(MODELS), 6).alias("disagreement"))


TOP = "SELECT {k} FROM scored ORDER BY {m} DESC, {k} LIMIT 500"


@query("M19_topk_jaccard", f"""WITH {SCORED}, a AS ({TOP.format(k=KEY_SQL, m='stat')}), b AS ({TOP.format(k=KEY_SQL, m='forest')}),
c AS ({TOP.format(k=KEY_SQL, m='recon')}), p AS (
  SELECT 'stat_vs_forest' AS pair, (SELECT count(*) FROM a JOIN b USING ({KEY_SQL})) AS n
  UNION ALL SELECT 'stat_vs_recon', (SELECT count(*) FROM a JOIN c USING ({KEY_SQL}))
  UNION ALL SELECT 'forest_vs_recon', (SELECT count(*) FROM b JOIN c USING ({KEY_SQL})))
SELECT pair, round(n / (1000 - n), 6) AS jaccard FROM p""")
def topk_jaccard(spark, sf):
    return e.topk_jaccard(scored(spark, sf), MODELS, KEY, 500).select("pair", R("jaccard"))


@query("M20_importance_summary", f"""WITH {LONG}, {SHARES} SELECT feature, round(sum(importance) / (SELECT sum(importance) FROM sh), 6) AS importance
FROM sh GROUP BY feature""")
def importance_summary(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, *FEATURES)
    out = e.importance_summary(stat.explain_statistical(df, stat.fit_statistical(df, FEATURES)))
    return out.select("feature", R("importance"))


@query("M21_detect", f"""WITH {LONG}, {SHARES}, x1 AS (SELECT s.*, l_extendedprice, l_discount FROM s JOIN x USING (rid)),
n AS (SELECT *, ((z + m) / 2) / greatest(max((z + m) / 2) OVER (), 1e-10) AS statistical, l_discount * 10 AS recon FROM x1),
c AS (SELECT *, (2 * statistical + recon) / 3 AS score FROM n),
w AS (SELECT rid, feature, importance, row_number() OVER (PARTITION BY rid ORDER BY importance DESC, feature) AS k FROM sh)
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) AS anomaly_score,
  CASE WHEN 2 * statistical >= recon THEN 'statistical' ELSE 'recon' END AS detection_method,
  round(CASE WHEN 2 * statistical >= recon THEN statistical ELSE recon END, 6) AS confidence,
  CASE WHEN 2 * statistical >= recon THEN feature END AS main_factor FROM c JOIN w USING (rid) WHERE k = 1 AND score > 0.7""")
def detect(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, *FEATURES)
    params = stat.fit_statistical(df, FEATURES)
    df = stat.explain_statistical(stat.score_statistical(df, params, name="statistical"), params)
    df = df.withColumn("recon", F.col("l_discount") * 10)
    out = e.detect(df, ["statistical", "recon"], weights={"statistical": 2.0}, explanations={"statistical": "explanation"})
    ranked = F.array_sort(F.transform(F.map_entries("explanation"), lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("k"))))
    return out.select(*KEY, R("anomaly_score"), "detection_method", R("confidence"), ranked[0]["k"].alias("main_factor"))


@query("M22_save_load_params", f"""WITH {LONG}, s2 AS (SELECT feature, mu AS mean, sd AS std, med AS median, mad, q1, q3, iqr FROM p),
u AS (UNPIVOT s2 ON mean, std, median, mad, q1, q3, iqr INTO NAME name VALUE value)
SELECT 'lines' AS model_id, '1.0.0' AS version, 'statistical' AS kind, feature, name, round(value, 8) AS value FROM u""")
def save_load_params(spark, sf):
    params = stat.fit_statistical(table(spark, sf, "lineitem"), FEATURES)
    rows = [("statistical", b.feature, n, float(x)) for b in params.values() for n, x in vars(b).items() if n != "feature"]
    path = scratch_path(spark)
    sinks.save_params(spark, rows, "lines", "1.0.0", path)
    sinks.save_params(spark, rows[:3], "lines", "1.1.0", path)
    out = sinks.load_params(spark, path, "lines", "1.0.0")
    return out.select("model_id", "version", "kind", "feature", "name", F.round("value", 8).alias("value"))


CATALOG = """cat AS (SELECT p_brand AS model_id, p_type AS model_type, '1.' || (p_partkey % 13) || '.' || (p_size % 20) AS version, p_retailprice AS value FROM part)"""


def _catalog(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_brand AS model_id", "p_type AS model_type", "concat('1.', p_partkey % 13, '.', p_size % 20) AS version",
        "p_retailprice AS value")


@query("M23_model_catalog", f"""WITH {CATALOG}, k AS (SELECT *, row_number() OVER (PARTITION BY model_id, model_type
  ORDER BY CAST(string_split(version, '.')[2] AS INT) DESC, CAST(string_split(version, '.')[3] AS INT) DESC) AS n FROM cat)
SELECT model_id, model_type, any_value(version) FILTER (n = 1) AS latest, count(DISTINCT version) AS versions FROM k GROUP BY 1, 2""")
def model_catalog(spark, sf):
    return e.latest_models(_catalog(spark, sf))


@query("M23_model_diff", f"""WITH {CATALOG}, a AS (SELECT version AS stat, max(value) AS a FROM cat WHERE model_id = 'Brand#1' GROUP BY 1),
b AS (SELECT version AS stat, max(value) AS b FROM cat WHERE model_id = 'Brand#2' GROUP BY 1)
SELECT stat, a, b, round(b - a, 6) AS delta FROM a FULL JOIN b USING (stat) WHERE a IS DISTINCT FROM b""")
def model_diff(spark, sf):
    cat = _catalog(spark, sf)
    stats = lambda m: cat.filter(F.col("model_id") == m).groupBy(F.col("version").alias("stat")).agg(F.max("value").alias("value"))
    return e.diff_models(stats("Brand#1"), stats("Brand#2")).select("stat", "a", "b", R("delta"))


@query("M24_top_comparison", f"""WITH {SCORED}, c AS (SELECT *, (stat + forest + recon) / 3 AS combined FROM scored),
t AS (SELECT {KEY_SQL}, combined, stat, forest, recon FROM c ORDER BY combined DESC, {KEY_SQL} LIMIT 20)
SELECT {KEY_SQL}, round(combined, 6) AS combined, model, round(score, 6) AS score FROM (UNPIVOT t ON stat, forest, recon INTO NAME model VALUE score)""")
def top_comparison(spark, sf):
    return e.top_comparison(scored(spark, sf), MODELS, KEY).select(*KEY, R("combined"), "model", R("score"))


@query("U03_grouped_function", f"""WITH {EV} SELECT username, count(*) AS n, round(avg(duration), 8) AS mean, round(stddev_pop(duration), 6) AS std FROM ev GROUP BY 1""")
def grouped_function(spark, sf):
    """A pandas function per bounded chunk of a group; the partial moments merge in Spark."""
    import pandas as pd

    from logwarden.operators.grouped import apply_chunks

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["duration"]
        return pd.DataFrame({"username": [pdf["username"].iloc[0]], "n": [len(d)], "s": [d.sum()], "q": [(d * d).sum()]})

    parts = apply_chunks(events(spark, sf).select("event_id", "username", "duration"), ["username"], "event_id", moments,
                         "username string, n bigint, s double, q double")
    out = parts.groupBy("username").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return out.select("username", "n", F.round(mean, 8).alias("mean"),
                      F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))
