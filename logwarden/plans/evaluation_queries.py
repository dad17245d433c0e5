"""Evaluation of scores against labels."""

from pyspark.sql import functions as F

from logwarden.operators import evaluate as v, stat
from logwarden.plans.bindings import FEATURES, SCORED, scored, table
from logwarden.plans.registry import query

R = lambda c: F.round(F.col(c), 6).alias(c)
M = ["accuracy", "precision", "recall", "f1"]
COMBINED = SCORED + ", c AS (SELECT (stat + forest + recon) / 3 AS score, label FROM scored)"
METRICS = """ratios AS (SELECT *, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM counts),
measured AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ratios)"""
COUNT = """count(*) FILTER (score {op} t AND label = 1) AS tp, count(*) FILTER (score {op} t AND label = 0) AS fp,
  count(*) FILTER (NOT score {op} t AND label = 0) AS tn, count(*) FILTER (NOT score {op} t AND label = 1) AS fn"""
OUT = """threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"""


def _combined(spark, sf):
    df = scored(spark, sf)
    return df.select(((F.col("stat") + F.col("forest") + F.col("recon")) / 3).alias("score"), "label")


def _out(df):
    return df.select("threshold", "tp", "fp", "tn", "fn", *[R(m) for m in M])


@query("V01_confusion_metrics", f"""WITH {COMBINED}, counts AS (SELECT 0.5 AS threshold, {COUNT.format(op='>=')} FROM
  (SELECT *, 0.5 AS t FROM c)), {METRICS}
SELECT {OUT.replace('threshold, ', '', 1)} FROM measured""")
def confusion_metrics(spark, sf):
    return v.confusion(_combined(spark, sf), 0.5).select("tp", "fp", "tn", "fn", *[R(m) for m in M])


def _sweep(lo, step, n, op=">=", source="c"):
    return f"""ts AS (SELECT CAST(round({lo} + i * {step}, 10) AS DOUBLE) AS t FROM range({n}) AS r(i)),
counts AS (SELECT t AS threshold, {COUNT.format(op=op)} FROM {source}, ts GROUP BY t), {METRICS}"""


@query("V02_threshold_sweep_f1", f"""WITH {COMBINED}, {_sweep(0.01, 0.01, 99)}
SELECT {OUT} FROM measured ORDER BY measured.f1 DESC, threshold LIMIT 1""")
def threshold_sweep_f1(spark, sf):
    return _out(v.best_threshold(_combined(spark, sf)))


@query("V02_threshold_sweep_table", f"""WITH {COMBINED}, {_sweep(0.01, 0.01, 99)} SELECT {OUT} FROM measured""")
def threshold_sweep_table(spark, sf):
    return _out(v.threshold_sweep(_combined(spark, sf), 0.01, 0.01, 99))


@query("V03_threshold_sweep_metric", f"""WITH {COMBINED}, {_sweep(0, 0.05, 21)}
SELECT * FROM (SELECT 'accuracy' AS metric, {OUT} FROM measured ORDER BY measured.accuracy DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'precision', {OUT} FROM measured ORDER BY measured.precision DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'recall', {OUT} FROM measured ORDER BY measured.recall DESC, threshold LIMIT 1)""")
def threshold_sweep_metric(spark, sf):
    df = _combined(spark, sf)
    parts = [_out(v.best_threshold(df, m, 21, 0.0, 0.05)).withColumn("metric", F.lit(m))
             for m in ("accuracy", "precision", "recall")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _auto(col):
    return f"""{LONG_AUTO}, c AS (SELECT {col} AS score, label FROM s), {_sweep(1.0, 0.1, 41, '>')}
SELECT '{col}' AS score, CASE WHEN f1 > 0 THEN threshold ELSE 3.0 END AS threshold, round(f1, 6) AS f1
FROM measured ORDER BY measured.f1 DESC, threshold LIMIT 1"""


LONG_AUTO = """x AS (SELECT row_number() OVER () AS rid, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_quantity, l_extendedprice FROM lineitem),
l AS (UNPIVOT x ON l_quantity, l_extendedprice INTO NAME feature VALUE v),
p0 AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd, median(v) AS med FROM l GROUP BY feature),
p1 AS (SELECT l.feature, median(abs(v - med)) * 1.4826 AS mad FROM l JOIN p0 USING (feature) GROUP BY 1),
s AS (SELECT rid, any_value(label) AS label, avg(abs((v - mu) / sd)) AS z_score, avg(abs((v - med) / mad)) AS mad_score
  FROM l JOIN p0 USING (feature) JOIN p1 USING (feature) GROUP BY rid)"""


@query("V04_auto_thresholds", f"SELECT * FROM (WITH {_auto('z_score')}) UNION ALL SELECT * FROM (WITH {_auto('mad_score')})")
def auto_thresholds(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = FEATURES[:2]
    params = stat.fit_statistical(df, cols)
    df = stat.score_mad(stat.score_z(df, params), params).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    df = df.select("z_score", "mad_score", "label")
    out = v.auto_threshold(df, "z_score").unionByName(v.auto_threshold(df, "mad_score"))
    return out.select("score", "threshold", R("f1"))


CURVE = """g AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM c GROUP BY score),
k AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, n - fp AS tn, p - tp AS fn, tp / (tp + fp) AS precision, tp / p AS recall FROM k)"""
AUC = """(SELECT sum(pos * (n - fp + neg / 2)) / (any_value(p) * any_value(n)) FROM k)"""
AP = "(SELECT sum(pos * precision) / any_value(p) FROM curve)"
POINT = """threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  round(precision, 6) AS precision, round(recall, 6) AS recall"""
BEST = f"""SELECT {POINT.replace('threshold', 'round(threshold, 6) AS threshold', 1)},
  round(2 * curve.precision * curve.recall / (curve.precision + curve.recall), 6) AS f1 FROM curve
ORDER BY 2 * curve.precision * curve.recall / (curve.precision + curve.recall + 1e-10) DESC, curve.threshold LIMIT 1"""


@query("V05_roc_auc", f"WITH {COMBINED}, {CURVE} SELECT round({AUC}, 6) AS auc_roc")
def roc_auc(spark, sf):
    return v.roc_auc(_combined(spark, sf)).select(R("auc_roc"))


DISCRETE = SCORED + ", c AS (SELECT round((stat + forest + recon) / 3, 3) AS score, label FROM scored)"


def _discrete(spark, sf):
    return _combined(spark, sf).withColumn("score", F.round("score", 3))


@query("V06_pr_curve", f"WITH {DISCRETE}, {CURVE} SELECT {POINT} FROM curve")
def pr_curve(spark, sf):
    return v.pr_curve(_discrete(spark, sf)).select("threshold", "tp", "fp", "tn", "fn", R("precision"), R("recall"))


@query("V07_average_precision", f"WITH {COMBINED}, {CURVE} SELECT round({AP}, 6) AS average_precision")
def average_precision(spark, sf):
    return v.average_precision(_combined(spark, sf)).select(R("average_precision"))


@query("V08_optimal_operating_point", f"WITH {COMBINED}, {CURVE} {BEST}")
def optimal_operating_point(spark, sf):
    df = v.optimal_point(_combined(spark, sf))
    return df.select(R("threshold"), "tp", "fp", "tn", "fn", R("precision"), R("recall"), R("f1"))


@query("V09_evaluate_detectors", f"""WITH {SCORED}, c AS (SELECT (2 * stat + forest + recon) / 4 AS score, label FROM scored),
{CURVE}, b AS ({BEST})
SELECT *, round({AUC}, 6) AS auc_roc, round({AP}, 6) AS average_precision FROM b""")
def evaluate_detectors(spark, sf):
    df = v.evaluate(scored(spark, sf), {"stat": 2, "forest": 1, "recon": 1})
    return df.select(R("threshold"), "tp", "fp", "tn", "fn", R("precision"), R("recall"), R("f1"), R("auc_roc"),
                     R("average_precision"))


@query("V10_train_test_split", """SELECT doc_id, quality AS target,
  CASE WHEN CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS part
FROM labels""")
def train_test_split(spark, sf):
    df = v.train_test_split(table(spark, sf, "labels"), ["doc_id"], "quality")
    return df.select("doc_id", "target", "part")


@query("V11_threshold_for_fpr", f"""WITH {COMBINED}
SELECT round(greatest(quantile_cont(score, 0.99), 0.7), 6) AS threshold,
  (SELECT count(*) FROM c x WHERE label = 0 AND x.score > (SELECT greatest(quantile_cont(score, 0.99), 0.7) FROM c WHERE label = 0))
  AS false_positives FROM c WHERE label = 0""")
def threshold_for_fpr(spark, sf):
    df = _combined(spark, sf)
    t = v.threshold_for_fpr(df)
    return df.agg(F.lit(round(t, 6)).alias("threshold"),
                  F.count_if((F.col("label") == 0) & (F.col("score") > t)).alias("false_positives"))
