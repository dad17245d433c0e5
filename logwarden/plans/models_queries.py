"""M01-M10 and the full detection run: isolation forest and reconstruction on numeric features."""

from pyspark.sql import functions as F

from logwarden.operators import ensemble as e, features as f, forest as fo, joins, recon, stat
from logwarden.plans.bindings import FEATURES, events, table
from logwarden.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
R = lambda c: F.round(F.col(c), 6).alias(c)


def subspace_sql(k: int) -> str:
    """CTEs ``z`` (key, z: standardized features), ``p1`` to ``pk`` (projectors on the leading principal directions, row by row) and
    ``r`` (key, z, r: projected): a covariance matrix squared thirty times leaves its leading direction, which then is taken out."""
    at = range(4)
    cell = lambda m, i, j: f"{m}[{4 * i + j + 1}]"
    grid = lambda f: "[" + ", ".join(f(i, j) for i in at for j in at) + "]"
    parts = [f"""s AS (SELECT {", ".join(f"avg({c}::DOUBLE) AS m{i}, stddev_pop({c}::DOUBLE) AS s{i}" for i, c in enumerate(FEATURES))} FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, l_partkey, [{", ".join(f"({c}::DOUBLE - m{i}) / s{i}" for i, c in enumerate(FEATURES))}] AS z FROM lineitem, s),
c1 AS (SELECT {grid(lambda i, j: f"avg(z[{i + 1}] * z[{j + 1}])")} AS c FROM z)"""]
    for n in range(1, k + 1):
        square = grid(lambda i, j: " + ".join(f"{cell('a', i, x)} * {cell('a', x, j)}" for x in at))
        parts.append(f"""w{n}(step, a) AS (SELECT 0, c FROM c{n} UNION ALL
  SELECT step + 1, list_transform(q, lambda x: x / (q[1] + q[6] + q[11] + q[16])) FROM (SELECT step, {square} AS q FROM w{n} WHERE step < 30)),
p{n} AS (SELECT a AS p FROM w{n} WHERE step = 30),
c{n + 1} AS (SELECT {grid(lambda i, j: f"{cell('c', i, j)} - l * {cell('p', i, j)}")} AS c
  FROM (SELECT c, p, {" + ".join(f"c[{x + 1}] * p[{x + 1}]" for x in range(16))} AS l FROM c{n}, p{n}))""")
    total = lambda i, j: " + ".join(cell(f"p{n}.p", i, j) for n in range(1, k + 1))
    back = ", ".join(" + ".join(f"({total(i, j)}) * z[{j + 1}]" for j in at) for i in at)
    parts.append(f"r AS (SELECT l_orderkey, l_linenumber, l_partkey, z, [{back}] AS r FROM z, {', '.join(f'p{n}' for n in range(1, k + 1))})")
    return "WITH RECURSIVE " + ",\n".join(parts)


ERROR_SQL = "list_sum(list_transform(range(1, 5), lambda i: (z[i] - r[i]) * (z[i] - r[i])))"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*KEY, *FEATURES, "l_returnflag")


@query("M01_fit_isolation_forest")
def fit_isolation_forest(spark, sf):
    """The node table of a forest fitted on all lines."""
    forest = fo.fit_iforest(_lines(spark, sf), FEATURES, KEY)
    return spark.createDataFrame(forest.nodes, fo.NODE_SCHEMA).drop("config")


@query("M01_forest_facts", """SELECT CAST(t.range AS INT) AS tree, CAST(least(256, (SELECT count(*) FROM lineitem)) AS BIGINT) AS leaf_rows,
  true AS splits_have_two_children FROM range(100) t""")
def forest_facts(spark, sf):
    """Per tree: the rows of its leaves are the sample, and every split has two nodes below it."""
    forest = fo.fit_iforest(_lines(spark, sf), FEATURES, KEY)
    nodes = spark.createDataFrame(forest.nodes, fo.NODE_SCHEMA)
    inner = F.count_if(F.col("split") >= 0)
    return nodes.groupBy("tree").agg(F.sum(F.when(F.col("split") < 0, F.col("size"))).cast("bigint").alias("leaf_rows"),
                                     (F.count(F.lit(1)) == 2 * inner + 1).alias("splits_have_two_children"))


@query("M02_score_facts", """SELECT count(*) AS n, true AS in_range, 0.05::DOUBLE AS above_half, true AS matches_labels FROM lineitem""")
def score_facts(spark, sf):
    """All rows scored, scores within 0 to 1, and the contamination share above one half."""
    df = _lines(spark, sf)
    forest = fo.fit_iforest(df, FEATURES, KEY, contamination=0.05)
    again = fo.training_scores(forest).withColumnRenamed("forest_score", "kept")
    labelled = fo.predict_labels(fo.score_iforest(df, forest), 0.5).join(again, KEY)
    over = (F.col("forest_score") > 0.5).cast("double")
    return labelled.filter(F.abs(F.col("kept") - F.col("forest_score")) < 1e-12).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("forest_score").between(0, 1)).alias("in_range"),
                        F.round(F.avg(over), 2).alias("above_half"),
                        F.bool_and((F.col("label") == 1) | (F.col("forest_score") < 0.5)).alias("matches_labels"))


@query("M02_score_isolation_forest")
def score_isolation_forest(spark, sf):
    """The scores of the training rows, kept from the fit."""
    df = _lines(spark, sf)
    return fo.training_scores(fo.fit_iforest(df, FEATURES, KEY, contamination=0.05)).select(*KEY, R("forest_score"))


@query("M03_label_isolation_forest", """SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(l_extendedprice / 110000 >= 0.8 AS BIGINT) AS label FROM lineitem""")
def label_isolation_forest(spark, sf):
    df = _lines(spark, sf).withColumn("forest_score", F.col("l_extendedprice") / 110000)
    return fo.predict_labels(df, 0.8).select(*KEY, "label")


@query("M04_split_importance")
def split_importance(spark, sf):
    return fo.split_importance(spark, fo.fit_iforest(_lines(spark, sf), FEATURES, KEY))


@query("M04_importance_facts", """SELECT feature, 1.0::DOUBLE AS total, true AS positive FROM (VALUES ('l_quantity'), ('l_extendedprice'),
  ('l_discount'), ('l_tax')) AS t(feature)""")
def importance_facts(spark, sf):
    """Every feature has a share above 0, and the shares add up to 1."""
    out = fo.split_importance(spark, fo.fit_iforest(_lines(spark, sf), FEATURES, KEY))
    share = [c for c in out.columns if c != "feature"][0]
    total = out.agg(F.round(F.sum(share), 9)).scalar()
    return out.select("feature", total.alias("total"), (F.col(share) > 0).alias("positive"))


@query("M06_iforest_grid")
def iforest_grid(spark, sf):
    df = _lines(spark, sf).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    grid = [{"n_estimators": n, "max_samples": s, "contamination": c, "max_features": m}
            for n in (20, 50) for s in (64, "auto") for c in (0.05, 0.1) for m in (0.5, 1.0)]
    return fo.tune_iforest(df, FEATURES, KEY, grid, label="label")


@query("M06_grid_facts", """SELECT 16::BIGINT AS configurations, 16::BIGINT AS distinct_configurations, true AS in_range""")
def grid_facts(spark, sf):
    """One row per configuration, F1 within 0 to 1."""
    out = iforest_grid(spark, sf)
    metric = [c for c, t in out.dtypes if t == "double" and c not in ("contamination", "max_features")][0]
    rest = [c for c in out.columns if c != metric]
    return out.agg(F.count(F.lit(1)).alias("configurations"), F.count_distinct(F.to_json(F.struct(*rest))).alias("distinct_configurations"),
                   F.bool_and(F.col(metric).between(0, 1)).alias("in_range"))


@query("M07_loading_facts", """SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 0.0::DOUBLE), (1, 0, 0.0::DOUBLE), (1, 1, 1.0::DOUBLE)) AS t(a, b, product)""")
def loading_facts(spark, sf):
    """Loadings have unit length and are orthogonal."""
    table_ = fit_reconstruction(spark, sf)
    other = table_.select(F.col("component").alias("b"), "feature", F.col("loading").alias("w"))
    out = table_.withColumnRenamed("component", "a").join(other, "feature").groupBy("a", "b").agg(F.sum(F.col("loading") * F.col("w")).alias("product"))
    return out.select("a", "b", (F.round("product", 9) + 0.0).alias("product"))


@query("M08_error_facts", """SELECT count(*) AS n, true AS in_range FROM lineitem""")
def error_facts(spark, sf):
    out = reconstruction_score(spark, sf)
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("recon_score").between(0, 1)).alias("in_range"))


@query("M09_share_facts", """SELECT l_orderkey, l_linenumber, l_partkey, 4::BIGINT AS features, 1.0::DOUBLE AS total FROM lineitem""")
def share_facts(spark, sf):
    """Each row's shares name every feature and add up to 1."""
    df = _lines(spark, sf)
    out = recon.explain_reconstruction(df, recon.fit_reconstruction(df, FEATURES, 2))
    total = F.aggregate(F.map_values("explanation"), F.lit(0.0), lambda s, x: s + x)
    return out.select(*KEY, F.size("explanation").cast("bigint").alias("features"), F.round(total, 6).alias("total"))


@query("M10_full_rank", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice,
  round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM lineitem""")
def full_rank(spark, sf):
    """With as many components as features the input comes back."""
    df = _lines(spark, sf)
    out = recon.reconstruct(df, recon.fit_reconstruction(df, FEATURES, len(FEATURES)))
    return out.select(*KEY, *[(F.round(f"recon_{c}", 4) + 0.0).alias(c) for c in FEATURES])


@query("M07_fit_reconstruction")
def fit_reconstruction(spark, sf):
    """Loadings of the fitted subspace, one row per component and feature."""
    s = recon.fit_reconstruction(_lines(spark, sf), FEATURES, 2)
    rows = [(i, c, float(w)) for i, row in enumerate(s.loadings) for c, w in zip(s.columns, row)]
    return spark.createDataFrame(rows, "component int, feature string, loading double")


@query("M07_loading_values", subspace_sql(2) + ",\n" + """v AS (SELECT 0 AS component, p FROM p1 UNION ALL SELECT 1, p FROM p2),
d AS (SELECT component, p, list_position([p[1], p[6], p[11], p[16]], greatest(p[1], p[6], p[11], p[16])) AS top FROM v)
SELECT CAST(component AS INT) AS component, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][i] AS feature,
  round(p[4 * (i - 1) + top] / sqrt(p[5 * (top - 1) + 1]), 6) + 0.0 AS loading FROM d, range(1, 5) x(i)""")
def loading_values(spark, sf):
    return fit_reconstruction(spark, sf).select("component", "feature", (F.round("loading", 6) + 0.0).alias("loading"))


@query("M08_reconstruction_score", subspace_sql(2) + f""",
e AS (SELECT *, {ERROR_SQL} / 4 AS mse FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(mse - (SELECT avg(mse) FROM e)) / (SELECT stddev_pop(mse) FROM e))), 6) AS recon_score FROM e""")
def reconstruction_score(spark, sf):
    df = _lines(spark, sf)
    s = recon.fit_reconstruction(df, FEATURES, 2)
    return recon.score_reconstruction(df, s).select(*KEY, R("recon_score"))


@query("M09_explain_reconstruction")
def explain_reconstruction(spark, sf):
    df = _lines(spark, sf)
    out = recon.explain_reconstruction(df, recon.fit_reconstruction(df, FEATURES, 2))
    return out.select(*KEY, F.explode("explanation").alias("feature", "share"))


@query("M09_share_values", subspace_sql(2) + f""",
e AS (SELECT *, {ERROR_SQL} AS total FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][i] AS feature,
  round((z[i] - r[i]) * (z[i] - r[i]) / total, 4) AS share FROM e, range(1, 5) x(i)""")
def share_values(spark, sf):
    return explain_reconstruction(spark, sf).select(*KEY, "feature", F.round("share", 4).alias("share"))


def _vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    return df.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@query("M10_latent_projection")
def latent_projection(spark, sf):
    """Two-dimensional view of the 64-column vectors."""
    df, cols = _vectors(spark, sf)
    return recon.project(df, recon.fit_reconstruction(df, cols, 2)).select("vec_id", R("latent_0"), R("latent_1"))


@query("M10_reconstruct")
def reconstruct(spark, sf):
    df = _lines(spark, sf)
    out = recon.reconstruct(df, recon.fit_reconstruction(df, FEATURES, 3))
    return out.select(*KEY, *[R(f"recon_{c}") for c in FEATURES])


@query("M10_reconstruct_values", subspace_sql(3) + "\nSELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(r[{i + 1}] * s{i} + m{i}, 3) + 0.0 AS recon_{c}" for i, c in enumerate(FEATURES)) + " FROM r, s")
def reconstruct_values(spark, sf):
    """As rebuilt from three of four directions."""
    df = _lines(spark, sf)
    out = recon.reconstruct(df, recon.fit_reconstruction(df, FEATURES, 3))
    return out.select(*KEY, *[(F.round(f"recon_{c}", 3) + 0.0).alias(f"recon_{c}") for c in FEATURES])


@query("M21_detect_events")
def detect_events(spark, sf):
    """All three detectors on the event features, with explanation, related events and severity."""
    from logwarden.functions.values import severity
    from logwarden.session import written

    cols = ["duration", "source_ip_event_rate", "time_since_last_user_activity", "user_failure_ratio", "velocity_5"]
    base = events(spark, sf)
    df = written(f.extract_features(base, numeric=["duration"]).select("event_id", "timestamp", *cols))
    params = stat.fit_statistical(df, cols)
    forest = fo.fit_iforest(df, cols, ["event_id"])
    space = recon.fit_reconstruction(df, cols, 2)
    scored = stat.explain_statistical(stat.score_statistical(df, params, name="statistical"), params, )
    scored = fo.explain_iforest(fo.score_iforest(scored, forest, "isolation_forest"), params, "forest_why")
    scored = recon.explain_reconstruction(recon.score_reconstruction(scored, space, "autoencoder"), space, "recon_why")
    found = e.detect(scored, ["statistical", "isolation_forest", "autoencoder"], threshold=0.5, explanations={
        "statistical": "explanation", "isolation_forest": "forest_why", "autoencoder": "recon_why"})
    found = written(found.select("event_id", "timestamp", "anomaly_score", "detection_method", "confidence", "explanation"))
    near = joins.related_events(found, df.select("event_id", "timestamp")).groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "related_id"))).alias("r"))
    return found.join(near, "event_id", "left").select(
        "event_id", R("anomaly_score"), severity("anomaly_score").alias("severity"), "detection_method", R("confidence"),
        F.to_json("explanation").alias("explanation"), F.array_join(F.col("r.related_id").cast("array<string>"), ",").alias("related_events"))


@query("M21_event_facts", """SELECT true AS above_threshold, true AS severity_follows_score, true AS at_most_five_related, true AS some_found""")
def event_facts(spark, sf):
    """What every detection must satisfy, whatever the forest drew."""
    out = detect_events(spark, sf)
    steps = F.when(F.col("anomaly_score") >= 0.95, "critical").when(F.col("anomaly_score") >= 0.85, "high").when(
        F.col("anomaly_score") >= 0.7, "medium").otherwise("low")
    return out.agg(F.bool_and(F.col("anomaly_score") > 0.5 - 1e-6).alias("above_threshold"),
                   F.bool_and(F.col("severity") == steps).alias("severity_follows_score"),
                   F.bool_and(F.size(F.split("related_events", ",")) <= 5).alias("at_most_five_related"),
                   (F.count(F.lit(1)) > 0).alias("some_found"))
