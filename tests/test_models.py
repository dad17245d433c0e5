"""Forest, reconstruction and detector properties, recomputed outside Spark on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.operators import forest as fo, joins, recon, stat
from logwarden.plans.bindings import FEATURES, detections, events, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@pytest.fixture(scope="module")
def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*KEY, *FEATURES).limit(1000).cache()


def walk(nodes, x):
    """Path length of one row through one tree, straight from the node table."""
    at = {r["node"]: r for r in nodes}
    node = at[0]
    while node["split"] >= 0:
        node = at[node["left_node"] if x[node["split"]] < node["cut"] else node["right_node"]]
    return node["depth"] + float(fo.average_path(node["size"]))


def test_forest_scores(lines):
    forest = fo.fit_iforest(lines, FEATURES, KEY, trees=20)
    again = fo.fit_iforest(lines, FEATURES, KEY, trees=20)
    assert forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        again.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    sizes = forest.nodes[forest.nodes["split"] < 0].groupby("tree")["size"].sum()
    assert len(sizes) == 20 and (sizes == 256).all()
    trees = [g.to_dict("records") for _, g in forest.nodes.groupby("tree")]
    got = fo.score_iforest(lines, forest).select(*FEATURES, "forest_score").limit(40).collect()
    for r in got:
        x = [r[f] for f in FEATURES]
        s = 2 ** (-np.mean([walk(t, x) for t in trees]) / float(fo.average_path(256)))
        assert r["forest_score"] == pytest.approx((1 + s - 0.5) / 2, abs=1e-9) and 0 <= r["forest_score"] <= 1


@pytest.mark.parametrize("trees, sample, width, block", [(40, 256, 4, 1 << 20), (9, 256, 3, 4096), (3, 1, 2, 4096), (5, 2, 2, 4096), (2, 3000, 4, 4096)])
def test_scores_equal_the_walk(trees, sample, width, block, monkeypatch):
    """Masks give the leaves of the walk, bit by bit, also on cuts and beyond all of them; a huge tree is walked."""
    monkeypatch.setattr(fo, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3500, width)), 1 if width == 3 else 9)
    forests = []
    for seed in (1, 2):
        rows = [(t, *n) for t in range(trees) for n in fo.grow(x[rng.choice(len(x), sample, replace=False)], np.random.default_rng([seed, t]), 8 if sample < 1000 else 20, np.arange(seed % 2, width))]
        nodes = fo.pd.DataFrame(rows, columns=["tree", "node", "split", "cut", "left_node", "right_node", "size", "depth"])
        forests.append(fo._assemble(nodes, [f"c{i}" for i in range(width)], sample))
    cuts = np.concatenate([f.cut[np.isfinite(f.cut)] for f in forests])[:200]
    x[:len(cuts)] = cuts[:, None]
    x[-2:] = [[1e300], [-1e300]]
    scorer = fo.Scorer(forests)
    assert bool(scorer.walked) == (sample == 3000)
    got = scorer.depth_scores(x)
    for i, f in enumerate(forests):
        assert (got[:, i] == f.scaled(f.walked(x))).all()


def test_quantiles_from_a_thin_sketch(spark, monkeypatch):
    from logwarden.operators import quantiles as q

    monkeypatch.setattr(q, "SKETCH_ROWS", 50)
    df = spark.range(3000).select((F.col("id") * 7 % 3000 / 10).alias("a"), F.when(F.col("id") < 5, F.col("id").cast("double")).alias("b"))
    want = df.select(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.9))).alias(c) for c in "ab"]).first()
    got = q.quantiles(df, ["a", "b"], [0.05, 0.9], builtin_rows=10, rows=3000)
    assert got["a"] == pytest.approx(want["a"]) and got["b"] == pytest.approx(want["b"])


def test_forest_contamination(lines):
    forest = fo.fit_iforest(lines, FEATURES, KEY, trees=20, contamination=0.1)
    share = fo.score_iforest(lines, forest).agg(F.avg((F.col("forest_score") > 0.5).cast("int"))).first()[0]
    assert share == pytest.approx(0.1, abs=0.01)


def test_shifted_rows_score_higher(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, row)) for i, row in enumerate(np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(5, 1, (10, 4))]))]
    cols = ["f1", "f2", "f3", "f4"]
    df = spark.createDataFrame(data, ["id", *cols])
    train = df.filter("id < 300")
    params = stat.fit_statistical(train, cols)
    scored = stat.score_statistical(df, params)
    ranks = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(10).collect()]
    assert sum(i >= 300 for i in ranks) >= 9
    assert scored.agg(F.max("anomaly_score")).first()[0] == pytest.approx(1.0)
    forest = fo.fit_iforest(train, cols, ["id"])
    mean = {r["far"]: r["m"] for r in fo.score_iforest(df, forest).groupBy((F.col("id") >= 300).alias("far")).agg(
        F.avg("forest_score").alias("m")).collect()}
    assert mean[True] > mean[False] + 0.05


def test_explanations_sum_to_one(lines):
    params = stat.fit_statistical(lines, FEATURES)
    space = recon.fit_reconstruction(lines, FEATURES, 2)
    for df in (stat.explain_statistical(lines, params), fo.explain_iforest(lines, params), recon.explain_reconstruction(lines, space)):
        total = F.aggregate(F.map_values("explanation"), F.lit(0.0), lambda a, x: a + x)
        low, high = df.agg(F.min(total), F.max(total)).first()
        assert low == pytest.approx(1.0) and high == pytest.approx(1.0)


def test_reconstruction_equals_numpy(lines):
    space = recon.fit_reconstruction(lines, FEATURES, 2)
    x = np.array([[r[f] for f in FEATURES] for r in lines.collect()])
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    error = ((z - z @ vt[:2].T @ vt[:2]) ** 2).mean(1)
    want = 1 / (1 + np.exp(-(error - error.mean()) / error.std()))
    got = [r.recon_score for r in recon.score_reconstruction(lines, space).collect()]
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-6)
    back = recon.reconstruct(lines, recon.fit_reconstruction(lines, FEATURES, 4)).first()
    assert back["recon_l_quantity"] == pytest.approx(back["l_quantity"], abs=1e-6)


def test_wide_reconstruction_equals_narrow(lines, monkeypatch):
    space = recon.fit_reconstruction(lines, FEATURES, 2)
    narrow = recon.explain_reconstruction(recon.score_reconstruction(lines, space), space).select("recon_score", "explanation").collect()
    monkeypatch.setattr(recon, "WIDE", 2)
    wide = recon.explain_reconstruction(recon.score_reconstruction(lines, space), space).select("recon_score", "explanation").collect()
    assert sorted(r.recon_score for r in wide) == pytest.approx(sorted(r.recon_score for r in narrow))


def test_related_events(spark, sf):
    """Against a nested loop; every anomaly has one to five others."""
    ev = sorted((r.timestamp, r.event_id) for r in events(spark, sf).select("timestamp", "event_id").collect())
    hits = detections(spark, sf).filter("anomaly_score > 0.8").select("event_id", "timestamp")
    got: dict = {}
    for r in joins.related_events(hits, events(spark, sf), 900, 5, slices=11).orderBy("event_id", "place").collect():
        got.setdefault(r.event_id, []).append(r.related_id)
    for h in hits.collect():
        near = [i for t, i in ev if abs(t - h.timestamp) <= 900 and i != h.event_id][:5]
        if not near:
            p = ev.index((h.timestamp, h.event_id))
            near = [ev[q][1] for q in range(max(0, p - 2), min(len(ev), p + 3)) if q != p]
        assert got[h.event_id] == near


def test_related_events_in_one_instant(spark):
    """Many events at the same time: still five per anomaly, no pairwise blow-up."""
    df = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1000.0).alias("timestamp"))
    out = joins.related_events(df.filter("event_id >= 2990"), df, 300, 5)
    assert out.count() == 50 and {r.related_id for r in out.collect()} == {0, 1, 2, 3, 4}


def test_plans_have_no_nested_loop(spark, sf):
    import __spark_entry__ as entry

    for name in ("J01_related_events", "J04_cidr_match", "J05_ioc_match", "J06_recommend_playbooks", "R07_correlation_rule"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_filters_reach_the_scan(spark, sf):
    import __spark_entry__ as entry

    for name in ("J08_search_window_lookup", "A15_apply_retention", "Q01_filter_detections"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan, name


def scores_of(spark, n, models, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    label = rng.random(n) < 0.3
    x = np.clip(0.5 * rng.random((n, models)) + label[:, None] * rng.random((n, models)) * np.linspace(0.1, 0.6, models), 0, 1)
    # Ties, rows that never flip, and rows whose scores are equal.
    x[:n // 4] = np.round(x[:n // 4], 1)
    x[:10] = 0.5
    names = [f"m{k}" for k in range(models)]
    rows = [(*map(float, r), int(y)) for r, y in zip(x, label)]
    return spark.createDataFrame(rows, ", ".join(f"{m} double" for m in names) + ", label int").repartition(3).cache(), names, x, label


def f1_at(x, label, w, threshold=0.5):
    hit = sum(x[:, k] * v for k, v in enumerate(w)) >= threshold
    tp = (hit & label).sum()
    return 2 * tp / (hit.sum() + label.sum())


def test_sweep_finds_the_best_weight_on_a_line(spark):
    from logwarden.operators import ensemble as e

    df, names, x, label = scores_of(spark, 400, 2, 3)
    f1, weights = e.sweep_line(df, names, [0.5, 0.5], 0, 1, "label", 0.5)
    dense = max(f1_at(x, label, (t, 1 - t)) for t in [i / 5000 for i in range(5001)])
    assert f1 >= dense - 1e-12 and abs(f1_at(x, label, weights) - f1) < 0.02 and abs(sum(weights) - 1) < 1e-12


def test_sweeps_are_never_below_the_grid(spark):
    from logwarden.operators import ensemble as e

    df, names, x, label = scores_of(spark, 300, 6, 4)
    grid = max(e.simplex(6, 0.25), key=lambda w: f1_at(x, label, w))
    row = e.sweep_weights(df, names, start=list(grid), rounds=1).first()
    assert row.f1 >= f1_at(x, label, grid) and abs(f1_at(x, label, row[:-1]) - row.f1) < 1e-12 and abs(sum(row[:-1]) - 1) < 1e-9
    free = e.sweep_weights(df.select("m0", "m5", "label"), ["m0", "m5"], rounds=1).first()
    assert free.f1 >= max(f1_at(x[:, [0, 5]], label, w) for w in e.simplex(2, 0.1)) - 0.01


def test_samples_larger_than_the_pool(spark, monkeypatch):
    from logwarden.operators import forest

    monkeypatch.setattr(forest, "POOL", 1000)
    df = spark.range(20_000).selectExpr("id", "cast(id % 97 as double) a", "cast(id % 89 as double) b")
    drawn = forest.tree_samples(df, ["a", "b"], ["id"], 2, 1500, 20_000, 7).groupBy("tree").count().collect()
    assert [r["count"] for r in drawn] == [1500, 1500]


def test_whole_groups_for_functions_that_are_not_mergeable(spark):
    from logwarden.operators import grouped

    df = spark.range(1000).selectExpr("id", "id % 2 as g")
    median = lambda pdf: pdf.groupby("g", as_index=False).agg(m=("id", "median"))
    assert sorted(tuple(r) for r in grouped.apply_groups(df, ["g"], median, "g bigint, m double").collect()) == [(0, 499.0), (1, 500.0)]
