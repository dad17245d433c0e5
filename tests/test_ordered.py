"""Sliced scans equal plain windows, also with a hot key, few rows per slice and null keys."""

import pytest
from pyspark.sql import Window as W, functions as F

from logwarden.operators import behaviour as b
from logwarden.operators.ordered import arrange
from logwarden.operators.quantiles import quantiles
from logwarden.plans.bindings import events, table


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark, sf):
    """A third of the rows share one key; some keys are null."""
    user = F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 17 == 1, None).otherwise(F.col("username"))
    return events(spark, sf).withColumn("username", user).cache()


@pytest.mark.parametrize("key", [["username"], []])
@pytest.mark.parametrize("slices", [5, 60])
def test_scan(hot, key, slices):
    fail = F.when(F.col("action") == "error", F.col("timestamp"))
    o = arrange(hot, key, ["timestamp", "event_id"], mode="sliced", slices=slices)
    o.lag(a=("timestamp", 1), z=("timestamp", 20), k=("action", 2))
    o.running(n=("count", F.lit(1)), s=("sum", F.col("duration")), hi=("max", F.col("duration")),
              lo=("min", F.col("duration")), last=("last", fail))
    cols = ["event_id", "a", "z", "n", "s", "hi", "lo"]
    w = W.partitionBy(*key).orderBy("timestamp", "event_id")
    u = w.rowsBetween(W.unboundedPreceding, 0)
    want = hot.withColumns({
        "a": F.lag("timestamp").over(w), "z": F.lag("timestamp", 20).over(w), "k": F.lag("action", 2).over(w),
        "n": F.count(F.lit(1)).over(u), "s": F.sum("duration").over(u), "hi": F.max("duration").over(u),
        "lo": F.min("duration").over(u), "last": F.last(fail, True).over(u)})
    fill = lambda df: df.select(*[F.coalesce(F.col(c), F.lit(-1)) for c in cols + ["last"]], F.coalesce("k", F.lit("")))
    assert rows(fill(o.done())) == rows(fill(want))


@pytest.mark.parametrize("make", [
    lambda d, **h: b.failure_streak(d, "username", **h),
    lambda d, **h: b.sessionize(d, "username", 3600, **h),
    lambda d, **h: b.switched(d, "username", "source_ip", **h),
    lambda d, **h: b.running_count(d, "username", **h),
    lambda d, **h: b.velocity(d, [5, 20], "username", **h),
])
def test_behaviour_modes_agree(hot, make):
    known = hot.filter("username is not null").select("event_id", "timestamp", "username", "source_ip", "status")
    assert rows(make(known, mode="plain")) == rows(make(known, mode="sliced", slices=23))


def test_streak_example(spark):
    df = spark.createDataFrame([(i, float(i), ip, st) for i, (ip, st) in enumerate(
        [("A", "failure"), ("A", "denied"), ("B", "error"), ("A", "failed"), ("A", "success")])],
        "event_id bigint, timestamp double, source_ip string, status string")
    take = lambda mode, **h: [r[0] for r in b.failure_streak(df, "source_ip", mode, **h).orderBy("event_id")
                              .select("consecutive_failures").collect()]
    assert take("global", slices=3) == [1, 2, 1, 1, 0]
    assert take("entity") == [1, 2, 1, 3, 0]


def test_sessions_example(spark):
    times = [0, 10, 20, 80, 90, 600]
    df = spark.createDataFrame([(i, 1000.0 + t, "u", "x") for i, t in enumerate(times)],
                               "event_id bigint, timestamp double, username string, action string")
    got = b.sessionize(df, "username").orderBy("event_id").select("session_count", "actions_in_session", "session_duration")
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0.0), (1, 2, 10.0), (1, 3, 20.0), (2, 1, 0.0), (2, 2, 10.0), (3, 1, 0.0)]


def brute_windows(times, limit, window):
    out, start, used = [], None, 0
    for t in times:
        if start is None or t - start > window:
            start, used = t, 0
        used += 1
        out.append((start, used, used > limit))
    return out


@pytest.mark.parametrize("segment_rows", [10**6, 0])
def test_rate_limit(hot, segment_rows):
    """Folding and pointer doubling both equal a sequential pass."""
    df = hot.filter("username in ('hot', 'user1', 'user2')").select("event_id", "timestamp", "username")
    got = b.rate_limit(df, "username", 3, 20_000, segment_rows=segment_rows).orderBy("username", "timestamp", "event_id").collect()
    for user in {r["username"] for r in got}:
        mine = [r for r in got if r["username"] == user]
        want = brute_windows([r["timestamp"] for r in mine], 3, 20_000)
        assert [(r["window_start"], r["requests"], r["limited"]) for r in mine] == want


def test_selected_quantiles_equal_builtin(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("same", F.lit(3.0)).withColumn(
        "gaps", F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice")))
    cols, qs = ["l_quantity", "l_extendedprice", "same", "gaps"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    want = quantiles(df, cols, qs)
    got = quantiles(df, cols, qs, builtin_rows=0)
    for c in cols:
        assert got[c] == pytest.approx(want[c], abs=1e-9)


def test_no_single_task_window(spark, sf):
    """Stream-order features never plan a window without a partition."""
    for df in (b.global_delta(events(spark, sf)), b.velocity(events(spark, sf), [5])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.split("Window")[0]
        assert "_slice" in plan


@pytest.mark.parametrize("shape", ["uniform", "skewed", "ties", "tiny steps"])
def test_quantiles_take_three_passes_at_most(spark, monkeypatch, shape):
    """The sketch's brackets hold the ranks, so one exact count inside them does, or two."""
    from logwarden.operators import quantiles as q

    monkeypatch.setattr(q, "DIRECT_ROWS", 200)
    x = {"uniform": "rand(5)", "skewed": "exp(20 * rand(5))", "ties": "cast(rand(5) * 7 as int)", "tiny steps": "1 + id * 2e-16"}[shape]
    df = spark.range(150_000).selectExpr(f"cast({x} as double) as x", "cast(id % 1000 as double) as y").cache()
    qs, passes = [0.01, 0.25, 0.5, 0.999], []
    collect = q._disjoint
    monkeypatch.setattr(q, "_disjoint", lambda b: passes.append(1) or collect(b))
    got = q.quantiles(df, ["x", "y"], qs)
    rows = sorted(r.x for r in df.select("x").collect())
    at = [p * (len(rows) - 1) for p in qs]
    want = [rows[int(a)] + (a - int(a)) * (rows[min(int(a) + 1, len(rows) - 1)] - rows[int(a)]) for a in at]
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got["x"], want)) and len(passes) <= 2


def test_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    from logwarden.operators import quantiles as q

    df = spark.range(2000).selectExpr("cast(id as double) as x")
    monkeypatch.setattr(q, "MARGIN", -0.3)
    assert q.quantiles(df, ["x"], [0.5], builtin_rows=0)["x"] == [999.5]
