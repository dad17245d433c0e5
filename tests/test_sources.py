"""File readers and small operators on hand-made inputs."""

import datetime
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F, types as T

from logwarden.operators import collect, joins, ordered, triage
from logwarden.operators.quantiles import quantiles
from logwarden.sources import files
from logwarden.streaming import streams

REC = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_keeps_records_with_odd_types(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":"k1","n":1}\n{"a":"k2","n":"abc"}\n{"a":"k3","n":\nplain\n\n[1]\n')
    assert rows(files.read_json(spark, str(tmp_path), REC)) == [("k1", 1), ("k2", None)]
    kept = files.read_json(spark, str(tmp_path), REC, keep_bad=True)
    assert kept.filter("_corrupt is not null").count() == 3


def test_json_arrays_over_lines(spark, tmp_path):
    (tmp_path / "whole.json").write_text('[\n{"a":"x","n":1},\n{"a":"y","n":2}\n]\n')
    (tmp_path / "lines.json").write_text('[{"a":"z","n":3}]\n[{"a":"w","n":4},{"a":"v","n":5}]\n')
    assert rows(files.read_json(spark, str(tmp_path), REC, array=True)) == [("v", 5), ("w", 4), ("x", 1), ("y", 2), ("z", 3)]


ARRAYS = {"behind.json": '[{"a":"x","n":1},\n{"a":"y","n":2},\n{"a":"z","n":3}]', "blank.json": '\n \t\n[ {"a":"u","n":4}\n,{"a":"v","n":5} ]\n',
          "a b+%.json": '[\n  {\n    "a": "p",\n    "n": 6\n  },\n  {\n    "a": "q",\n    "n": 7\n  }\n]\n',
          "lines.json": '{"a":"l","n":8}\n[{"a":"m","n":9},\n{"a":"k","n":10}\n',
          "cut.json": '[{"a":"lost","n":\n[{"a":"r","n":11}]\r\n{"a":"s","n":12}\n', "two.json": '[{"a":"c","n":\n13}]\n[{"a":"d","n":14}]\n'}
RECORDS = [("d", 14), ("k", 10), ("l", 8), ("p", 6), ("q", 7), ("r", 11), ("s", 12), ("u", 4), ("v", 5), ("x", 1), ("y", 2), ("z", 3)]


def test_json_arrays_over_lines_in_every_layout(spark, tmp_path):
    for name, text in ARRAYS.items():
        (tmp_path / name).write_bytes(text.encode())
    assert rows(files.read_json(spark, str(tmp_path), REC, array=True)) == RECORDS
    assert rows(files.read_json(spark, str(tmp_path), REC)) == RECORDS
    assert rows(files.read_many(spark, {"json": [str(tmp_path)]}, REC)) == RECORDS
    kept = files.read_json(spark, str(tmp_path), REC, keep_bad=True).filter("_corrupt is not null")
    assert sorted(r._corrupt for r in kept.collect()) == ['13}]', '[{"a":"c","n":', '[{"a":"lost","n":', '[{"a":"m","n":9},']


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,b,a\n1,q,k\nbad,q,l\n")
    assert rows(files.read_csv(spark, str(tmp_path), REC)) == [("k", 1), ("l", None)]


def test_tail_reads_appended_and_truncated(spark, tmp_path):
    log, other = tmp_path / "a.log", tmp_path / "b.log"
    log.write_text("one\ntwo\nthr")
    other.write_text("x\n")
    first, at = files.tail_log_dir(spark, str(tmp_path), None, "*.log")
    assert sorted(r.message for r in first.collect()) == ["one", "two", "x"]
    log.write_text("one\ntwo\nthree\n\nfour\n")
    second, at = files.tail_log_dir(spark, str(tmp_path), at, "*.log")
    assert sorted(r.message for r in second.collect()) == ["four", "three"]
    log.write_text("new\n")
    third, at = files.tail_log_dir(spark, str(tmp_path), at, "*.log")
    assert [r.message for r in third.collect()] == ["new"]
    assert files.tail_log_dir(spark, str(tmp_path), at, "*.log")[0].count() == 0


def test_log_dir_has_no_size_limit_by_default(spark, tmp_path):
    (tmp_path / "a.log").write_text("a\n" * 50)
    (tmp_path / "b.log").write_text("b\n")
    assert files.read_log_dir(spark, str(tmp_path)).count() == 51
    assert files.read_log_dir(spark, str(tmp_path), max_bytes=10).count() == 1


def test_read_many_reports_skipped(spark, tmp_path):
    good = tmp_path / "g.json"
    good.write_text('{"a":"k","n":1}\n')
    skipped = []
    out = files.read_many(spark, {"json": [str(good), str(tmp_path / "gone.json")]}, REC, skipped)
    assert rows(out) == [("k", 1)] and [p for p, _ in skipped] == [str(tmp_path / "gone.json")]


@pytest.mark.parametrize("values", [
    [-math.inf, *map(float, range(2000))], [math.inf, -math.inf, -math.inf, math.nan, *map(float, range(500))],
    [5.0] * 100, [-math.inf] * 3, [math.nan, 1.0]])
def test_quantile_paths_agree(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    same = lambda a, b: a == b or math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9
    a, b = quantiles(df, ["x"], qs)["x"], quantiles(df, ["x"], qs, builtin_rows=0)["x"]
    assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_slice_count_follows_rows_and_is_bounded():
    assert ordered.slice_count(10, 200) == 1
    assert ordered.slice_count(10**7, 8) == 32 < ordered.slice_count(10**9, 8) == 1000
    assert ordered.slice_count(10**13, 200) == ordered.MOST_SLICES


def test_hot_and_cold_keys_together(spark, sf):
    from logwarden.operators import behaviour as b
    from logwarden.plans.bindings import events

    hot = events(spark, sf).withColumn("username", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("username")))
    hot = hot.select("event_id", "timestamp", "username", "source_ip", "status")
    for make in (lambda **h: b.failure_streak(hot, "username", **h), lambda **h: b.sessionize(hot, "username", 3600, **h)):
        assert rows(make(mode="plain")) == rows(make(mode="auto", hot_rows=100))


def test_acknowledge_and_updates_keep_history(spark):
    at, old = datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, True, "bob", old, old), (2, False, None, None, None)],
                               "event_id int, acknowledged boolean, acknowledged_by string, acknowledged_at timestamp, updated_at timestamp")
    got = triage.acknowledge(df, df.filter("event_id = 2").select("event_id"), "eve", at).orderBy("event_id").collect()
    assert [(r.acknowledged_by, r.acknowledged_at) for r in got] == [("bob", old), ("eve", at)]
    up = triage.apply_updates(df, spark.createDataFrame([(2, "x")], "event_id int, acknowledged_by string"), "event_id", ["acknowledged_by"], at)
    assert [(r.acknowledged_by, r.updated_at) for r in up.orderBy("event_id").collect()] == [("bob", old), ("x", at)]


def test_rule_keeps_literals(spark):
    df = spark.createDataFrame([("a==b",), ("a=b",)], "url string")
    out = triage.classify(df, [triage.Rule("hit", ["url == 'a==b'"], "high")])
    assert {r.url: r.classification for r in out.collect()} == {"a==b": "hit", "a=b": "unknown_anomaly"}


def test_patterns_run_by_the_engine_that_checks_them(spark):
    df = spark.createDataFrame([("x1",), ("y2",)], "t string")
    assert [r.t for r in collect.filter_patterns(df, [r"(?P<kind>x)\d", "bad("]).collect()] == ["x1"]


@pytest.mark.parametrize("address, allowed", [
    ("10.1.2.3", True), ("10.1.2.4", False), ("2001:db8::5", False), ("2001:DB8:0:0::5", False), ("2001:db9::1", True), ("junk", False)])
def test_networks_of_both_families(spark, address, allowed):
    df = spark.createDataFrame([(address,)], "source_ip string")
    rules = lambda *r: spark.createDataFrame([(x,) for x in r], "cidr string")
    got = joins.ip_allowed(df, rules("10.0.0.0/8", "2001:db0::/28"), rules("10.1.2.4", "2001:db8::/32", "10.1.2.1/24", "x/8")).first()
    assert got.allowed is allowed


def test_stream_metrics_over_many_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(103):
        (source / f"{i:03}.json").write_text(f'{{"status":"{"failure" if i % 2 else "ok"}","timestamp":{i}}}\n')
    sdf = spark.readStream.schema("status string, timestamp double").option("maxFilesPerTrigger", 1).json(str(source))
    out = streams.run_metrics(sdf, F.col("status") == "failure", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.agg(F.sum("processed"), F.sum("errors"), F.max("last_timestamp")).first()[:] == (103, 51, 102.0)
    assert out.count() == 103


def test_forest_runs_from_another_folder(tmp_path):
    """Functions must reach the workers by value: the driver alone knows where the package is."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from logwarden import local_session
from logwarden.operators import forest
spark = local_session("2", 2, "2g")
df = spark.range(300).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 11 as double) b")
print("rows", forest.score_iforest(df, forest.fit_iforest(df, ["a", "b"], ["id"], trees=5)).count())
"""
    root = files.__file__.rsplit("/logwarden/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 300" in done.stdout, done.stderr[-2000:]
