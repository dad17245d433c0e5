"""Tables published by manifests: batches that fail and repeat, upserts, folding, and streams on top of them."""

import json

import pytest
from pyspark.sql import functions as F

from logwarden.sources.tables import BatchLog, Commits, UpsertTable
from logwarden.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, tmp_path, **how):
    return UpsertTable(spark, str(tmp_path / "t"), "id", "id int, a string, b string", buckets=4, **how)


def frame(spark, data, schema="id int, a string, b string"):
    return spark.createDataFrame(data, schema)


def test_upsert_partial_whole_and_delete(spark, tmp_path):
    t = table(spark, tmp_path, spread=2)
    assert t.read().count() == 0
    t.merge(frame(spark, [(i, f"a{i}", f"b{i}") for i in range(20)]))
    t.merge(frame(spark, [(1, None, "new"), (99, "x", None), (None, "lost", "lost")]))
    t.merge(frame(spark, [(2, None, "whole")]), partial=False)
    t.delete(frame(spark, [(i,) for i in range(5, 20)], "id int"))
    assert rows(t.read()) == sorted([(0, "a0", "b0"), (1, "a1", "new"), (2, None, "whole"), (3, "a3", "b3"), (4, "a4", "b4"), (99, "x", None)], key=str)
    t.delete(t.read())
    assert t.read().count() == 0 and t.commits.load()[1]["parts"] == {}


def test_changes_of_one_key_count_in_order(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(frame(spark, [(1, "old", "old"), (2, "old", "old"), (3, "old", "old"), (4, "old", "old")]))
    changes = frame(spark, [(3, 1, None, "third", False), (1, 1, "first", None, False), (2, 1, "second", None, False), (1, 2, "gone", None, True),
                            (1, 3, None, None, True), (2, 3, "back", None, False), (5, 4, "last", None, False), (5, 5, None, None, True)],
                    "n int, id int, a string, b string, del boolean")
    t.merge(changes, order="n", deleted="del", defaults={"b": "none"})
    assert rows(t.read()) == [(1, "second", "third"), (3, "back", "none"), (4, "last", "old")]


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(frame(spark, [(i, "a", "b") for i in range(40)]))
    before = t.commits.load()[1]["parts"]
    t.merge(frame(spark, [(7, "x", None)]))
    after = t.commits.load()[1]["parts"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    t.vacuum()
    assert set(t.commits.folders()) == set(after.values()) and t.read().count() == 40


def test_a_writer_that_dies_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(frame(spark, [(1, "a", "b")]), writer="w", batch=0)
    publish = Commits.publish
    monkeypatch.setattr(Commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.merge(frame(spark, [(1, "half", None), (2, "half", None)]), writer="w", batch=1)
    monkeypatch.setattr(Commits, "publish", publish)
    assert rows(t.read()) == [(1, "a", "b")]
    for _ in range(2):
        t.merge(frame(spark, [(1, "whole", None), (2, "whole", None)]), writer="w", batch=1)
        assert rows(t.read()) == [(1, "whole", "b"), (2, "whole", None)]
    assert t.commits.load()[0] == 2
    with pytest.raises(RuntimeError):
        t.commits.publish(2, {})


def test_log_batch_is_committed_once(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path / "log"), partition_by=["day"])
    assert log.read() is None
    data = frame(spark, [(1, "2024-01-01"), (2, "2024-01-02")], "id int, day string").withColumn("day", F.to_date("day"))
    publish = Commits.publish
    monkeypatch.setattr(Commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.append(data, "w", 0)
    assert log.read() is None
    monkeypatch.setattr(Commits, "publish", publish)
    assert log.append(data, "w", 0) and not log.append(data, "w", 0) and log.append(data, "other", 0)
    assert log.read().count() == 4 and log.read().filter("day = date '2024-01-02'").count() == 2


def test_parts_stay_few_over_many_batches(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), fold=streams.newest(["k"]), fanout=4)
    most = 0
    for n in range(200):
        log.append(spark.createDataFrame([(n % 5, n, n)], "k int, v int, _batch int").coalesce(1), "w", n)
        most = max(most, len(log.parts()))
    assert most <= 4 * 4 and len(log.commits.folders()) <= 5 * 4
    assert rows(streams.latest(spark, str(tmp_path / "log"), ["k"])) == [(k, 195 + k) for k in range(5)]


def stream_of(spark, tmp_path, batches, schema):
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate(batches):
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))


def test_features_of_a_hot_user_are_sliced(spark, tmp_path):
    """The same rows whether a user's rows fit one task or are cut into slices, over batches."""
    data = [{"event_id": i, "username": "hot" if i % 3 else f"u{i % 5}", "timestamp": 100.0 + 7 * i, "status": "failure" if i % 5 else "ok",
             "source_ip": f"ip{i % 4 // 2}"} for i in range(240)]
    sdf = stream_of(spark, tmp_path, [data[:80], data[80:90], data[90:]], "event_id bigint, username string, timestamp double, status string, source_ip string")
    got = []
    for k, how in enumerate([{}, {"hot_rows": 20, "slices": 5}]):
        streams.run_features(sdf, str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}"), **how)
        got.append(rows(streams.features(spark, str(tmp_path / f"out{k}"))))
    assert got[0] == got[1] and len(got[0]) == 240
    # In one batch the features come out the same.
    whole = spark.createDataFrame(data, sdf.schema)
    once = streams.batch_features(whole, UpsertTable(spark, str(tmp_path / "none"), "username", streams.USER_STATE).read())
    assert rows(once.drop("t", "rank", "source_ip", "_new")) == got[0]


def test_features_after_a_failure_between_rows_and_state(spark, tmp_path, monkeypatch):
    data = [{"event_id": i, "username": f"u{i % 2}", "timestamp": float(i), "status": "failure", "source_ip": "a"} for i in range(12)]
    sdf = stream_of(spark, tmp_path, [data[:6], data[6:]], "event_id bigint, username string, timestamp double, status string, source_ip string")
    merge, calls = UpsertTable.merge, []

    def dies(self, *a, **k):
        calls.append(k.get("batch"))
        if calls == [0, 1]:
            raise OSError("lost")
        return merge(self, *a, **k)

    monkeypatch.setattr(UpsertTable, "merge", dies)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    with pytest.raises(Exception):
        streams.run_features(sdf, out, ck)
    streams.run_features(sdf, out, ck)
    got = {r.event_id: r for r in streams.features(spark, out).collect()}
    assert calls == [0, 1, 1] and len(got) == 12 and all(got[i].seen == i // 2 and got[i].username_streak == i // 2 + 1 for i in got)


def test_rate_limit_goes_on_over_batches(spark, tmp_path):
    times = {"a": [0, 10, 59, 60, 61, 62, 200], "b": [5, 64, 66, 130], "late": [100, 150]}
    data = sorted(({"event_id": 100 * j + i, "client": c, "timestamp": float(t)} for j, (c, ts) in enumerate(times.items()) for i, t in enumerate(ts)),
                  key=lambda r: r["timestamp"])
    late = {"event_id": 999, "client": "late", "timestamp": 20.0}
    sdf = stream_of(spark, tmp_path, [data[:3], data[3:5], data[5:], [late]], "event_id bigint, client string, timestamp double")
    streams.run_rate_limit(sdf, "client", 2, 60.0, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.event_id: (r.window_start, r.requests, r.limited, r.retry_after) for r in streams.limited(spark, str(tmp_path / "out")).collect()}
    assert got == {0: (0, 1, False, None), 1: (0, 2, False, None), 2: (0, 3, True, 1), 3: (0, 4, True, 0), 4: (61, 1, False, None),
                   5: (61, 2, False, None), 6: (200, 1, False, None), 100: (5, 1, False, None), 101: (5, 2, False, None), 102: (66, 1, False, None),
                   103: (130, 1, False, None), 200: (100, 1, False, None), 201: (100, 2, False, None), 999: (100, 3, True, 10)}
    clients = UpsertTable(spark, str(tmp_path / "out" / "clients"), "client", "client string, start double, requests bigint, last double")
    assert rows(clients.read().select("client")) == [("a",)]


def test_metrics_are_taken_while_rows_are_written(spark, tmp_path):
    data = [{"status": "failure" if i % 3 else "ok", "timestamp": float(i)} for i in range(30)]
    sdf = stream_of(spark, tmp_path, [data[:10], data[10:11], data[11:]], "status string, timestamp double")
    out = streams.run_metrics(sdf, F.col("status") == "failure", str(tmp_path / "m"), str(tmp_path / "ck"), str(tmp_path / "rows"))
    assert rows(out) == [(0, 10, 6, 9.0), (1, 1, 1, 10.0), (2, 19, 13, 29.0)]
    assert BatchLog(spark, str(tmp_path / "rows")).read().count() == 30
