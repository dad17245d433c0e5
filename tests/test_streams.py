"""Stateful stream features over several batches, with a hot user and late rows."""

import json

from logwarden.streaming import streams


def test_features_over_batches_with_hot_user_and_late_rows(spark, tmp_path):
    source, rows = tmp_path / "in", []
    source.mkdir()
    for i in range(300):
        user = "hot" if i % 3 == 0 else f"u{i % 7}"
        rows.append({"event_id": i, "username": user, "t": 1_700_000_000 + 10 * i, "status": "failure" if i % 4 else "success", "source_ip": f"ip{i % 2}"})
    late = {"event_id": 900, "username": "hot", "t": 1_700_000_000 + 1500, "status": "failure", "source_ip": "ip0"}
    for k in range(3):
        part = rows[100 * k:100 * k + 100] + ([late] if k == 2 else [])
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    sdf = spark.readStream.schema("event_id bigint, username string, t bigint, status string, source_ip string").option(
        "maxFilesPerTrigger", 1).json(str(source))
    sdf = sdf.selectExpr("event_id", "username", "timestamp_seconds(t) AS ts", "cast(t AS double) AS timestamp", "status", "source_ip")
    streams.run_features(sdf, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.event_id: r for r in streams.features(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 301
    state: dict = {}
    for r in rows[:200]:
        last, seen, streak, ip = state.get(r["username"], (None, 0, 0, None))
        streak = streak + 1 if r["status"] == "failure" else 0
        g = got[r["event_id"]]
        assert g.time_since_last == (0 if last is None else r["t"] - last) and g.seen == seen and g.username_streak == streak
        assert g.switched == int(ip is not None and ip != r["source_ip"])
        state[r["username"]] = (r["t"], seen + 1, streak, r["source_ip"])
    assert got[900].time_since_last == 0 and min(r.time_since_last for r in got.values()) >= 0
    assert max(r.seen for r in got.values() if r.username == "hot") == 100
