"""The event stream, run until everything available is processed."""

from pyspark.sql import functions as F

from logwarden.operators import stat
from logwarden.plans.behaviour_queries import ANCHORED_SQL
from logwarden.plans.bindings import EV, LINES, event_batches, event_stream, events, line_frame, lines
from logwarden.plans.parsing_queries import MIXED, YEAR
from logwarden.plans.registry import query
from logwarden.session import scratch_path
from logwarden.sources import files
from logwarden.sources.tables import BatchLog, UpsertTable
from logwarden.streaming import streams as s

R = lambda c: F.round(F.col(c), 6).alias(c)


@query("T01_stream_normalize", f"""WITH {EV} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc3164'
    WHEN 2 THEN 'cef' WHEN 3 THEN 'weblog' WHEN 4 THEN 'json' END AS _format, CASE WHEN event_id % 6 <> 5 THEN source_ip END AS source_ip,
  CASE WHEN event_id % 6 < 2 THEN 'host' || (user_id % 20) END AS hostname, event_id % 6 <> 5 AS _normalized FROM ev""")
def stream_normalize(spark, sf):
    raw = line_frame(event_stream(spark, sf)).select("event_id", F.expr(MIXED).alias("message"))
    out = s.stream_normalize(raw, year=YEAR, json_mapping={"ts": "timestamp", "src": "source_ip", "who": "user"})
    path, checkpoint = s.new_place(spark)
    s.run_available(out.select("event_id", "_format", "source_ip", "hostname", "_normalized"), path, checkpoint)
    return spark.read.parquet(path)


@query("T02_stream_features", f"""WITH {EV}, f AS (SELECT *, CAST(status = 'failure' AS INT) AS fail FROM ev),
c AS (SELECT *, sum(1 - fail) OVER w AS grp, lag("timestamp") OVER o AS p1, lag("timestamp", 5) OVER o AS p5,
  lag("timestamp", 20) OVER o AS p20, lag(source_ip) OVER o AS pa, row_number() OVER o - 1 AS seen FROM f
  WINDOW w AS (PARTITION BY username ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING),
    o AS (PARTITION BY username ORDER BY "timestamp", event_id))
SELECT event_id, username, round(coalesce("timestamp" - p1, 0), 6) AS time_since_last, seen,
  CAST(sum(fail) OVER (PARTITION BY username, grp ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS username_streak,
  CAST(pa IS NOT NULL AND pa <> source_ip AS BIGINT) AS switched,
  round(CASE WHEN p5 IS NULL THEN 0 ELSE 5 / greatest("timestamp" - p5, 1) END, 6) AS velocity_5,
  round(CASE WHEN p20 IS NULL THEN 0 ELSE 20 / greatest("timestamp" - p20, 1) END, 6) AS velocity_20
FROM c""")
def stream_features(spark, sf):
    """The events come in several batches, one after the other in time."""
    sdf = event_batches(spark, sf).select("event_id", "username", "ts", "timestamp", "status", "source_ip")
    path, checkpoint = s.new_place(spark)
    s.run_features(sdf, path, checkpoint)
    return s.features(spark, path).select("event_id", "username", R("time_since_last"), "seen", "username_streak", "switched",
                                           R("velocity_5"), R("velocity_20"))


@query("T03_stream_detect", f"""WITH {EV}, p AS (SELECT avg(duration) AS mu, stddev_pop(duration) AS sd, median(duration) AS med FROM ev),
q AS (SELECT median(abs(duration - med)) * 1.4826 AS mad FROM ev, p),
r AS (SELECT event_id, (abs((duration - mu) / sd) + abs((duration - med) / mad)) / 2 AS raw FROM ev, p, q)
SELECT event_id, round(raw / (SELECT max(raw) FROM r), 6) AS anomaly_score FROM r WHERE raw / (SELECT max(raw) FROM r) > 0.3""")
def stream_detect(spark, sf):
    params = stat.fit_statistical(events(spark, sf), ["duration"], fit_max=True)
    path, checkpoint = s.new_place(spark)
    s.run_available(s.stream_detect(event_stream(spark, sf), params, 0.3).select("event_id", R("anomaly_score")), path, checkpoint)
    return spark.read.parquet(path)


@query("T04_stream_entity_profile", f"""WITH {EV}, k AS (SELECT source_ip, action, count(*) AS n, min("timestamp") AS a, max("timestamp") AS b
  FROM ev GROUP BY 1, 2)
SELECT source_ip, round(min(a), 6) AS first_seen, round(max(b), 6) AS last_seen, CAST(sum(n) AS BIGINT) AS events,
  string_agg(action || ':' || n, ',' ORDER BY action) AS event_types FROM k GROUP BY 1""")
def stream_entity_profile(spark, sf):
    path, checkpoint = s.new_place(spark)
    s.run_updates(s.stream_profile(event_batches(spark, sf)), path, checkpoint, ["source_ip", "action", "period"], fanout=2)
    df = s.merge_profile(s.latest(spark, path, ["source_ip", "action", "period"]))
    kinds = F.transform(F.map_entries("event_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.select("source_ip", R("first_seen"), R("last_seen"), "events", F.array_join(kinds, ",").alias("event_types"))


@query("T05_stream_window_counts", f"""WITH {EV} SELECT username, CAST(floor("timestamp" / 3600) * 3600 AS BIGINT) AS window_start,
  count(*) AS events FROM ev GROUP BY 1, 2""")
def stream_window_counts(spark, sf):
    path, checkpoint = s.new_place(spark)
    s.run_updates(s.stream_counts(event_batches(spark, sf), "username", "1 hour"), path, checkpoint, ["username", "window_start"], fanout=2)
    df = s.latest(spark, path, ["username", "window_start"])
    return df.select("username", F.unix_seconds("window_start").alias("window_start"), "events")


@query("T06_stream_metrics", f"""WITH {EV} SELECT count(*) AS processed, count(*) FILTER (status = 'failure') AS errors,
  round(max("timestamp"), 6) AS last_timestamp FROM ev""")
def stream_metrics(spark, sf):
    path, checkpoint = s.new_place(spark)
    rows = s.run_metrics(event_batches(spark, sf), F.col("status") == "failure", path, checkpoint, f"{path}-rows")
    return rows.agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"),
                    F.round(F.max("last_timestamp"), 6).alias("last_timestamp"))


@query("W14_rate_limit_stream", ANCHORED_SQL)
def rate_limit_stream(spark, sf):
    """Several batches; windows stay open from one to the next."""
    path, checkpoint = s.new_place(spark)
    s.run_rate_limit(event_batches(spark, sf), "username", 3, 86400, path, checkpoint)
    return s.limited(spark, path).select("event_id", R("window_start"), "requests", "limited", "retry_after")


@query("S16_upsert_stream", f"""WITH {EV}, k AS (SELECT username, min_by(action, (ts, event_id)) AS first_action, max_by(action, (ts, event_id)) AS last_action,
  max(event_id) FILTER (status = 'failure') AS last_failure, max_by(status, (ts, event_id)) AS last_status FROM ev GROUP BY 1)
SELECT username, last_action, last_failure FROM k WHERE last_status <> 'failure'""")
def upsert_stream(spark, sf):
    """Each event changes its user's row: the action always, the failure where there is one; a user goes with a failure and comes back
    with the next event, keeping nothing, so the last failure is added from the events afterwards."""
    table = UpsertTable(spark, s.new_place(spark)[0], "username", "username string, last_action string", buckets=4)
    changes = event_batches(spark, sf).select("username", F.col("action").alias("last_action"), (F.col("status") == "failure").alias("gone"),
                                              F.struct("ts", "event_id").alias("at"))
    s.run_upserts(changes, table, s.new_place(spark)[1], deleted="gone", order="at")
    failures = events(spark, sf).filter("status = 'failure'").groupBy("username").agg(F.max("event_id").alias("last_failure"))
    return table.read().join(failures, "username", "left")


@query("S17_results_stream", f"""WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, round(sum(duration), 4) AS total FROM ev GROUP BY 1""")
def results_stream(spark, sf):
    """Two runs with fresh checkpoints: the second delivers every batch again, and none of them counts twice."""
    path, _ = s.new_place(spark)
    for _ in range(2):
        s.run_results(event_batches(spark, sf).select("event_id", "ts", "duration"), path, s.new_place(spark)[1])
    rows = BatchLog(spark, path).read().groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("total"))
    return rows.withColumn("event_date", F.col("event_date").cast("string"))


@query("S07_tail_log_dir", f"""WITH {LINES} SELECT syslog AS message FROM lines""")
def tail_log_dir(spark, sf):
    """Two polls: the second reads on from the positions of the first, so only what was added since."""
    logs, df = scratch_path(spark), lines(spark, sf)
    positions, found = None, []
    for part in (0, 1):
        df.filter(F.col("event_id") % 2 == part).select("syslog").write.mode("append").text(logs)
        fresh, positions = files.tail_log_dir(spark, logs, positions, "*.txt")
        found.append(fresh.select("message"))
    return found[0].unionByName(found[1])


@query("S07_tail_stream", f"""WITH {LINES} SELECT syslog AS message FROM lines""")
def tail_stream(spark, sf):
    """Files that grow between two runs of one stream: the second run reads the bytes that were added."""
    logs, df = scratch_path(spark), lines(spark, sf)
    path, checkpoint = s.new_place(spark)
    for part in (0, 1):
        df.filter(F.col("event_id") % 2 == part).select("syslog").write.mode("append").text(logs)
        s.run_available(files.tail_stream(spark, logs, "*.txt"), path, checkpoint)
    return spark.read.parquet(path).select("message")
