"""Behavioural features of the events."""

from pyspark.sql import functions as F

from logwarden.operators import behaviour as b
from logwarden.plans.bindings import EV, events
from logwarden.plans.registry import query

R = lambda c: F.round(F.col(c), 6).alias(c)
PREV = 'lag("timestamp") OVER (PARTITION BY {k} ORDER BY "timestamp", event_id)'


@query("W01_entity_event_count", f"""WITH {EV}
SELECT event_id, count(*) OVER (PARTITION BY source_ip) AS source_ip_count,
       count(*) OVER (PARTITION BY username) AS username_count FROM ev""")
def entity_event_count(spark, sf):
    df = b.entity_count(b.entity_count(events(spark, sf), "source_ip"), "username")
    return df.select("event_id", "source_ip_count", "username_count")


@query("W02_time_since_last", f"""WITH {EV}
SELECT event_id,
  round(coalesce("timestamp" - {PREV.format(k='source_ip')}, 0), 6) AS since_ip,
  round(coalesce("timestamp" - {PREV.format(k='username')}, 0), 6) AS since_user,
  round(coalesce("timestamp" - {PREV.format(k='action')}, 0), 6) AS since_action FROM ev""")
def time_since_last(spark, sf):
    df = events(spark, sf).select("event_id", "timestamp", "source_ip", "username", "action")
    for key, name in (("source_ip", "since_ip"), ("username", "since_user"), ("action", "since_action")):
        df = b.time_since_last(df, key, name)
    return df.select("event_id", R("since_ip"), R("since_user"), R("since_action"))


@query("W03_entity_event_rate", f"""WITH {EV}
SELECT event_id, round(count(*) OVER w / (greatest(max("timestamp") OVER w - min("timestamp") OVER w, 3600) / 3600), 6)
  AS source_ip_event_rate FROM ev WINDOW w AS (PARTITION BY source_ip)""")
def entity_event_rate(spark, sf):
    return b.event_rate(events(spark, sf), "source_ip").select("event_id", R("source_ip_event_rate"))


@query("W04_value_switched", f"""WITH {EV}, p AS (
  SELECT *, lag(username) OVER (PARTITION BY source_ip ORDER BY "timestamp", event_id) AS prev FROM ev)
SELECT event_id, CAST(prev IS NOT NULL AND prev <> username AS BIGINT) AS username_switched FROM p""")
def value_switched(spark, sf):
    return b.switched(events(spark, sf), "source_ip", "username").select("event_id", "username_switched")


@query("W05_running_count", f"""WITH {EV}
SELECT event_id, row_number() OVER (PARTITION BY action ORDER BY "timestamp", event_id) - 1 AS action_count FROM ev""")
def running_count(spark, sf):
    return b.running_count(events(spark, sf), "action", "action_count").select("event_id", "action_count")


@query("W06_is_failure", f"""WITH {EV}
SELECT event_id, CAST(status IN ('failure', 'failed', 'error', 'denied') AS BIGINT) AS is_failure FROM ev""")
def is_failure(spark, sf):
    return b.failure_flag(events(spark, sf)).select("event_id", "is_failure")


STREAK = """, f AS (SELECT *, CAST(status = 'failure' AS BIGINT) AS fail FROM ev),
c AS (SELECT *, CASE WHEN {change} THEN 1 ELSE 0 END AS chg FROM (
  SELECT *, lag(fail) OVER w AS pf, lag(source_ip) OVER w AS pk FROM f WINDOW w AS ({part} ORDER BY "timestamp", event_id))),
g AS (SELECT *, sum(chg) OVER ({part} ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT event_id, CASE WHEN fail = 1 THEN row_number() OVER (PARTITION BY {isl} ORDER BY "timestamp", event_id) ELSE 0 END
  AS consecutive_failures FROM g"""


@query("W07_consecutive_failures", "WITH " + EV + STREAK.format(
    change="pf IS NULL OR pf <> fail", part="PARTITION BY source_ip", isl="source_ip, island"))
def consecutive_failures(spark, sf):
    return b.failure_streak(events(spark, sf), "source_ip").select("event_id", "consecutive_failures")


@query("W07_consecutive_failures_global", "WITH " + EV + STREAK.format(
    change="pf IS NULL OR pf <> fail OR pk <> source_ip", part="", isl="island"))
def consecutive_failures_global(spark, sf):
    df = events(spark, sf).select("event_id", "timestamp", "status", "source_ip")
    return b.failure_streak(df, "source_ip", "global").select("event_id", "consecutive_failures")


@query("W08_failure_ratio", f"""WITH {EV}
SELECT event_id, round(avg(CAST(status = 'failure' AS INT)) OVER (PARTITION BY username), 6) AS user_failure_ratio
FROM ev""")
def failure_ratio(spark, sf):
    df = b.failure_ratio(events(spark, sf), "username", "user_failure_ratio")
    return df.select("event_id", R("user_failure_ratio"))


@query("W09_global_delta", f"""WITH {EV}
SELECT event_id, round(coalesce("timestamp" - lag("timestamp") OVER (ORDER BY "timestamp", event_id), 0), 6)
  AS event_delta FROM ev""")
def global_delta(spark, sf):
    df = events(spark, sf).select("event_id", "timestamp")
    return b.global_delta(df).select("event_id", R("event_delta"))


VEL = """round(CASE WHEN lag("timestamp", {n}) OVER ({p} ORDER BY "timestamp", event_id) IS NULL THEN 0
  ELSE {n} / greatest("timestamp" - lag("timestamp", {n}) OVER ({p} ORDER BY "timestamp", event_id), 1) END, 6) AS velocity_{n}"""


@query("W10_velocity_n", f"WITH {EV} SELECT event_id, " + ", ".join(
    VEL.format(n=n, p="PARTITION BY username") for n in (5, 20)) + " FROM ev")
def velocity_n(spark, sf):
    df = b.velocity(events(spark, sf), [5, 20], "username")
    return df.select("event_id", R("velocity_5"), R("velocity_20"))


@query("W10_velocity_n_global", f"WITH {EV} SELECT event_id, " + ", ".join(
    VEL.format(n=n, p="") for n in (5, 20)) + " FROM ev")
def velocity_n_global(spark, sf):
    df = b.velocity(events(spark, sf).select("event_id", "timestamp"), [5, 20])
    return df.select("event_id", R("velocity_5"), R("velocity_20"))


SESSIONS = EV + """, s0 AS (SELECT *, lag("timestamp") OVER (PARTITION BY username ORDER BY "timestamp", event_id) AS prev FROM ev),
s1 AS (SELECT *, sum(CASE WHEN prev IS NULL OR "timestamp" - prev >= 3600 THEN 1 ELSE 0 END)
  OVER (PARTITION BY username ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS session_count FROM s0)"""


@query("W11_sessionize", f"""WITH {SESSIONS}
SELECT event_id, CAST(session_count AS BIGINT) AS session_count, row_number() OVER w AS actions_in_session,
  round("timestamp" - min("timestamp") OVER (PARTITION BY username, session_count), 6) AS session_duration
FROM s1 WINDOW w AS (PARTITION BY username, session_count ORDER BY "timestamp", event_id)""")
def sessionize(spark, sf):
    df = b.sessionize(events(spark, sf), "username", 3600)
    return df.select("event_id", "session_count", "actions_in_session", R("session_duration"))


@query("W12_session_summary", f"""WITH {SESSIONS}
SELECT username, CAST(session_count AS BIGINT) AS session_count, round(min("timestamp"), 6) AS session_start,
  round(max("timestamp"), 6) AS session_end, count(*) AS events, count(DISTINCT action) AS distinct_actions
FROM s1 GROUP BY username, session_count""")
def session_summary(spark, sf):
    df = b.session_summary(events(spark, sf), "username", 3600)
    return df.select("username", "session_count", R("session_start"), R("session_end"), "events", "distinct_actions")


@query("W13_windowed_counts", f"""WITH {EV}, w AS (
  SELECT username, floor("timestamp" / 21600) * 21600 - k * 21600 AS s FROM ev, unnest([0, 1, 2, 3]) AS u(k))
SELECT username, CAST(s AS BIGINT) AS window_start, CAST(s + 86400 AS BIGINT) AS window_end, count(*) AS events
FROM w GROUP BY username, s""")
def windowed_counts(spark, sf):
    df = b.windowed_counts(events(spark, sf), "username", "1 day", "6 hours")
    return df.withColumns({c: F.unix_seconds(c) for c in ("window_start", "window_end")})


@query("W13_windowed_counts_tumbling", f"""WITH {EV}
SELECT source_ip, CAST(floor("timestamp" / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS events
FROM ev GROUP BY 1, 2""")
def windowed_counts_tumbling(spark, sf):
    df = b.windowed_counts(events(spark, sf), "source_ip", "1 hour")
    return df.select("source_ip", F.unix_seconds("window_start").alias("window_start"), "events")


@query("W14_rate_limit_violations", f"""WITH {EV}
SELECT username, CAST(floor("timestamp" / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS events
FROM ev GROUP BY 1, 2 HAVING count(*) > 4""")
def rate_limit_violations(spark, sf):
    df = b.rate_violations(events(spark, sf), "username", 4, "1 day")
    return df.select("username", F.unix_seconds("window_start").alias("window_start"), "events")


ANCHORED_SQL = f"""WITH RECURSIVE {EV}, st AS (
  SELECT username, min("timestamp") AS s FROM ev GROUP BY username
  UNION ALL
  SELECT st.username, min(e."timestamp") FROM st JOIN ev e ON e.username = st.username AND e."timestamp" > st.s + 86400
  GROUP BY st.username, st.s),
r AS (SELECT e.event_id, e."timestamp", e.username, (SELECT max(s) FROM st WHERE st.username = e.username AND s <= e."timestamp") AS w
  FROM ev e),
n AS (SELECT *, row_number() OVER (PARTITION BY username, w ORDER BY "timestamp", event_id) AS requests FROM r)
SELECT event_id, round(w, 6) AS window_start, requests, requests > 3 AS limited,
  CASE WHEN requests > 3 THEN CAST(trunc(86400 - ("timestamp" - w)) AS BIGINT) END AS retry_after FROM n"""


@query("W14_rate_limit_anchored", ANCHORED_SQL)
def rate_limit_anchored(spark, sf):
    df = b.rate_limit(events(spark, sf), "username", 3, 86400)
    return df.select("event_id", R("window_start"), "requests", "limited", "retry_after")
