"""Triage, incidents and response analytics."""

import datetime

from pyspark.sql import functions as F

from logwarden.functions.values import score_band, severity
from logwarden.operators import features as f, stat, triage as t
from logwarden.plans.bindings import (ACT, DET, EV, FEATURES, INC, TL, action_results, detections, events, incidents, table,
                                      timeline)
from logwarden.plans.detector_queries import LONG, SHARES
from logwarden.plans.registry import query

at = datetime.datetime
R = lambda c: F.round(F.col(c), 6).alias(c)
SEV = """CASE WHEN {s} >= 0.95 THEN 'critical' WHEN {s} >= 0.85 THEN 'high' WHEN {s} >= 0.7 THEN 'medium'
  WHEN {s} >= 0.5 THEN 'low' ELSE 'normal' END"""


@query("R01_severity_from_score", f"WITH {DET} SELECT event_id, {SEV.format(s='anomaly_score')} AS severity FROM det")
def severity_from_score(spark, sf):
    return detections(spark, sf).select("event_id", severity("anomaly_score").alias("severity"))


@query("R02_anomaly_report", f"""WITH {LONG}, {SHARES},
n AS (SELECT rid, (z + m) / 2 / max((z + m) / 2) OVER () AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY importance DESC, feature) AS place FROM sh)
SELECT l_orderkey, l_linenumber, l_partkey, {SEV.format(s='score')} AS severity, score >= 0.5 AS is_anomaly, place, feature,
  round(importance, 6) AS share FROM k JOIN n USING (rid) WHERE place <= 2""")
def anomaly_report(spark, sf):
    df = table(spark, sf, "lineitem")
    params = stat.fit_statistical(df, FEATURES)
    df = t.report(stat.explain_statistical(stat.score_statistical(df, params), params), n=2)
    out = df.select("l_orderkey", "l_linenumber", "l_partkey", "severity", "is_anomaly",
                    F.posexplode("top_factors").alias("place", "f"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "severity", "is_anomaly",
                      (F.col("place") + 1).cast("bigint").alias("place"), "f.feature", F.round("f.share", 6).alias("share"))


@query("R03_score_band", f"""WITH {DET} SELECT event_id, CASE WHEN anomaly_score >= 0.8 THEN 'danger'
  WHEN anomaly_score >= 0.6 THEN 'warning' ELSE 'info' END AS band FROM det""")
def band(spark, sf):
    return detections(spark, sf).select("event_id", score_band("anomaly_score").alias("band"))


@query("R04_classify_rules", f"""WITH {EV}, h AS (SELECT *, hour(ts) AS hour FROM ev), c AS (
SELECT event_id, CASE WHEN action = 'error' AND status = 'failure' AND username = 'user7' THEN 'user7_failure'
    WHEN action = 'error' AND status = 'failure' THEN 'auth_failure'
    WHEN (hour < 6 OR hour > 22) AND action = 'view' THEN 'unusual_access'
    WHEN action || '==' || status = 'signup==success' AND duration > 100 THEN 'odd_text'
    WHEN action = 'purchase' AND duration > 100 THEN 'data_exfiltration' ELSE 'unknown_anomaly' END AS classification FROM h)
SELECT event_id, classification, CASE classification WHEN 'user7_failure' THEN 'critical' WHEN 'auth_failure' THEN 'high'
  WHEN 'unusual_access' THEN 'medium' WHEN 'data_exfiltration' THEN 'critical' WHEN 'odd_text' THEN 'medium' ELSE 'low' END AS severity FROM c""")
def classify_rules(spark, sf):
    rules = [
        t.Rule("auth_failure", ["action == 'error'", "status == 'failure'"], "high"),
        t.Rule("unusual_access", ["hour < 6 or hour > 22", "action == 'view'"], "medium"),
        t.Rule("odd_text", ["action || '==' || status == 'signup==success'", "duration > 100"], "medium"),
        t.Rule("data_exfiltration", ["action == 'purchase'", "duration > 100"], "critical"),
        t.Rule("user7_failure", ["action == 'error'", "status == 'failure'", "username == 'user7'"], "critical", 100),
    ]
    return t.classify(f.time_parts(events(spark, sf)), rules).select("event_id", "classification", "severity")


@query("R05_threshold_rule", f"""WITH {EV} SELECT username, CAST(floor("timestamp" / 21600) * 21600 AS BIGINT) AS window_start,
  count(*) AS events FROM ev GROUP BY 1, 2 HAVING count(*) >= 3""")
def threshold_rule(spark, sf):
    df = t.threshold_rule(events(spark, sf), "username", "6 hours", 3)
    return df.withColumn("window_start", F.unix_seconds("window_start"))


@query("R06_signature_rule", f"WITH {EV} SELECT event_id, source_ip FROM ev WHERE regexp_matches(source_ip, '^10\\.0\\.[35]\\.1\\d$')")
def signature_rule(spark, sf):
    return t.signature_rule(events(spark, sf), "source_ip", r"^10\.0\.[35]\.1\d$").select("event_id", "source_ip")


@query("R07_correlation_rule", f"""WITH {EV}, c AS (SELECT event_id, username, action, "timestamp",
  max(CASE WHEN action = 'error' THEN "timestamp" END) OVER (PARTITION BY username ORDER BY "timestamp", event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cause_time FROM ev)
SELECT event_id, username, round(cause_time, 6) AS cause_time FROM c
WHERE action = 'purchase' AND "timestamp" - cause_time <= 7200""")
def correlation_rule(spark, sf):
    df = t.correlation_rule(events(spark, sf), F.col("action") == "error", F.col("action") == "purchase", "username", 7200)
    return df.select("event_id", "username", R("cause_time"))


IDS = "SELECT o_orderkey * 2 AS event_id FROM orders WHERE o_orderpriority = '1-URGENT'"


def _ids(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey * 2 AS event_id")


@query("R08_acknowledge", f"""WITH {DET}, ids AS ({IDS})
SELECT event_id, event_id IN (SELECT event_id FROM ids) OR acknowledged AS acknowledged,
  CASE WHEN event_id IN (SELECT event_id FROM ids) THEN 'analyst' WHEN event_id % 10 = 3 THEN 'earlier' END AS acknowledged_by,
  CASE WHEN event_id IN (SELECT event_id FROM ids) THEN TIMESTAMP '2024-02-01' WHEN event_id % 10 = 3 THEN TIMESTAMP '2024-01-15' END
    AS acknowledged_at FROM det""")
def acknowledge(spark, sf):
    """A tenth of the detections was acknowledged before by someone else."""
    earlier = F.col("event_id") % 10 == 3
    before = detections(spark, sf).withColumns({
        "acknowledged_by": F.when(earlier, "earlier"), "acknowledged_at": F.when(earlier, F.lit(at(2024, 1, 15)))})
    df = t.acknowledge(before, _ids(spark, sf), "analyst", at(2024, 2, 1))
    return df.select("event_id", "acknowledged", "acknowledged_by", "acknowledged_at")


@query("R08_acknowledge_failed", f"WITH ids AS ({IDS}) SELECT event_id FROM ids WHERE event_id NOT IN (SELECT event_id FROM events)")
def acknowledge_failed(spark, sf):
    return t.acknowledge_failed(detections(spark, sf), _ids(spark, sf))


@query("R09_auto_acknowledge", f"WITH {DET} SELECT event_id, acknowledged OR anomaly_score < 0.4 AS acknowledged FROM det")
def auto_acknowledge(spark, sf):
    return t.auto_acknowledge(detections(spark, sf)).select("event_id", "acknowledged")


UPD = """upd AS (SELECT c_custkey * 3 AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status,
  CASE WHEN c_nationkey % 3 = 0 THEN 'low' END AS severity FROM customer)"""


def _updates(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey * 3 AS id", "CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'low' END AS severity")


@query("R10_apply_updates", f"""WITH {INC}, {UPD}
SELECT inc.id, coalesce(upd.status, inc.status) AS status, coalesce(upd.severity, inc.severity) AS severity,
  CASE WHEN upd.id IS NOT NULL THEN TIMESTAMP '2002-01-01' WHEN inc.id % 7 = 1 THEN TIMESTAMP '2001-05-05' END AS updated_at FROM inc LEFT JOIN upd ON upd.id = inc.id""")
def apply_updates(spark, sf):
    before = incidents(spark, sf).withColumn("updated_at", F.when(F.col("id") % 7 == 1, F.lit(at(2001, 5, 5))))
    df = t.apply_updates(before, _updates(spark, sf), "id", ["status", "severity"], at(2002, 1, 1))
    return df.select("id", "status", "severity", "updated_at")


@query("R11_timeline_from_changes", f"""WITH {INC}, {UPD}, n AS (
  SELECT inc.id, coalesce(upd.status, inc.status) AS s, coalesce(upd.severity, inc.severity) AS v, inc.status AS os,
    inc.severity AS ov FROM inc LEFT JOIN upd ON upd.id = inc.id)
SELECT id, 'status' AS field, os AS old_value, s AS new_value FROM n WHERE s <> os AND id % 10 <> 0
UNION ALL SELECT id, 'severity', ov, v FROM n WHERE v <> ov AND id % 10 <> 0
UNION ALL SELECT id, 'created', NULL, NULL FROM n WHERE id % 10 = 0""")
def timeline_from_changes(spark, sf):
    inc = incidents(spark, sf)
    new = t.apply_updates(inc, _updates(spark, sf), "id", ["status", "severity"], at(2002, 1, 1))
    return t.diff_timeline(inc.filter("id % 10 <> 0"), new, "id", ["severity", "status"])


@query("R11_status_changes", f"""WITH {TL}, p AS (SELECT *, lag(new_status) OVER (PARTITION BY incident_id
  ORDER BY changed_at, entry, ref) AS old_status FROM tl)
SELECT incident_id, entry, ref, old_status, new_status FROM p WHERE old_status IS DISTINCT FROM new_status""")
def status_changes(spark, sf):
    return t.status_changes(timeline(spark, sf)).select("incident_id", "entry", "ref", "old_status", "new_status")


@query("R12_status_at_time", f"""WITH {TL}, p AS (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY changed_at DESC, entry DESC, ref DESC) AS n FROM tl)
SELECT incident_id, new_status AS status, changed_at AS since FROM p WHERE n = 1""")
def status_at_time(spark, sf):
    return t.current_state(timeline(spark, sf))


@query("R13_execution_summary", f"""WITH {ACT} SELECT execution_id, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) AS total_actions, sum(duration) AS duration_seconds FROM act GROUP BY 1""")
def execution_summary(spark, sf):
    return t.execution_summary(action_results(spark, sf))


@query("R14_execution_metrics", f"""WITH {ACT} SELECT execution_id, round(avg(duration), 6) AS avg_action_duration,
  max(duration) AS max_action_duration, min(duration) AS min_action_duration,
  round(avg(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) * 100, 6) AS success_rate_percent FROM act GROUP BY 1""")
def execution_metrics(spark, sf):
    df = t.execution_metrics(action_results(spark, sf))
    return df.select("execution_id", R("avg_action_duration"), "max_action_duration", "min_action_duration",
                     R("success_rate_percent"))


@query("R15_execution_status", f"""WITH {ACT} SELECT execution_id, CASE WHEN bool_or(status = 'failed') THEN 'failed'
  WHEN bool_or(status = 'skipped') THEN 'partial' ELSE 'completed' END AS status FROM act GROUP BY 1""")
def execution_status(spark, sf):
    return t.rollup_status(action_results(spark, sf))


@query("R16_recent_executions", f"""WITH {ACT}, r AS (SELECT playbook_id, execution_id, max(start_time) AS start_time FROM act GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playbook_id ORDER BY start_time DESC, execution_id) AS place FROM r)
WHERE place <= 10""")
def recent_executions(spark, sf):
    return t.recent(action_results(spark, sf), 10)


@query("R17_login_pattern_summary", f"""WITH {EV}, w AS (SELECT * FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-30'),
u AS (SELECT DISTINCT username, source_ip FROM w EXCEPT SELECT username, source_ip FROM ev WHERE ts < TIMESTAMP '2024-01-20')
SELECT username, (SELECT count(*) FROM u WHERE u.username = w.username) AS unusual_locations,
  count(*) FILTER (status = 'failure') AS failed_attempts FROM w GROUP BY username""")
def login_pattern_summary(spark, sf):
    return t.login_summary(events(spark, sf), at(2024, 1, 30), 10)


CONN = """conn AS (SELECT username, CASE event_id % 5 WHEN 0 THEN source_ip WHEN 1 THEN '172.16.0.' || (event_id % 9)
  WHEN 2 THEN '8.8.4.' || (event_id % 50) ELSE '93.1.2.' || (user_id % 20) END AS dest_ip FROM ev WHERE user_id % 3 <> 0
  OR event_id % 5 > 1)"""


@query("R18_lateral_movement", f"""WITH {EV}, {CONN}, i AS (SELECT *, starts_with(dest_ip, '10.') OR starts_with(dest_ip, '172.16.')
  OR starts_with(dest_ip, '192.168.') AS internal FROM conn)
SELECT username, count(*) FILTER (internal) AS connection_count, count(DISTINCT CASE WHEN internal THEN dest_ip END)
  AS internal_destinations, bool_or(internal) AS lateral_movement FROM i GROUP BY 1""")
def lateral_movement(spark, sf):
    conn = events(spark, sf).filter("user_id % 3 <> 0 OR event_id % 5 > 1").selectExpr(
        "username", "CASE event_id % 5 WHEN 0 THEN source_ip WHEN 1 THEN concat('172.16.0.', event_id % 9) "
        "WHEN 2 THEN concat('8.8.4.', event_id % 50) ELSE concat('93.1.2.', user_id % 20) END AS dest_ip")
    return t.lateral_movement(conn, "username", "dest_ip")


@query("R19_scan_summary", """WITH o AS (SELECT o_orderkey AS scan_id, count(*) AS hosts_scanned,
  count(*) FILTER (l_returnflag = 'R') AS hosts_infected, sum(l_linenumber % 3) AS vuln_critical,
  count(*) FILTER (l_linestatus = 'O') AS vuln_high FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT scan_id, hosts_scanned, hosts_infected, CAST(vuln_critical AS BIGINT) AS vuln_critical, vuln_high,
  array_to_string(list_filter([
    CASE WHEN hosts_infected > 0 THEN 'Quarantine ' || hosts_infected || ' infected hosts' END,
    CASE WHEN hosts_infected > 0 THEN 'Collect forensic evidence from infected hosts' END,
    CASE WHEN vuln_critical > 0 THEN 'Address ' || vuln_critical || ' critical vulnerabilities' END,
    CASE WHEN vuln_high > 0 THEN 'Plan remediation for ' || vuln_high || ' high-severity vulnerabilities' END
  ], lambda x: x IS NOT NULL), '; ') AS action_items FROM o""")
def scan_summary(spark, sf):
    """One scan report per line of an order (the scan); each names one host."""
    host = F.struct(
        F.concat(F.lit("h"), F.col("l_linenumber")).alias("host"), (F.col("l_returnflag") == "R").alias("malware_detected"),
        F.concat(F.array_repeat(F.struct(F.lit("critical").alias("severity")), F.col("l_linenumber") % 3),
                 F.when(F.col("l_linestatus") == "O", F.array(F.struct(F.lit("high").alias("severity"))))
                 .otherwise(F.array(F.struct(F.lit("low").alias("severity"))))).alias("vulnerabilities"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey"), "l_orderkey")
    payloads = lines.select(F.col("l_orderkey").alias("scan_id"), F.to_json(F.struct(
        F.lit(1).alias("hosts_scanned"), F.array(host).alias("hosts"))).alias("payload"))
    out = t.scan_summary(payloads, "payload", "scan_id")
    return out.withColumn("action_items", F.array_join("action_items", "; "))


@query("R20_subnet_summary", f"""WITH {EV}, g AS (SELECT username, count(DISTINCT source_ip) AS asset_count,
  arg_min(source_ip, (ts, event_id)) AS f, bool_or(action = 'error') AS contains_critical FROM ev WHERE day(ts) <= 1 + user_id % 3 * 12
  GROUP BY 1)
SELECT username, asset_count, contains_critical, CASE WHEN asset_count = 1 THEN f || '/32'
  WHEN asset_count <= 5 THEN regexp_replace(f, '\\.[0-9]+$', '.0/24') WHEN asset_count <= 10 THEN regexp_replace(f, '\\.[0-9]+$', '.0/24')
  ELSE regexp_replace(f, '\\.[0-9]+\\.[0-9]+$', '.0.0/16') END AS subnet FROM g""")
def subnet_summary(spark, sf):
    df = events(spark, sf).filter("day(ts) <= 1 + user_id % 3 * 12")
    out = t.subnet_of(df, "username", "source_ip", ["ts", "event_id"], F.col("action") == "error")
    return out.select("username", "asset_count", "contains_critical", "subnet")


BAD = """bad AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE username END AS username,
  CASE WHEN event_id % 8 = 0 THEN '10.0.300.1' WHEN event_id % 10 = 0 THEN NULL ELSE source_ip END AS source_ip FROM ev)"""


@query("R21_validate_records", f"""WITH {EV}, {BAD}
SELECT event_id, array_to_string(list_filter([CASE WHEN username IS NULL THEN 'missing:username' END,
  CASE WHEN source_ip IS NULL THEN 'missing:source_ip' END, CASE WHEN source_ip = '10.0.300.1' THEN 'bad_ip:source_ip' END],
  lambda x: x IS NOT NULL), ',') AS violations FROM bad""")
def validate_records(spark, sf):
    bad = events(spark, sf).selectExpr(
        "event_id", "CASE WHEN event_id % 9 <> 0 THEN username END AS username",
        "CASE WHEN event_id % 8 = 0 THEN '10.0.300.1' WHEN event_id % 10 = 0 THEN NULL ELSE source_ip END AS source_ip")
    out = t.validate(bad, ["username", "source_ip"], ["source_ip"])
    return out.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("R22_active_blocks", f"""WITH {EV}, b AS (SELECT event_id, source_ip AS ip, ts, CASE WHEN action = 'error' THEN 'block' ELSE 'unblock' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 3600 * (event_id % 100) END AS duration FROM ev WHERE action IN ('error', 'view')),
l AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, event_id DESC) AS n FROM b)
SELECT ip, ts AS since, duration FROM l WHERE n = 1 AND kind = 'block' AND (duration IS NULL
  OR date_trunc('second', ts) + to_seconds(duration) > TIMESTAMP '2024-01-29 12:00:00')""")
def active_blocks(spark, sf):
    b = events(spark, sf).filter("action in ('error', 'view')").selectExpr(
        "event_id", "source_ip AS ip", "ts", "if(action = 'error', 'block', 'unblock') AS kind",
        "CASE WHEN event_id % 2 = 0 THEN 3600 * (event_id % 100) END AS duration")
    return t.active_blocks(b, at(2024, 1, 29, 12))
