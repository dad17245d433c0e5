"""Dashboard counts and entity aggregates."""

import datetime

from pyspark.sql import functions as F

from logwarden.operators import analytics as a
from logwarden.plans.bindings import DET, EV, FEATURES, INC, TL, detections, events, incidents, table, timeline
from logwarden.plans.registry import query

at = datetime.datetime
R = lambda c: F.round(F.col(c), 6).alias(c)


@query("A01_count_by_status", f"WITH {INC} SELECT status, count(*) AS n FROM inc GROUP BY status")
def count_by_status(spark, sf):
    return a.count_by(incidents(spark, sf), "status")


@query("A02_count_by_severity", f"WITH {INC} SELECT severity, count(*) AS n FROM inc GROUP BY severity")
def count_by_severity(spark, sf):
    return a.count_by(incidents(spark, sf), "severity")


RT = """rt AS (SELECT id AS incident_id, epoch(min(changed_at)) - epoch(created_at) AS response,
  epoch(min(changed_at) FILTER (new_status = 'contained')) - epoch(created_at) AS containment,
  epoch(min(changed_at) FILTER (new_status = 'resolved')) - epoch(created_at) AS resolution
  FROM inc JOIN tl ON incident_id = id GROUP BY id, created_at)"""


@query("A03_dashboard_stats", f"""WITH {DET}, {INC}, {TL}, {RT}
SELECT (SELECT count(*) FROM inc) AS total_incidents,
  (SELECT count(*) FROM inc WHERE status IN ('open', 'investigating', 'contained')) AS open_incidents,
  (SELECT count(*) FROM inc WHERE severity = 'critical') AS critical_incidents,
  (SELECT count(*) FROM det WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20') AS detections_today,
  (SELECT round(avg(response), 3) FROM rt) AS avg_response_time""")
def dashboard_stats(spark, sf):
    inc = incidents(spark, sf)
    out = a.dashboard_stats(inc, detections(spark, sf), a.response_times(timeline(spark, sf), inc), at(2024, 1, 20))
    return out.withColumn("avg_response_time", F.round("avg_response_time", 3))


@query("A04_detection_trend", f"""WITH {DET}, c AS (SELECT date_trunc('day', ts) AS period, count(*) AS n FROM det
  WHERE anomaly_score > 0.9 GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(period) FROM c), (SELECT max(period) FROM c), INTERVAL 1 DAY)) AS period)
SELECT CAST(period AS TIMESTAMP) AS period, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (period)""")
def detection_trend(spark, sf):
    return a.trend(detections(spark, sf).filter("anomaly_score > 0.9"), "ts")


@query("A05_score_histogram", f"""WITH {DET}, m AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM det),
c AS (SELECT least(49, CAST(floor((anomaly_score - lo) / ((hi - lo) / 50)) AS INT)) AS bin, count(*) AS n FROM det, m GROUP BY 1)
SELECT CAST(i AS BIGINT) AS bin, round(lo + i * ((hi - lo) / 50), 6) AS lower, coalesce(n, 0) AS n
FROM range(50) AS r(i) CROSS JOIN m LEFT JOIN c ON bin = i""")
def score_histogram(spark, sf):
    return a.histogram(detections(spark, sf), "anomaly_score", 50).select("bin", R("lower"), "n")


@query("A06_method_breakdown", f"WITH {DET} SELECT detection_method, count(*) AS n FROM det GROUP BY 1")
def method_breakdown(spark, sf):
    return a.count_by(detections(spark, sf), "detection_method")


@query("A07_analytics_query", f"""WITH {INC}
SELECT CAST(date_trunc('week', created_at) AS TIMESTAMP) AS week, count(*) AS incidents, round(avg(impact), 4) AS mean_impact
FROM inc WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01' AND severity = 'high'
GROUP BY 1 ORDER BY incidents DESC, week LIMIT 15""")
def analytics_query(spark, sf):
    out = a.analytics(incidents(spark, sf), {"incidents": F.count(F.lit(1)), "mean_impact": F.avg("impact")}, "week",
                      ts="created_at", start=at(1996, 1, 1), end=at(1998, 1, 1), filters={"severity": "high"}, limit=15)
    return out.withColumn("mean_impact", F.round("mean_impact", 4))


@query("A08_response_times", f"""WITH {INC}, {TL}, {RT}
SELECT incident_id, CAST(response AS BIGINT) AS time_to_response, CAST(containment AS BIGINT) AS time_to_containment,
  CAST(resolution AS BIGINT) AS time_to_resolution FROM rt""")
def response_times(spark, sf):
    return a.response_times(timeline(spark, sf), incidents(spark, sf))


@query("A09_entity_risk", f"""WITH {DET}, s AS (SELECT username, sum(anomaly_score) AS risk, max(anomaly_score) AS max_score,
  count(*) AS detections FROM det GROUP BY 1)
SELECT username, round(risk, 6) AS risk, round(max_score, 6) AS max_score, detections,
  dense_rank() OVER (ORDER BY round(risk, 6) DESC) AS place FROM s""")
def entity_risk(spark, sf):
    df = a.entity_risk(detections(spark, sf), "username")
    return df.select("username", R("risk"), R("max_score"), "detections", "place")


@query("A10_correlation_analysis", """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 8) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 8) FROM lineitem
UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 8) FROM lineitem""")
def correlation_analysis(spark, sf):
    return a.correlate(table(spark, sf, "lineitem"), FEATURES).withColumn("r", F.round("r", 8))


@query("A11_pattern_detection", f"""WITH {EV}, g AS (
  SELECT lag(action, 2) OVER w AS a2, lag(action) OVER w AS a1, action FROM ev
  WINDOW w AS (PARTITION BY username ORDER BY "timestamp", event_id))
SELECT a2 || '>' || a1 || '>' || action AS pattern, count(*) AS n FROM g WHERE a2 IS NOT NULL
GROUP BY 1""")
def pattern_detection(spark, sf):
    return a.patterns(events(spark, sf), "username", 3)


@query("A12_entity_profile", f"""WITH {EV}, k AS (SELECT source_ip, action, count(*) AS n, min("timestamp") AS a, max("timestamp") AS b
  FROM ev GROUP BY 1, 2)
SELECT source_ip, round(min(a), 6) AS first_seen, round(max(b), 6) AS last_seen, CAST(sum(n) AS BIGINT) AS events,
  string_agg(action || ':' || n, ',' ORDER BY action) AS event_types
FROM k GROUP BY 1""")
def entity_profile(spark, sf):
    df = a.entity_profile(events(spark, sf), "source_ip")
    kinds = F.transform(F.map_entries("event_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.select("source_ip", R("first_seen"), R("last_seen"), "events", F.array_join(kinds, ",").alias("event_types"))


@query("A13_processing_stats", f'WITH {EV} SELECT count(*) AS processed, round(max("timestamp"), 6) AS last_timestamp FROM ev')
def processing_stats(spark, sf):
    return a.processing_stats(events(spark, sf)).select("processed", R("last_timestamp"))


@query("A14_distinct_values", f"WITH {EV} SELECT DISTINCT source_ip FROM ev")
def distinct_values(spark, sf):
    return a.distinct_values(events(spark, sf), "source_ip")


@query("A15_apply_retention", f"""WITH {EV} SELECT event_id, ts FROM ev WHERE ts >= TIMESTAMP '2024-01-20'""")
def apply_retention(spark, sf):
    return a.retain(events(spark, sf), "ts", 10, at(2024, 1, 30)).select("event_id", "ts")
