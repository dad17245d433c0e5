"""Q01-Q07: searches and pages."""

import datetime

from pyspark.sql import functions as F

from logwarden.operators import search as q
from logwarden.plans.bindings import DET, INC, detections, incidents
from logwarden.plans.registry import query

DET_COLS = ["event_id", "anomaly_score", "detection_method", "ts", "username", "acknowledged"]
DET_SQL = "event_id, round(anomaly_score, 6) AS anomaly_score, detection_method, ts, username, acknowledged"
INC_COLS = ["id", "severity", "status", "created_at", "assigned_to"]
INC_SQL = ", ".join(INC_COLS)
at = datetime.datetime


def _det(df):
    return df.select(*DET_COLS).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("Q01_filter_detections", f"""WITH {DET}
SELECT {DET_SQL} FROM det WHERE det.anomaly_score >= 0.3 AND detection_method = 'error' AND NOT acknowledged
  AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10""")
def filter_detections(spark, sf):
    return _det(q.find_detections(detections(spark, sf), min_score=0.3, method="error", acknowledged=False,
                                  start=at(2024, 1, 5), end=at(2024, 1, 25), offset=10, limit=50))


@query("Q02_filter_incidents", f"""WITH {INC}
SELECT {INC_SQL} FROM inc WHERE status = 'open' AND severity = 'critical' AND created_at >= TIMESTAMP '1996-01-01'
  AND created_at <= TIMESTAMP '2000-12-31' ORDER BY created_at DESC, id LIMIT 40 OFFSET 5""")
def filter_incidents(spark, sf):
    df = q.find_incidents(incidents(spark, sf), status="open", severity="critical", created_from=at(1996, 1, 1),
                          created_to=at(2000, 12, 31), offset=5, limit=40)
    return df.select(*INC_COLS)


@query("Q03_search_criteria", f"""WITH {DET}
SELECT {DET_SQL} FROM det WHERE det.anomaly_score > 0.25 AND username <> 'user7' AND contains(source_ip, '.3.')
  AND starts_with(detection_method, 'e')""")
def search_criteria(spark, sf):
    return _det(q.search(detections(spark, sf), [
        ("anomaly_score", "gt", 0.25), ("username", "neq", "user7"), ("source_ip", "contains", ".3."),
        ("detection_method", "startswith", "e")]))


@query("Q03_search_criteria_or", f"""WITH {DET}, t AS (SELECT *, [detection_method, username] AS tags FROM det)
SELECT {DET_SQL} FROM t WHERE t.anomaly_score < 0.01 OR username = 'user9' OR list_contains(tags, 'user10')""")
def search_criteria_or(spark, sf):
    df = detections(spark, sf).withColumn("tags", F.array("detection_method", "username"))
    return _det(q.search(df, [("anomaly_score", "lt", 0.01), ("username", "eq", "user9"),
                              ("tags", "contains", "user10"), ("missing", "neq", 1)], "or"))


@query("Q04_paginate", f"""WITH {INC}
SELECT {INC_SQL}, (SELECT count(*) FROM inc) AS total, CAST(ceil((SELECT count(*) FROM inc) / 25) AS BIGINT) AS pages
FROM inc ORDER BY id LIMIT 25 OFFSET 50""")
def paginate(spark, sf):
    return q.paginate(incidents(spark, sf), ["id"], 3, 25).select(*INC_COLS, "total", "pages")


@query("Q05_get_exists_count", f"""WITH {INC}
SELECT count(*) > 0 AS found, count(*) AS matches FROM inc WHERE status = 'open' AND severity = 'high'""")
def get_exists_count(spark, sf):
    return q.exists_count(incidents(spark, sf), (F.col("status") == "open") & (F.col("severity") == "high"))


@query("Q05_get_by_id", f"WITH {INC} SELECT {INC_SQL} FROM inc WHERE id = 42")
def get_by_id(spark, sf):
    return q.by_id(incidents(spark, sf), "id", 42).select(*INC_COLS)


RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("Q06_severity_order", f"""WITH {INC}
SELECT {INC_SQL} FROM inc WHERE contains(lower(title), 'incident 1') ORDER BY {RANK} DESC, id""")
def severity_order(spark, sf):
    return q.sort_incidents(incidents(spark, sf), "severity_desc", "Incident 1").select(*INC_COLS)


@query("Q07_dashboard_filters", f"""WITH {DET}
SELECT {DET_SQL} FROM det WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'
  AND det.anomaly_score >= 0.4 AND detection_method = 'view'""")
def dashboard_filters(spark, sf):
    return _det(q.dash_filter(detections(spark, sf), time_column="ts", now=at(2024, 1, 20), time_range="7d",
                              min_score=0.4, equals={"detection_method": "view", "username": "all"}))


@query("Q07_dashboard_filters_custom", f"""WITH {INC}
SELECT {INC_SQL} FROM inc WHERE created_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-09-01'
  AND severity = 'high' AND status = 'closed'""")
def dashboard_filters_custom(spark, sf):
    df = q.dash_filter(incidents(spark, sf), time_column="created_at", now=at(2001, 1, 1), time_range="custom",
                       start=at(1997, 3, 1), end=at(1997, 9, 1), equals={"severity": "high", "status": "closed"})
    return df.select(*INC_COLS)
