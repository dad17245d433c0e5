"""Joins and enrichment."""

import datetime

from pyspark.sql import functions as F

from logwarden.operators import joins as j
from logwarden.plans.bindings import DET, EV, INC, action_results, detections, events, incidents, table
from logwarden.plans.registry import query

R = lambda c: F.round(F.col(c), 6).alias(c)


@query("J01_related_events", f"""WITH {DET}, a AS (SELECT event_id, "timestamp" AS t FROM det WHERE anomaly_score >= 0.9),
near AS (SELECT a.event_id, e.event_id AS related_id,
    row_number() OVER (PARTITION BY a.event_id ORDER BY e."timestamp", e.event_id) AS place
  FROM a JOIN ev e ON e."timestamp" BETWEEN a.t - 300 AND a.t + 300 AND e.event_id <> a.event_id),
pos AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS p FROM ev),
around AS (SELECT a.event_id, q.event_id AS related_id, row_number() OVER (PARTITION BY a.event_id ORDER BY q.p) AS place
  FROM a JOIN pos s ON s.event_id = a.event_id JOIN pos q ON q.p IN (s.p - 2, s.p - 1, s.p + 1, s.p + 2)
  WHERE a.event_id NOT IN (SELECT event_id FROM near))
SELECT event_id, place, related_id FROM near WHERE place <= 5
UNION ALL SELECT event_id, place, related_id FROM around""")
def related_events(spark, sf):
    anomalies = detections(spark, sf).filter("anomaly_score >= 0.9")
    return j.related_events(anomalies, events(spark, sf), 300, 5)


@query("J02_dedupe_recent_anomalies", f"""WITH {DET}
SELECT event_id, username FROM det WHERE anomaly_score >= 0.5
  AND event_id NOT IN (SELECT event_id FROM det WHERE acknowledged)""")
def dedupe_recent_anomalies(spark, sf):
    det = detections(spark, sf)
    return j.new_only(det.filter("anomaly_score >= 0.5"), det.filter("acknowledged")).select("event_id", "username")


@query("J03_enrich_lookup", f"""WITH {EV}
SELECT event_id, user_id, c_name AS user_c_name, c_mktsegment AS user_c_mktsegment, c_nationkey AS user_c_nationkey
FROM ev LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id""")
def enrich_lookup(spark, sf):
    dim = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    df = events(spark, sf).select("event_id", "user_id")
    return j.enrich(df, dim, "user_id", "c_custkey", "user_")


RULES = """block AS (SELECT '10.0.' || (n_nationkey % 7) || '.' || (16 * (n_nationkey % 3)) ||
    CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '/' || (28 + n_nationkey % 3) END AS cidr FROM nation),
allow AS (SELECT '10.0.' || r_regionkey || '.0/24' AS cidr FROM region),
num AS (SELECT DISTINCT source_ip, list_reduce(list_transform(string_split(source_ip, '.'), lambda s: CAST(s AS BIGINT)),
    lambda a, b: a * 256 + b) AS n FROM ev),
rules AS (SELECT kind, list_reduce(list_transform(string_split(string_split(cidr, '/')[1], '.'), lambda s: CAST(s AS BIGINT)),
    lambda a, b: a * 256 + b) AS n, coalesce(CAST(string_split(cidr, '/')[2] AS INT), 32) AS len
  FROM (SELECT 'block' AS kind, cidr FROM block UNION ALL SELECT 'allow', cidr FROM allow)),
hit AS (SELECT DISTINCT kind, source_ip FROM num JOIN rules ON rules.n % CAST(2 ** (32 - len) AS BIGINT) = 0
  AND num.n - num.n % CAST(2 ** (32 - len) AS BIGINT) = rules.n)"""


def _rules(spark, sf):
    block = table(spark, sf, "nation").selectExpr(
        "concat('10.0.', n_nationkey % 7, '.', 16 * (n_nationkey % 3), "
        "if(n_nationkey % 4 = 0, '', concat('/', 28 + n_nationkey % 3))) AS cidr")
    allow = table(spark, sf, "region").selectExpr("concat('10.0.', r_regionkey, '.0/24') AS cidr")
    return allow, block


SIX = "concat('2001:db8:', user_id % 4, '::', event_id % 50 + 1)"


@query("J04_cidr_match", f"""WITH {EV}, {RULES}
SELECT event_id, CASE WHEN event_id % 11 = 5 THEN {SIX} ELSE source_ip END AS source_ip,
  CASE WHEN event_id % 11 = 5 THEN user_id % 4 <> 1 AND event_id % 50 <> 7
  ELSE source_ip IN (SELECT source_ip FROM hit WHERE kind = 'allow')
  AND source_ip NOT IN (SELECT source_ip FROM hit WHERE kind = 'block') END AS allowed FROM ev""")
def cidr_match(spark, sf):
    """IPv4 and IPv6 addresses against rules of both families; networks end inside a digit, and single addresses."""
    allow, block = _rules(spark, sf)
    six = lambda rules: spark.createDataFrame([(r,) for r in rules], "cidr string")
    single = [f"2001:db8:{i}::8/128" for i in (0, 2, 3)]
    allow, block = allow.unionByName(six(["2001:db8::/46"])), block.unionByName(six(["2001:DB8:1::/49", "2001:db8::1/32", *single]))
    df = events(spark, sf).select("event_id", F.when(F.col("event_id") % 11 == 5, F.expr(SIX)).otherwise(F.col("source_ip")).alias("source_ip"))
    return j.ip_allowed(df, allow, block).select("event_id", "source_ip", "allowed")


@query("J05_ioc_match", f"""WITH {EV} SELECT event_id, source_ip FROM ev
WHERE source_ip IN (SELECT '10.0.' || (s_suppkey % 7) || '.' || (s_suppkey % 40) FROM supplier WHERE s_acctbal < 1000)""")
def ioc_match(spark, sf):
    iocs = table(spark, sf, "supplier").filter("s_acctbal < 1000").selectExpr(
        "concat('10.0.', s_suppkey % 7, '.', s_suppkey % 40) AS indicator")
    return j.ioc_hits(events(spark, sf), iocs, "source_ip").select("event_id", "source_ip")


BOOKS = """books AS (SELECT n_nationkey AS playbook_id, n_nationkey % 6 <> 0 AS enabled, n_nationkey % 3 AS access_level,
  ['tag' || (n_nationkey % 5), 'tag' || (5 + n_nationkey % 2)] AS tags,
  CASE n_regionkey WHEN 0 THEN ['critical'] WHEN 1 THEN ['critical', 'high'] WHEN 2 THEN ['medium', 'low']
    WHEN 3 THEN ['high', 'medium'] ELSE ['low'] END AS target_severity FROM nation),
tagged AS (SELECT id, severity, ['tag' || (id % 5), 'tag' || (5 + id % 3)] AS tags FROM inc)"""


def _books(spark, sf):
    books = table(spark, sf, "nation").selectExpr(
        "n_nationkey AS playbook_id", "n_nationkey % 6 <> 0 AS enabled", "n_nationkey % 3 AS access_level",
        "array(concat('tag', n_nationkey % 5), concat('tag', 5 + n_nationkey % 2)) AS tags",
        "CASE n_regionkey WHEN 0 THEN array('critical') WHEN 1 THEN array('critical', 'high') "
        "WHEN 2 THEN array('medium', 'low') WHEN 3 THEN array('high', 'medium') ELSE array('low') END AS target_severity")
    tagged = incidents(spark, sf).selectExpr(
        "id", "severity", "array(concat('tag', id % 5), concat('tag', 5 + id % 3)) AS tags")
    return tagged, books


@query("J06_recommend_playbooks", f"""WITH {INC}, {BOOKS}
SELECT id, playbook_id FROM tagged JOIN books ON enabled AND access_level <= 1 AND list_contains(target_severity, severity)
  AND list_has_any(books.tags, tagged.tags)""")
def recommend_playbooks(spark, sf):
    return j.match_playbooks(*_books(spark, sf), access_level=1)


@query("J06_recommend_playbooks_all_tags", f"""WITH {INC}, {BOOKS}
SELECT id, playbook_id FROM tagged JOIN books ON enabled AND list_contains(target_severity, severity)
  AND list_has_all(books.tags, tagged.tags)""")
def recommend_playbooks_all_tags(spark, sf):
    return j.match_playbooks(*_books(spark, sf), all_tags=True)


LINKS = """links AS (SELECT o_orderkey AS incident_id, 'detection' AS kind, event_id AS linked_id
  FROM events JOIN orders ON o_orderkey = event_id // 3
  UNION ALL SELECT DISTINCT o_orderkey, 'execution', l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _links(spark, sf):
    inc = incidents(spark, sf)
    det = detections(spark, sf).withColumn("incident", F.expr("event_id div 3"))
    exe = action_results(spark, sf).withColumn("incident", F.col("execution_id"))
    return inc, j.incident_links(inc, det, exe, detection_key="incident", execution_key="incident")


@query("J07_incident_links", f"WITH {LINKS} SELECT incident_id, kind, linked_id FROM links")
def incident_links(spark, sf):
    return _links(spark, sf)[1]


@query("J07_link_incident_detections", f"""WITH {INC}, {LINKS}, c AS (
  SELECT incident_id, count(*) FILTER (kind = 'detection') AS d, count(*) FILTER (kind = 'execution') AS e FROM links GROUP BY 1)
SELECT id, severity, coalesce(d, 0) AS detections, coalesce(e, 0) AS executions,
  count(*) OVER (PARTITION BY assigned_to) - 1 AS related_incidents FROM inc LEFT JOIN c ON incident_id = id""")
def link_incident_detections(spark, sf):
    inc, links = _links(spark, sf)
    out = j.incident_detail(inc, links, "assigned_to")
    return out.select("id", "severity", "detections", "executions", "related_incidents")


@query("J08_search_window_lookup", f"""WITH {EV} SELECT event_id, ts, action FROM ev
WHERE source_ip = '10.0.3.17' AND ts BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id""")
def search_window_lookup(spark, sf):
    df = j.entity_timeline(events(spark, sf), "source_ip", "10.0.3.17", 14, datetime.datetime(2024, 1, 20))
    return df.select("event_id", "ts", "action")


SERVICES = """rules AS (SELECT 167772160 + (n_nationkey % 4) * 256 AS n, 24 AS len, CASE WHEN n_nationkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
  CASE n_nationkey % 3 WHEN 0 THEN 443 WHEN 1 THEN 53 ELSE 22 END AS port FROM nation),
conn AS (SELECT event_id, source_ip AS dest_ip, CASE WHEN user_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
  CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 ELSE 80 END AS port,
  list_reduce(list_transform(string_split(source_ip, '.'), lambda s: CAST(s AS BIGINT)), lambda a, b: a * 256 + b) AS n FROM ev)"""


@query("J09_service_allowlist", f"""WITH {EV}, {SERVICES}
SELECT event_id, dest_ip, c.protocol, c.port, EXISTS (SELECT 1 FROM rules r WHERE r.protocol = c.protocol AND r.port = c.port
  AND r.n = c.n - c.n % 256) AS allowed FROM conn c""")
def service_allowlist(spark, sf):
    rules = table(spark, sf, "nation").selectExpr(
        "concat('10.0.', n_nationkey % 4, '.0/24') AS subnet", "if(n_nationkey % 2 = 0, 'tcp', 'udp') AS protocol",
        "CASE n_nationkey % 3 WHEN 0 THEN 443 WHEN 1 THEN 53 ELSE 22 END AS port")
    conn = events(spark, sf).selectExpr(
        "event_id", "source_ip AS dest_ip", "if(user_id % 2 = 0, 'tcp', 'udp') AS protocol",
        "CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 ELSE 80 END AS port")
    return j.allowed_service(conn, rules).select("event_id", "dest_ip", "protocol", "port", "allowed")
