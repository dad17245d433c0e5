"""Collection filters, metadata, transforms and counters."""

from pyspark.sql import functions as F

from logwarden.operators import collect as c
from logwarden.plans.bindings import EV, events, table
from logwarden.plans.registry import query

COLS = ["event_id", "username", "source_ip", "action"]


@query("F01_filter_include_exclude", f"""WITH {EV}, x AS (SELECT event_id, username, source_ip, action,
  '{{"event_id":' || event_id || ',"username":"' || username || '","source_ip":"' || source_ip || '","action":"' || action || '"}}' AS j FROM ev)
SELECT event_id, username, source_ip, action FROM x WHERE NOT regexp_matches(j, '"username":"user1\\d"')
  AND NOT regexp_matches(j, '10\\.0\\.[56]\\.') AND (regexp_matches(j, '"(error|view)"') OR regexp_matches(j, 'user77'))""")
def filter_include_exclude(spark, sf):
    df = events(spark, sf).select(*COLS)
    return c.filter_patterns(df, ['"(?P<kind>error|view)"', "user77", "bad("], [r'"username":"user1\d"', r"10\.0\.[56]\."])


@query("F02_add_collection_metadata", f"""WITH {EV} SELECT event_id, 'auth-files' AS _collector, 'prod,auth' AS _tags,
  sha256('{{"event_id":' || event_id || ',"username":"' || username || '","source_ip":"' || source_ip || '","action":"' || action || '"}}') AS _id
FROM ev""")
def add_collection_metadata(spark, sf):
    df = c.with_metadata(events(spark, sf).select(*COLS), "auth-files", ["prod", "auth"])
    return df.select("event_id", "_collector", F.array_join("_tags", ",").alias("_tags"), "_id")


@query("F03_apply_transform", f"""WITH {EV} SELECT event_id, CASE WHEN action = 'error' THEN upper(username) ELSE username END AS username,
  json_extract_string(props, '$.k') AS k FROM ev""")
def apply_transform(spark, sf):
    df = events(spark, sf)
    df = c.apply_transform(df, "username", "CASE WHEN action = 'error' THEN upper(username) END")
    return df.select("event_id", "username", c.json_path("props", ".k").alias("k"))


@query("U01_scalar_udf", f"""WITH {EV} SELECT event_id, CASE WHEN action = 'view' THEN action ELSE action || '!' END AS action FROM ev""")
def scalar_udf(spark, sf):
    def shout(x):
        if x == "view":
            raise ValueError("kept as it is")
        return x + "!"

    return c.apply_transform(events(spark, sf), "action", c.record_udf(shout)("action")).select("event_id", "action")


@query("F04_filter_in_lists", f"""WITH {EV} SELECT event_id, username, source_ip, action FROM ev
WHERE source_ip IN ('10.0.1.1', '10.0.2.2', '10.0.3.3') AND action IN ('error', 'click')""")
def filter_in_lists(spark, sf):
    return c.filter_in(events(spark, sf), {"source_ip": ["10.0.1.1", "10.0.2.2", "10.0.3.3"],
                                           "action": ["error", "click"]}).select(*COLS)


@query("F05_collector_stats", """WITH x AS (SELECT 'c' || (user_id % 4) AS _collector, ts, event_type <> 'view' AS kept, event_type = 'error' AS err FROM events)
SELECT _collector, count(*) FILTER (kept AND NOT err) AS collected, count(*) FILTER (NOT kept AND NOT err) AS filtered,
  count(*) FILTER (err) AS errors, max(ts) FILTER (kept AND NOT err) AS last_success FROM x GROUP BY 1""")
def collector_stats(spark, sf):
    df = events(spark, sf).withColumn("_collector", F.expr("concat('c', user_id % 4)"))
    return c.collector_stats(df, F.col("action") != "view", F.col("action") == "error")


@query("F06_normalize_stats", """SELECT count(*) AS processed, count(*) FILTER (event_id % 6 <> 5) AS normalized,
  count(*) FILTER (event_id % 50 = 7) AS errors FROM events""")
def normalize_stats(spark, sf):
    df = events(spark, sf).withColumn("_normalized", F.col("event_id") % 6 != 5)
    return c.normalization_stats(df, F.col("event_id") % 50 == 7)


@query("F07_filter_by_source_config", """WITH s AS (SELECT n_nationkey AS source_id, n_nationkey % 5 <> 0 AS enabled,
  CASE WHEN n_nationkey % 2 = 0 THEN [4624, 4625, 4600 + n_nationkey] END AS event_ids, n_nationkey % 3 AS f FROM nation),
e AS (SELECT event_id, user_id % 25 AS source_id, 4600 + event_id % 30 AS code, ['auth', 'kern', 'daemon'][1 + event_id % 3] AS facility,
  ['error', 'info'][1 + event_id % 2] AS severity FROM events)
SELECT event_id, source_id, code FROM e JOIN s USING (source_id) WHERE enabled AND (event_ids IS NULL OR list_contains(event_ids, code))
  AND (f = 0 OR (f = 1 AND facility = 'auth') OR (f = 2 AND facility IN ('kern', 'daemon') AND severity = 'error'))""")
def filter_by_source_config(spark, sf):
    sources = table(spark, sf, "nation").selectExpr(
        "bigint(n_nationkey) AS source_id", "n_nationkey % 5 <> 0 AS enabled",
        "CASE WHEN n_nationkey % 2 = 0 THEN array(4624L, 4625L, 4600L + n_nationkey) END AS event_ids",
        "CASE n_nationkey % 3 WHEN 1 THEN array('auth') WHEN 2 THEN array('kern', 'daemon') END AS facilities",
        "CASE n_nationkey % 3 WHEN 2 THEN array('error') END AS severities")
    ev = events(spark, sf).selectExpr(
        "event_id", "user_id % 25 AS source_id", "4600 + event_id % 30 AS code",
        "element_at(array('auth', 'kern', 'daemon'), int(1 + event_id % 3)) AS facility",
        "element_at(array('error', 'info'), int(1 + event_id % 2)) AS severity")
    return c.filter_by_source(ev, sources).select("event_id", "source_id", "code")
