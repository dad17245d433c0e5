"""The given tables seen as security data, in Spark and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.schemas import EVENT_SCHEMA
from logwarden.session import scratch_path

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EV = """ev AS (
  SELECT event_id, ts, epoch(ts) AS "timestamp", user_id, 'user' || user_id AS username,
         '10.0.' || (event_id % 7) || '.' || (user_id % 40) AS source_ip, event_type AS action,
         CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
         value AS duration, props FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event frame: who (username, source_ip), what (action, status), when (ts, timestamp)."""
    return event_frame(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event frame as a stream over the same file."""
    raw = (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 100).parquet(sf))
    return event_frame(raw)


def event_batches(spark: SparkSession, sf: str, parts: int = 3) -> DataFrame:
    """The event frame as a stream of several batches, one after the other in time."""
    raw, path = table(spark, sf, "events"), scratch_path(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = raw.agg(F.min(at), F.max(at)).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        raw.filter((at >= low + k * step) & (at < low + (k + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return event_frame(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(path))


def event_frame(raw: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        "event_id",
        ts.alias("ts"),
        (F.unix_micros(ts) / F.lit(1e6)).alias("timestamp"),
        "user_id",
        F.concat(F.lit("user"), F.col("user_id")).alias("username"),
        F.concat(F.lit("10.0."), F.col("event_id") % 7, F.lit("."), F.col("user_id") % 40).alias("source_ip"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.col("value").alias("duration"),
        "props",
    )


INC = """inc AS (
  SELECT o_orderkey AS id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'investigating' ELSE 'closed' END AS status,
         o_orderdate AS created_at, o_custkey AS assigned_to, 'Incident ' || o_orderkey AS title,
         o_totalprice AS impact FROM orders)"""


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium")
        .otherwise("low").alias("severity"),
        F.when(s == "O", "open").when(s == "P", "investigating").otherwise("closed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_custkey").alias("assigned_to"),
        F.concat(F.lit("Incident "), F.col("o_orderkey")).alias("title"),
        F.col("o_totalprice").alias("impact"),
    )


TL = """tl AS (
  SELECT l_orderkey AS incident_id, l_linenumber AS entry, l_partkey AS ref, l_shipdate AS changed_at,
         CASE l_returnflag WHEN 'A' THEN 'investigating' WHEN 'N' THEN 'contained' ELSE 'resolved' END AS new_status,
         l_suppkey AS actor FROM lineitem)"""


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Incident timeline: one status change per line."""
    f = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"),
        F.col("l_linenumber").alias("entry"),
        F.col("l_partkey").alias("ref"),
        F.col("l_shipdate").cast("timestamp").alias("changed_at"),
        F.when(f == "A", "investigating").when(f == "N", "contained").otherwise("resolved").alias("new_status"),
        F.col("l_suppkey").alias("actor"),
    )


DET = EV + """, det AS (
  SELECT event_id, least(1.0, duration / 200) AS anomaly_score, action AS detection_method, ts, "timestamp",
         username, source_ip, event_id % 3 = 0 AS acknowledged FROM ev)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "event_id",
        F.least(F.lit(1.0), F.col("duration") / 200).alias("anomaly_score"),
        F.col("action").alias("detection_method"),
        "ts",
        "timestamp",
        "username",
        "source_ip",
        (F.col("event_id") % 3 == 0).alias("acknowledged"),
    )


SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS stat, l_extendedprice / 110000 AS forest,
         l_discount * 10 AS recon, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Three model scores and a label per line."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_quantity") / 50).alias("stat"),
        (F.col("l_extendedprice") / 110000).alias("forest"),
        (F.col("l_discount") * 10).alias("recon"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


ACT = """act AS (
  SELECT l_orderkey AS execution_id, l_linenumber AS action_id, l_suppkey % 10 AS playbook_id,
         CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'skipped' ELSE 'failed' END AS status,
         l_shipdate AS start_time, l_quantity AS duration FROM lineitem)"""


def action_results(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("execution_id"),
        F.col("l_linenumber").alias("action_id"),
        (F.col("l_suppkey") % 10).alias("playbook_id"),
        F.when(f == "A", "completed").when(f == "N", "skipped").otherwise("failed").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("start_time"),
        F.col("l_quantity").alias("duration"),
    )


# Raw log lines in each format, derived from the events.
LINES = EV + """, lines AS (
  SELECT event_id, user_id, username, source_ip, action, ts, "timestamp",
    strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 20) || ' sshd[' || event_id || ']: ' ||
      CASE action WHEN 'error' THEN 'Failed password for ' || username || ' from ' || source_ip || ' port 22 ssh2'
                  WHEN 'signup' THEN 'Accepted password for ' || username || ' from ' || source_ip || ' port 22 ssh2'
                  WHEN 'view' THEN 'Connection closed by ' || source_ip || ' port 22'
                  ELSE 'session opened' END AS syslog,
    '<' || (event_id % 200) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' host' || (user_id % 20) || ' ' ||
      CASE user_id % 4 WHEN 0 THEN 'sshd' WHEN 1 THEN 'nginx' WHEN 2 THEN 'kernel' ELSE 'su' END || ' ' ||
      CASE WHEN event_id % 5 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END || ' ID' || (event_id % 50) || ' - ' ||
      action || ' by ' || username || ' from ' || source_ip AS rfc5424,
    '<' || (event_id % 192) || '>' || strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 20) || ' ' ||
      CASE user_id % 3 WHEN 0 THEN 'cron' WHEN 1 THEN 'login' ELSE 'iptables' END || '[' || event_id || ']: ' ||
      action || ' from ' || source_ip || ' to 10.1.' || (user_id % 9) || '.' || (event_id % 300) AS rfc3164,
    'CEF:0|Acme|FW|1.0|' || (event_id % 100) || '|' || action || '|' || (user_id % 11) || '|src=' || source_ip ||
      ' dst=2.1.2.' || (user_id % 250) || ' spt=' || (1024 + event_id % 5000) || ' dpt=443 suser=' || username ||
      ' msg=' || action || ' seen here act=' ||
      CASE event_id % 5 WHEN 0 THEN 'Permitted' WHEN 1 THEN 'blocked' WHEN 2 THEN 'deny' WHEN 3 THEN 'warned'
                        ELSE 'ALLOW' END || ' rt=' || epoch_us(ts) // 1000 AS cef,
    source_ip || ' - ' || CASE WHEN event_id % 4 = 0 THEN '-' ELSE username END || ' [' ||
      strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /p/' || (event_id % 60) || ' HTTP/1.1" ' ||
      (100 * (1 + event_id % 5) + 4) || ' ' || CASE WHEN event_id % 6 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END ||
      ' "-" "' || CASE event_id % 7
        WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36'
        WHEN 1 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0'
        WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU OS 17) Version/17.0 Mobile Safari/604.1'
        WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14) Mobile Firefox/121.0'
        WHEN 4 THEN 'Mozilla/5.0 (Windows NT 6.1; Trident/7.0)'
        WHEN 5 THEN 'Mozilla/5.0 (Mac OS X 14) Edge/18' ELSE 'curl/8.0' END || '"' AS clf,
    '{"remote_addr":"' || source_ip || '","remote_user":"' || username || '","time_local":"' ||
      strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000","request":"POST /q/' || (event_id % 60) ||
      ' HTTP/2","status":' || (100 * (1 + event_id % 5) + 1) || ',"body_bytes_sent":' || event_id ||
      ',"http_referer":"-","http_user_agent":"curl/8.0","request_time":' || (user_id % 10) || '.5,"host":"h' ||
      (user_id % 3) || '"}' AS nginx,
    '{"ts":' || CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END || ',"src":"' || source_ip ||
      '","who":"' || username || '","n":"' || (event_id % 90) || '.7","ok":"' ||
      CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '1' END || '","secret":"x","k":' ||
      json_extract_string(props, '$.k') || '}' AS json
  FROM ev)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw log lines in six formats, one column each."""
    return line_frame(events(spark, sf))


def line_frame(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "user_id", "username", "source_ip", "action", "ts", "timestamp",
        F.expr("""concat(date_format(ts, 'MMM dd HH:mm:ss'), ' host', user_id % 20, ' sshd[', event_id, ']: ',
          CASE action WHEN 'error' THEN concat('Failed password for ', username, ' from ', source_ip, ' port 22 ssh2')
                      WHEN 'signup' THEN concat('Accepted password for ', username, ' from ', source_ip, ' port 22 ssh2')
                      WHEN 'view' THEN concat('Connection closed by ', source_ip, ' port 22')
                      ELSE 'session opened' END)""").alias("syslog"),
        F.expr("""concat('<', event_id % 200, '>1 ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' host', user_id % 20, ' ',
          CASE user_id % 4 WHEN 0 THEN 'sshd' WHEN 1 THEN 'nginx' WHEN 2 THEN 'kernel' ELSE 'su' END, ' ',
          CASE WHEN event_id % 5 = 0 THEN '-' ELSE string(event_id) END, ' ID', event_id % 50, ' - ',
          action, ' by ', username, ' from ', source_ip)""").alias("rfc5424"),
        F.expr("""concat('<', event_id % 192, '>', date_format(ts, 'MMM dd HH:mm:ss'), ' host', user_id % 20, ' ',
          CASE user_id % 3 WHEN 0 THEN 'cron' WHEN 1 THEN 'login' ELSE 'iptables' END, '[', event_id, ']: ',
          action, ' from ', source_ip, ' to 10.1.', user_id % 9, '.', event_id % 300)""").alias("rfc3164"),
        F.expr("""concat('CEF:0|Acme|FW|1.0|', event_id % 100, '|', action, '|', user_id % 11, '|src=', source_ip,
          ' dst=2.1.2.', user_id % 250, ' spt=', 1024 + event_id % 5000, ' dpt=443 suser=', username,
          ' msg=', action, ' seen here act=',
          CASE event_id % 5 WHEN 0 THEN 'Permitted' WHEN 1 THEN 'blocked' WHEN 2 THEN 'deny' WHEN 3 THEN 'warned'
                            ELSE 'ALLOW' END, ' rt=', unix_millis(ts))""").alias("cef"),
        F.expr("""concat(source_ip, ' - ', CASE WHEN event_id % 4 = 0 THEN '-' ELSE username END, ' [',
          date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET /p/', event_id % 60, ' HTTP/1.1" ',
          100 * (1 + event_id % 5) + 4, ' ', CASE WHEN event_id % 6 = 0 THEN '-' ELSE string(event_id) END,
          ' "-" "', CASE event_id % 7
            WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36'
            WHEN 1 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0'
            WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU OS 17) Version/17.0 Mobile Safari/604.1'
            WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14) Mobile Firefox/121.0'
            WHEN 4 THEN 'Mozilla/5.0 (Windows NT 6.1; Trident/7.0)'
            WHEN 5 THEN 'Mozilla/5.0 (Mac OS X 14) Edge/18' ELSE 'curl/8.0' END, '"')""").alias("clf"),
        F.expr("""concat('{"remote_addr":"', source_ip, '","remote_user":"', username, '","time_local":"',
          date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000","request":"POST /q/', event_id % 60,
          ' HTTP/2","status":', 100 * (1 + event_id % 5) + 1, ',"body_bytes_sent":', event_id,
          ',"http_referer":"-","http_user_agent":"curl/8.0","request_time":', user_id % 10, '.5,"host":"h',
          user_id % 3, '"}')""").alias("nginx"),
        F.expr("""concat('{"ts":', CASE WHEN event_id % 2 = 0 THEN unix_millis(ts) ELSE unix_millis(ts) div 1000 END,
          ',"src":"', source_ip, '","who":"', username, '","n":"', event_id % 90, '.7","ok":"',
          CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '1' END, '","secret":"x","k":',
          get_json_object(props, '$.k'), '}')""").alias("json"),
    )
