"""Parsing of log lines derived from the events, and text extraction from documents and pages."""

from pyspark.sql import functions as F

from logwarden.functions import values as v
from logwarden.operators import normalize as n
from logwarden.plans.bindings import EV, LINES, events, lines, table
from logwarden.plans.registry import query

R = lambda c: F.round(F.col(c), 6).alias(c)
YEAR = 2024
IP_RX = r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


@query("P01_parse_timestamp_multi", f"""WITH {EV}
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM ev""")
def parse_timestamp_multi(spark, sf):
    text = F.expr("""CASE event_id % 6 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
      WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.000'Z'") WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      WHEN 3 THEN concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000') WHEN 4 THEN date_format(ts, 'yyyyMMddHHmmss')
      ELSE concat(date_format(ts, 'yyyy/MM/dd'), ' invalid-time') END""")
    return events(spark, sf).select("event_id", v.parse_ts(text).alias("parsed"))


@query("P02_epoch_ms_or_s", f"""WITH {EV} SELECT event_id,
  CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS parsed FROM ev""")
def epoch_ms_or_s(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_millis("ts")).otherwise(F.unix_seconds("ts"))
    return events(spark, sf).select("event_id", v.epoch_to_ts(raw).alias("parsed"))


LOOSE = """CASE event_id % 6 WHEN 0 THEN '12' WHEN 1 THEN user_id || '.7' WHEN 2 THEN 'abc' WHEN 3 THEN 'true'
  WHEN 4 THEN 'Y' ELSE '-' || event_id END"""


@query("P03_cast_lenient", f"""WITH {EV}, x AS (SELECT event_id, {LOOSE} AS t FROM ev)
SELECT event_id, CASE WHEN contains(t, '.') THEN CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT) ELSE TRY_CAST(t AS BIGINT) END AS as_int,
  TRY_CAST(t AS DOUBLE) AS as_float, lower(t) IN ('true', 'yes', 'y', '1') AS as_bool, t AS as_str,
  CASE WHEN TRY_CAST(t AS DOUBLE) IS NULL THEN t END AS kept FROM x""")
def cast_lenient(spark, sf):
    df = events(spark, sf).selectExpr("event_id", f"{LOOSE} AS t")
    return df.select("event_id", v.cast_lenient("t", "int").alias("as_int"), v.cast_lenient("t", "float").alias("as_float"),
                     v.cast_lenient("t", "bool").alias("as_bool"), v.cast_lenient("t", "str").alias("as_str"),
                     v.kept_original("t", "float").alias("kept"))


ADDRESS = """CASE event_id % 6 WHEN 0 THEN source_ip WHEN 1 THEN '10.0.256.' || (event_id % 9) WHEN 2 THEN '10.0.01.2'
  WHEN 3 THEN '2001:DB8:0::' || (event_id % 9 + 1) WHEN 4 THEN 'host' || user_id ELSE '255.' || (user_id % 256) || '.0.1' END"""


@query("P04_validate_ip", f"""WITH {EV}, x AS (SELECT event_id, {ADDRESS} AS t FROM ev)
SELECT event_id, CASE WHEN event_id % 6 = 3 THEN '2001:db8::' || (event_id % 9 + 1)
  WHEN regexp_matches(t, '{IP_RX}') THEN t END AS ip FROM x""")
def validate_ip(spark, sf):
    return events(spark, sf).selectExpr("event_id", f"{ADDRESS} AS t").select("event_id", v.valid_ip("t").alias("ip"))


KEY_SQL = """CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' ||
  coalesce(nullif(rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0'), ''), '0')"""


@query("P05_event_id_md5", f"""WITH {EV}
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'own' || event_id ELSE 'evt_' || (epoch_us(ts) // 1000000) || '_' ||
  substr(md5({KEY_SQL} || '|' || source_ip || '|' || username || '|' || action || '|'), 1, 8) END AS event_key FROM ev""")
def event_id_md5(spark, sf):
    df = events(spark, sf).withColumn("id", F.expr("CASE WHEN event_id % 10 = 0 THEN concat('own', event_id) END"))
    return n.with_event_id(df).select("event_id", "event_key")


@query("P06_log_id_md5", f"""WITH {EV}
SELECT event_id, 'log_' || md5('{{"action":"' || action || '","event_id":' || event_id || ',"source_ip":"' || source_ip ||
  '","username":"' || username || '"}}') AS _id FROM ev""")
def log_id_md5(spark, sf):
    df = events(spark, sf).select("username", "action", "source_ip", "event_id")
    return n.with_log_id(df).select("event_id", "_id")


@query("P07_regex_normalize", f"""WITH {LINES}, x AS (SELECT *, contains(syslog, 'password for') AS a, contains(syslog, 'closed by') AS b FROM lines)
SELECT event_id, CASE WHEN a THEN username END AS "user", CASE WHEN a OR b THEN source_ip END AS source_ip,
  CASE WHEN a OR b THEN 22 END::BIGINT AS source_port, CASE WHEN a THEN regexp_extract(syslog, '(Failed|Accepted)', 1) END AS verdict,
  a OR b AS _normalized FROM x""")
def regex_normalize(spark, sf):
    patterns = [r"(?P<verdict>Failed|Accepted) password for (?P<u>\S+) from (?P<ip>\S+) port (?P<port>\d+)", r"bad(",
                r"Connection closed by (?P<ip>\S+) port (?P<port>\d+)"]
    df = lines(spark, sf).select("event_id", F.col("syslog").alias("message"))
    out = n.normalize_regex(df, patterns, {"u": "user", "ip": "source_ip", "port": "source_port"})
    return out.select("event_id", "user", "source_ip", "source_port", "verdict", "_normalized")


@query("P08_parse_syslog_line", f"""WITH {LINES}
SELECT event_id, strftime(ts, '%b %d %H:%M:%S') AS timestamp_raw, 'host' || (user_id % 20) AS hostname, 'sshd' AS process,
  CAST(event_id AS VARCHAR) AS pid, regexp_extract(syslog, ':\\s+(.+)$', 1) AS message FROM lines""")
def parse_syslog_line(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("syslog").alias("message_raw"))
    return n.parse_syslog(df).drop("message_raw")


@query("P09_classify_auth_message", f"""WITH {EV}
SELECT event_id, CASE action WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' WHEN 'view' THEN 'connection_closed' END
  AS event_type, CASE WHEN action IN ('error', 'signup') THEN username END AS username,
  CASE WHEN action IN ('error', 'signup', 'view') THEN source_ip END AS source_ip FROM ev""")
def classify_auth_message(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("syslog").alias("message_raw"))
    return n.classify_auth(n.parse_syslog(df)).select("event_id", "event_type", "username", "source_ip")


FAC = "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console'," \
      "'solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7']"
SEVS = "['emergency','alert','critical','error','warning','notice','info','debug']"
PRI = f"coalesce({FAC}[pri // 8 + 1], 'facility' || (pri // 8)) AS facility, {SEVS}[pri % 8 + 1] AS severity"


@query("P10_syslog_priority", f"WITH x AS (SELECT event_id, event_id % 200 AS pri FROM events) SELECT event_id, {PRI} FROM x")
def syslog_priority(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "event_id % 200 AS pri")
    return n.decode_pri(df).drop("pri")


RX5424 = r"^<(\d+)>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (\[.*?\]|-)? ?(.*)"


@query("P11_normalize_rfc5424", f"""WITH {LINES}, g AS (SELECT event_id, regexp_extract(rfc5424, '{RX5424}',
    ['pri', 'ver', 'ts', 'host', 'app', 'proc', 'msgid', 'sd', 'msg']) AS g, source_ip FROM lines),
x AS (SELECT event_id, g, source_ip, CAST(g.pri AS BIGINT) AS pri FROM g)
SELECT event_id, round(epoch(CAST(rtrim(g.ts, 'Z') AS TIMESTAMP)), 6) AS "timestamp", g.host AS hostname, g.app AS application,
  nullif(g.proc, '-') AS process, nullif(g.msgid, '-') AS msg_id, g.msg AS message, g.ver AS syslog_version, {PRI}, source_ip,
  CASE g.app WHEN 'sshd' THEN 'auth' WHEN 'nginx' THEN 'webserver' WHEN 'kernel' THEN 'system' END AS event_type FROM x""")
def normalize_rfc5424(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("rfc5424").alias("message"))
    return n.normalize_rfc5424(df).select(
        "event_id", R("timestamp"), "hostname", "application", "process", "msg_id", "message", "syslog_version", "facility",
        "severity", "source_ip", "event_type")


@query("P12_normalize_rfc3164", f"""WITH {LINES}, x AS (SELECT *, event_id % 192 AS pri FROM lines)
SELECT event_id, round(epoch(date_trunc('second', ts)), 6) AS "timestamp", 'host' || (user_id % 20) AS hostname,
  CASE user_id % 3 WHEN 0 THEN 'cron' WHEN 1 THEN 'login' ELSE 'iptables' END AS process, CAST(event_id AS VARCHAR) AS pid,
  {PRI}, source_ip, CASE WHEN event_id % 300 <= 255 THEN '10.1.' || (user_id % 9) || '.' || (event_id % 300) END AS dest_ip,
  CASE user_id % 3 WHEN 1 THEN 'auth' WHEN 2 THEN 'firewall' END AS event_type FROM x""")
def normalize_rfc3164(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("rfc3164").alias("message"))
    return n.normalize_rfc3164(df, YEAR).select("event_id", R("timestamp"), "hostname", "process", "pid", "facility",
                                                "severity", "source_ip", "dest_ip", "event_type")


IPS = r"""list_filter(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), lambda x: regexp_matches(x, '""" + IP_RX + "'))"


@query("P13_extract_ips", f"""WITH x AS (SELECT doc_id, {IPS} AS ips FROM documents)
SELECT doc_id, ips[1] AS source_ip, ips[2] AS dest_ip FROM x""")
def extract_ips(spark, sf):
    return n.extract_ips(table(spark, sf, "documents"), "text").select("doc_id", "source_ip", "dest_ip")


PROC = """CASE event_id % 9 WHEN 0 THEN 'SSHD' WHEN 1 THEN 'sshd-session' WHEN 2 THEN 'pam_auth' WHEN 3 THEN 'login' WHEN 4 THEN 'firewalld'
  WHEN 5 THEN 'iptables' WHEN 6 THEN 'nginx' WHEN 7 THEN 'kernel' ELSE 'cron' END"""


@query("P14_process_to_event_type", f"""SELECT event_id, CASE WHEN event_id % 9 <= 3 THEN 'auth' WHEN event_id % 9 <= 5 THEN 'firewall'
  WHEN event_id % 9 = 6 THEN 'webserver' WHEN event_id % 9 = 7 THEN 'system' END AS event_type FROM events""")
def process_to_event_type(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{PROC} AS process")
    return n.event_type_from_process(df).drop("process")


@query("P15_flatten_json", """SELECT event_id, 'user' || user_id AS actor_name, user_id AS actor_detail_id,
  event_type AS actor_detail_kind, value AS metric, struct_pack(a := event_type, b := user_id)::VARCHAR AS kept FROM events""")
def flatten_json(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id",
        F.struct(F.concat(F.lit("user"), "user_id").alias("name"),
                 F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("detail")).alias("actor"),
        F.col("value").alias("metric"),
        F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("b")).alias("kept"))
    out = n.flatten(nested, "_", ["kept"])
    text = F.concat(F.lit("{'a': "), F.col("kept.a"), F.lit(", 'b': "), F.col("kept.b").cast("string"), F.lit("}"))
    return out.withColumn("kept", text)


@query("P16_normalize_json", f"""WITH {EV}
SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) / 1000 ELSE epoch_us(ts) // 1000000 END, 6) AS "timestamp", source_ip,
  username AS "user", CAST(event_id % 90 AS BIGINT) AS bytes_in, event_id % 3 <> 1 AS ok,
  'k=' || json_extract_string(props, '$.k') AS extra, TRUE AS _normalized FROM ev""")
def normalize_json(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("json").alias("message"))
    out = n.normalize_json(df, {"ts": "timestamp", "src": "source_ip", "who": "user", "n": "bytes_in", "ok": "ok"},
                           ["secret"], {"ok": "bool"})
    pairs = F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("event_id", R("timestamp"), "source_ip", "user", "bytes_in", "ok", pairs.alias("extra"), "_normalized")


@query("P17_parse_cef_header", f"""WITH {EV}
SELECT event_id, '0' AS cef_version, 'Acme' AS vendor, 'FW' AS product, '1.0' AS device_version,
  CAST(event_id % 100 AS VARCHAR) AS signature_id, action AS event_name, CAST(user_id % 11 AS VARCHAR) AS severity,
  'security' AS event_type FROM ev""")
def parse_cef_header(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("cef").alias("message"))
    return n.parse_cef(df).drop("message", "extensions")


ACTS = """CASE event_id % 5 WHEN 0 THEN '{0}' WHEN 1 THEN 'blocked' WHEN 2 THEN 'deny' WHEN 3 THEN '{1}' ELSE '{2}' END"""


@query("P18_parse_cef_extensions", f"""WITH {EV}, x AS (SELECT event_id, unnest([
  {{'k': 'source_ip', 'v': source_ip}}, {{'k': 'dest_ip', 'v': '2.1.2.' || (user_id % 250)}},
  {{'k': 'source_port', 'v': CAST(1024 + event_id % 5000 AS VARCHAR)}}, {{'k': 'dest_port', 'v': '443'}},
  {{'k': 'source_user', 'v': username}}, {{'k': 'msg', 'v': action || ' seen here'}},
  {{'k': 'action', 'v': {ACTS.format('Permitted', 'warned', 'ALLOW')}}}, {{'k': 'rt', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}}]) AS p FROM ev)
SELECT event_id, p.k AS "key", p.v AS "value" FROM x""")
def parse_cef_extensions(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("cef").alias("message"))
    return n.cef_extensions(n.parse_cef(df)).select("event_id", F.explode("fields").alias("key", "value"))


@query("P19_cef_standardize", f"""WITH {EV}
SELECT event_id, round((epoch_us(ts) // 1000) / 1000, 6) AS "timestamp", source_ip, '2.1.2.' || (user_id % 250) AS dest_ip,
  CAST(1024 + event_id % 5000 AS BIGINT) AS source_port, CAST(443 AS BIGINT) AS dest_port, username AS "user",
  {ACTS.format('allow', 'alert', 'allow')} AS action FROM ev""")
def cef_standardize(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("cef").alias("message"))
    out = n.standardize_cef(n.cef_extensions(n.parse_cef(df)))
    return out.select("event_id", R("timestamp"), "source_ip", "dest_ip", "source_port", "dest_port", "user", "action")


BROWSER = """CASE event_id % 7 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' WHEN 3 THEN 'Firefox'
  WHEN 4 THEN 'Internet Explorer' WHEN 5 THEN 'Edge' ELSE 'Other' END AS browser,
  CASE event_id % 7 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Linux' WHEN 2 THEN 'iOS' WHEN 3 THEN 'Android' WHEN 4 THEN 'Windows'
  WHEN 5 THEN 'macOS' ELSE 'Other' END AS os, event_id % 7 IN (2, 3) AS is_mobile"""
CLASSES = "['informational', 'success', 'redirect', 'client_error', 'server_error'][1 + event_id % 5]"


@query("P20_parse_clf", f"""WITH {EV}
SELECT event_id, source_ip, CASE WHEN event_id % 4 <> 0 THEN username END AS "user", round(epoch(date_trunc('second', ts)), 6) AS "timestamp",
  CAST(100 * (1 + event_id % 5) + 4 AS BIGINT) AS status_code, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id END AS bytes_out,
  'GET' AS method, '/p/' || (event_id % 60) AS path, 'HTTP/1.1' AS protocol, {BROWSER}, {CLASSES} AS status,
  'web_access' AS event_type FROM ev""")
def parse_clf(spark, sf):
    df = lines(spark, sf).select("event_id", F.col("clf").alias("message"))
    return n.parse_weblog(df).select("event_id", "source_ip", "user", R("timestamp"), "status_code", "bytes_out", "method", "path",
                                     "protocol", "browser", "os", "is_mobile", "status", "event_type")


@query("P21_parse_nginx_json", f"""WITH {EV}
SELECT event_id, source_ip, username AS "user", round(epoch(date_trunc('second', ts)), 6) AS "timestamp",
  CAST(100 * (1 + event_id % 5) + 1 AS BIGINT) AS status_code, event_id AS bytes_out, user_id % 10 + 0.5::DOUBLE AS duration,
  'POST' AS method, '/q/' || (event_id % 60) AS path, 'HTTP/2' AS protocol, 'h' || (user_id % 3) AS host, {CLASSES} AS status,
  {BROWSER} FROM ev""")
def parse_nginx_json(spark, sf):
    """The user agents of the web log lines, inside the JSON lines."""
    agent = F.regexp_extract("clf", '"([^"]*)"$', 1)
    df = lines(spark, sf).select("event_id", F.replace("nginx", F.lit("curl/8.0"), agent).alias("message"))
    return n.parse_nginx(df).select("event_id", "source_ip", "user", R("timestamp"), "status_code", "bytes_out", "duration", "method",
                                    "path", "protocol", "host", "status", "browser", "os", "is_mobile")


REQ = """CASE event_id % 4 WHEN 0 THEN 'GET /a/' || user_id || ' HTTP/1.1' WHEN 1 THEN 'HEAD   /b' WHEN 2 THEN ' PUT ' ELSE '' END"""


@query("P22_parse_request_line", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'PUT' ELSE '' END AS method,
  CASE event_id % 4 WHEN 0 THEN '/a/' || user_id WHEN 1 THEN '/b' ELSE '' END AS path,
  CASE event_id % 4 WHEN 0 THEN 'HTTP/1.1' ELSE '' END AS protocol FROM events""")
def parse_request_line(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{REQ} AS r")
    return df.select("event_id", v.parse_request("r").alias("q")).select("event_id", "q.*")


@query("P23_parse_user_agent", f"SELECT event_id, {BROWSER} FROM events")
def parse_user_agent(spark, sf):
    df = lines(spark, sf).select("event_id", F.regexp_extract("clf", '"([^"]*)"$', 1).alias("ua"))
    return df.select("event_id", v.parse_ua("ua").alias("q")).select("event_id", "q.*")


@query("P24_http_status_class", """SELECT event_id, CASE WHEN event_id % 700 BETWEEN 100 AND 199 THEN 'informational'
  WHEN event_id % 700 BETWEEN 200 AND 299 THEN 'success' WHEN event_id % 700 BETWEEN 300 AND 399 THEN 'redirect'
  WHEN event_id % 700 BETWEEN 400 AND 499 THEN 'client_error' WHEN event_id % 700 BETWEEN 500 AND 599 THEN 'server_error' END AS status FROM events""")
def http_status_class(spark, sf):
    return table(spark, sf, "events").select("event_id", v.status_class(F.col("event_id") % 700).alias("status"))


WIN_EVENT = "4600 + event_id % 200"


@query("P25_normalize_windows_event", f"""WITH {EV}, x AS (SELECT *, {WIN_EVENT} AS eid, event_id % 7 AS lvl FROM ev)
SELECT event_id AS record_id, CAST(eid AS VARCHAR) AS event_id, 'host' || (user_id % 20) AS hostname,
  coalesce(['unknown', 'critical', 'error', 'warning', 'info', 'verbose'][lvl + 1], 'unknown') AS severity,
  CASE eid WHEN 4624 THEN 'successful_login' WHEN 4625 THEN 'failed_login' WHEN 4634 THEN 'account_logoff'
    WHEN 4648 THEN 'explicit_credential_login' WHEN 4720 THEN 'account_created' WHEN 4722 THEN 'account_enabled'
    WHEN 4723 THEN 'password_change' WHEN 4724 THEN 'password_reset' WHEN 4725 THEN 'account_disabled'
    WHEN 4726 THEN 'account_deleted' WHEN 4728 THEN 'member_added_to_security_group' WHEN 4732 THEN 'member_added_to_local_group'
    WHEN 4740 THEN 'account_locked_out' WHEN 4767 THEN 'account_unlocked' END AS event_type,
  CASE WHEN event_type IS NOT NULL THEN 'security' END AS category, username AS "user",
  CASE WHEN event_id % 5 = 0 THEN 'fe80::' || (event_id % 9 + 1) ELSE source_ip END AS source_ip,
  round(epoch(date_trunc('second', ts)), 6) AS "timestamp", action AS Extra FROM x""")
def normalize_windows_event(spark, sf):
    raw = events(spark, sf).selectExpr(
        "event_id AS EventRecordID", f"string({WIN_EVENT}) AS EventID", "concat('host', user_id % 20) AS Computer",
        "string(event_id % 7) AS Level", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS TimeCreated_SystemTime",
        "map(if(event_id % 2 = 0, 'TargetUserName', 'User'), username, 'ClientIP', "
        "if(event_id % 5 = 0, concat('FE80:0:0::', event_id % 9 + 1), source_ip)) AS EventData",
        "action AS Extra", "'x' AS Secret")
    out = n.normalize_windows(raw, ["Secret"])
    return out.select("record_id", "event_id", "hostname", "severity", "event_type", "category", "user", "source_ip",
                      R("timestamp"), "Extra")


LEVEL = "CASE event_id % 9 WHEN 8 THEN 'abc' ELSE CAST(event_id % 9 AS {t}) END"


@query("P26_windows_severity", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN 'critical' WHEN 2 THEN 'error'
  WHEN 3 THEN 'warning' WHEN 4 THEN 'info' WHEN 5 THEN 'verbose' WHEN 8 THEN NULL ELSE 'unknown' END AS severity FROM events""")
def windows_severity(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{LEVEL.format(t='STRING')} AS level")
    return df.select("event_id", v.windows_severity("level").alias("severity"))


@query("P27_windows_security_event", f"""WITH n AS (SELECT * FROM (VALUES (4624, 'successful_login'), (4625, 'failed_login'),
  (4634, 'account_logoff'), (4648, 'explicit_credential_login'), (4720, 'account_created'), (4722, 'account_enabled'),
  (4723, 'password_change'), (4724, 'password_reset'), (4725, 'account_disabled'), (4726, 'account_deleted'),
  (4728, 'member_added_to_security_group'), (4732, 'member_added_to_local_group'), (4740, 'account_locked_out'),
  (4767, 'account_unlocked')) AS t(id, name))
SELECT event_id, name AS event_type FROM events LEFT JOIN n ON id = {WIN_EVENT}""")
def windows_security_event(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{WIN_EVENT} AS code")
    return df.select("event_id", v.security_event("code").alias("event_type"))


@query("P28_coalesce_nested_fields", f"""WITH {EV} SELECT event_id, CASE event_id % 3 WHEN 0 THEN username WHEN 1 THEN 'svc' || user_id END AS "user",
  CASE WHEN event_id % 2 = 0 THEN source_ip END AS source_ip FROM ev""")
def coalesce_nested_fields(spark, sf):
    data = F.expr("""map(CASE event_id % 3 WHEN 0 THEN 'TargetUserName' WHEN 1 THEN 'UserName' ELSE 'Other' END,
      CASE event_id % 3 WHEN 0 THEN username ELSE concat('svc', user_id) END, 'User',
      CASE WHEN event_id % 3 < 2 THEN 'late' END, if(event_id % 2 = 0, 'IpAddress', 'Nothing'), source_ip)""")
    df = events(spark, sf).select("event_id", data.alias("data"))
    return df.select("event_id", n.first_present("data", n.WINDOWS_USER_KEYS).alias("user"),
                     n.first_present("data", n.WINDOWS_IP_KEYS).alias("source_ip"))


@query("P29_extract_by_candidates", f"""WITH {EV}
SELECT event_id, round(epoch(date_trunc('second', ts)), 6) AS "timestamp", CASE WHEN event_id % 2 = 0 THEN source_ip ELSE '9.9.9.9' END AS source_ip,
  CASE WHEN event_id % 3 = 0 THEN '8.8.8.8' END AS dest_ip, username FROM ev""")
def extract_by_candidates(spark, sf):
    raw = events(spark, sf).selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS time", "CASE WHEN event_id % 2 = 0 THEN source_ip END AS source_ip",
        "'9.9.9.9' AS client_ip", "CASE WHEN event_id % 3 = 0 THEN '8.8.8.8' END AS server_ip", "username AS account")
    return n.to_mini_schema(raw).select("event_id", R("timestamp"), "source_ip", "dest_ip", "username")


@query("P30_map_to_schema", f"""WITH {EV} SELECT event_id, source_ip, username, action, status, CAST(NULL AS VARCHAR) AS resource FROM ev""")
def map_to_schema(spark, sf):
    raw = events(spark, sf).selectExpr("event_id", "source_ip AS SourceAddress", "username AS AccountName", "action", "status")
    return n.to_schema(raw, {"SourceAddress": "source_ip", "AccountName": "username", "Missing": "resource"},
                       ["event_id", "source_ip", "username", "action", "status", "resource"])


MIXED = """CASE event_id % 6 WHEN 0 THEN rfc5424 WHEN 1 THEN rfc3164 WHEN 2 THEN cef WHEN 3 THEN clf WHEN 4 THEN json
  ELSE 'garbage ' || action END"""


@query("P31_normalizer_cascade", f"""WITH {EV}
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'cef' WHEN 3 THEN 'weblog'
    WHEN 4 THEN 'json' END AS _format, CASE WHEN event_id % 6 <> 5 THEN source_ip END AS source_ip,
  CASE WHEN event_id % 6 IN (2, 4) THEN username WHEN event_id % 6 = 3 AND event_id % 4 <> 0 THEN username END AS "user",
  CASE WHEN event_id % 6 < 2 THEN 'host' || (user_id % 20) END AS hostname,
  CASE WHEN event_id % 6 = 3 THEN CAST(100 * (1 + event_id % 5) + 4 AS BIGINT) END AS status_code,
  CASE WHEN event_id % 6 = 2 THEN {ACTS.format('allow', 'alert', 'allow')} END AS action,
  CASE WHEN event_id % 6 <> 5 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) END AS second, event_id % 6 <> 5 AS _normalized FROM ev""")
def normalizer_cascade(spark, sf):
    df = lines(spark, sf).select("event_id", F.expr(MIXED).alias("message"))
    out = n.normalize_all(df, year=YEAR, json_mapping={"ts": "timestamp", "src": "source_ip", "who": "user"})
    return out.select("event_id", "_format", "source_ip", "user", "hostname", "status_code", "action",
                      F.floor("timestamp").alias("second"), "_normalized")


OTHERS = """CASE event_id % 5 WHEN 0 THEN nginx WHEN 1 THEN {xml} WHEN 2 THEN 'login by ' || username || ' at ' || source_ip
  WHEN 3 THEN 'old text' ELSE 'neither' END"""


@query("P31_cascade_more", f"""WITH {EV} SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN 'nginx' WHEN 1 THEN 'windows' WHEN 2 THEN 'regex' END AS _format,
  CASE WHEN event_id % 5 < 3 THEN source_ip WHEN event_id % 5 = 3 THEN '2001:db8::7' END AS source_ip,
  CASE WHEN event_id % 5 < 3 THEN username WHEN event_id % 5 = 3 THEN 'kept' END AS "user",
  CASE WHEN event_id % 5 = 1 THEN 'host' || (user_id % 20) END AS hostname,
  CASE WHEN event_id % 5 = 0 THEN CAST(100 * (1 + event_id % 5) + 1 AS BIGINT) END AS status_code,
  CASE WHEN event_id % 5 < 2 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) END AS second, event_id % 5 < 4 AS _normalized FROM ev""")
def cascade_more(spark, sf):
    """Access-log JSON, Windows events, a pattern of the caller, rows normalized before, and text that nothing accepts."""
    from logwarden.plans.sources_queries import XML

    xml = F.expr(XML)
    df = lines(spark, sf).join(events(spark, sf).select("event_id", xml.alias("xml")), "event_id")
    old = F.col("event_id") % 5 == 3
    df = df.select("event_id", F.expr(OTHERS.format(xml="xml")).alias("message"), old.alias("_normalized"),
                   F.when(old, "2001:db8::7").alias("source_ip"), F.when(old, "kept").alias("user"))
    out = n.normalize_all(df, year=YEAR, patterns=[r"^login by (?P<user>\S+) at (?P<source_ip>\S+)$"],
                          order=["windows", "nginx", "regex", "json", "rfc5424"])
    return out.select("event_id", "_format", "source_ip", "user", "hostname", "status_code", F.floor("timestamp").alias("second"), "_normalized")


@query("P31_quarantine", f"WITH {EV} SELECT event_id, 'garbage ' || action AS raw_message FROM ev WHERE event_id % 6 = 5")
def quarantined(spark, sf):
    df = lines(spark, sf).select("event_id", F.expr(MIXED).alias("message"))
    out = n.normalize_all(df, year=YEAR, json_mapping={"ts": "timestamp", "src": "source_ip", "who": "user"})
    return n.quarantine(out).select("event_id", "raw_message")


@query("P32_extract_iocs", rf"""WITH x AS (
  SELECT 'url' AS kind, unnest(regexp_extract_all(text, 'https?://[^\s"''<>]+')) AS indicator FROM documents
  UNION ALL SELECT 'ip', unnest({IPS}) FROM documents
  UNION ALL SELECT 'hash', unnest(regexp_extract_all(text, '\b(?:[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}})\b')) FROM documents
  UNION ALL SELECT 'domain', unnest(regexp_extract_all(text, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}\b'))
    FROM documents)
SELECT kind, indicator, count(*) AS occurrences FROM x GROUP BY 1, 2""")
def extract_iocs(spark, sf):
    return n.extract_iocs(table(spark, sf, "documents"), "text")


HOST = "regexp_extract(url, 'https?://([^/?#]+)', 1)"


@query("P33_valid_domain", rf"""WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 3 THEN '-' || {HOST} ELSE {HOST} END AS host FROM pages)
SELECT page_id, host, regexp_matches(host, '^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}$') AS valid FROM x""")
def valid_domain(spark, sf):
    df = table(spark, sf, "pages").selectExpr("page_id", f"CASE page_id % 4 WHEN 3 THEN '-' || {HOST} ELSE {HOST} END AS host")
    return df.select("page_id", "host", v.valid_domain("host").alias("valid"))


@query("P34_hash_column", "SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_column(spark, sf):
    return table(spark, sf, "documents").select("doc_id", v.sha256("text").alias("digest"))


@query("P35_redact_sensitive", f"""WITH {EV}, x AS (SELECT event_id, unnest([{{'k': 'user', 'v': username}}, {{'k': 'password', 'v': '***REDACTED***'}},
  {{'k': 'token', 'v': '***REDACTED***'}}, {{'k': 'ip', 'v': source_ip}}]) AS p FROM ev)
SELECT event_id, p.k AS "key", p.v AS "value" FROM x""")
def redact_sensitive(spark, sf):
    df = events(spark, sf).selectExpr("event_id", "map('user', username, 'password', action, 'token', props, 'ip', source_ip) AS vars")
    return n.redact(df, "vars", ["password", "token"]).select("event_id", F.explode("vars").alias("key", "value"))
