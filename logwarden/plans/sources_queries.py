"""Sources and sinks over files and payloads that Spark writes from the given tables."""

import datetime

from pyspark.sql import functions as F, types as T

from logwarden.operators import normalize as n
from logwarden.operators.collect import preprocess
from logwarden.plans.bindings import EV, INC, LINES, events, incidents, lines, table
from logwarden.plans.registry import query
from logwarden.session import scratch_path
from logwarden.sources import files, incremental as inc_, payloads as p, sinks
from logwarden.sources.tables import UpsertTable

at = datetime.datetime
COLS = ["event_id", "username", "source_ip", "action", "duration"]
REC = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("username", T.StringType()),
                    T.StructField("source_ip", T.StringType()), T.StructField("action", T.StringType()),
                    T.StructField("duration", T.DoubleType())])
REC_SQL = "event_id, username, source_ip, action, duration"


#: Ids per file of ``_write_arrays``.
PAGE = 2_000


def _rec(spark, sf):
    return events(spark, sf).select(*COLS)


def _write_arrays(df, path):
    """Files that each hold one array over several lines, a record a line, the first behind the bracket."""
    pages = df.groupBy(F.expr(f"event_id div {PAGE}").alias("page")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*COLS))), ",\n"), F.lit("]")).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("S01_scan_json", f"""WITH {EV} SELECT event_id, username, source_ip, action, CASE WHEN event_id % 20 <> 1 THEN duration END AS duration
  FROM ev WHERE event_id % 20 <> 0""")
def scan_json(spark, sf):
    """The events as gzipped JSON lines, every twentieth line cut in half: broken lines must drop out. Another twentieth has
    text where a number belongs: the field becomes null and the record stays."""
    path = scratch_path(spark)
    line = F.to_json(F.struct(*COLS))
    wrong = F.to_json(F.struct(*COLS[:-1], F.lit("unknown").alias("duration")))
    k = F.col("event_id") % 20
    text = F.when(k == 0, F.substring(line, 1, 25)).when(k == 1, wrong).otherwise(line)
    _rec(spark, sf).select(text.alias("value")).write.option("compression", "gzip").text(path)
    return files.read_json(spark, path, REC)


@query("S01_scan_json_array", f"WITH {EV} SELECT {REC_SQL} FROM ev")
def scan_json_array(spark, sf):
    """Even pages are files that hold one array over several lines, odd ones are lines that each hold an array of 50 ids."""
    path = scratch_path(spark)
    df, even = _rec(spark, sf), F.col("event_id") % (2 * PAGE) < PAGE
    _write_arrays(df.filter(even), f"{path}/spread")
    pages = df.filter(~even).groupBy(F.expr("event_id div 50").alias("page")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*COLS))), ","), F.lit("]")).alias("value"))
    pages.select("value").write.text(f"{path}/lines")
    return files.read_json(spark, [f"{path}/spread", f"{path}/lines"], REC)


@query("S02_scan_csv", f"WITH {EV} SELECT {REC_SQL} FROM ev")
def scan_csv(spark, sf):
    """The header names the columns in another order than the schema."""
    path = scratch_path(spark)
    _rec(spark, sf).select(*reversed(COLS)).write.option("header", True).csv(path)
    return files.read_csv(spark, path, REC)


@query("S03_scan_syslog_text", f"""WITH {LINES} SELECT 'host' || (user_id % 20) AS hostname, CAST(event_id AS VARCHAR) AS pid,
  regexp_extract(syslog, ':\\s+(.+)$', 1) AS message FROM lines""")
def scan_syslog_text(spark, sf):
    path = scratch_path(spark)
    lines(spark, sf).select("syslog").write.text(path)
    return n.parse_syslog(files.read_text(spark, path)).select("hostname", "pid", "message")


XML = """concat('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Audit"/><EventID>',
  4600 + event_id % 200, '</EventID><Level>', event_id % 6, '</Level><TimeCreated SystemTime="',
  date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"/><EventRecordID>', event_id, '</EventRecordID><Channel>Security</Channel><Computer>host',
  user_id % 20, '</Computer></System><EventData><Data Name="TargetUserName">', username, '</Data><Data Name="IpAddress">', source_ip,
  '</Data></EventData></Event>')"""
XML_SQL = f"""WITH {EV} SELECT CAST(event_id AS VARCHAR) AS "EventRecordID", CAST(4600 + event_id % 200 AS VARCHAR) AS "EventID",
  'host' || (user_id % 20) AS "Computer", strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "TimeCreated_SystemTime", username AS "user",
  source_ip FROM ev"""


def _win(df):
    return df.select("EventRecordID", "EventID", "Computer", "TimeCreated_SystemTime",
                     n.first_present("EventData", n.WINDOWS_USER_KEYS).alias("user"),
                     n.first_present("EventData", n.WINDOWS_IP_KEYS).alias("source_ip"))


@query("S04_scan_windows_xml", XML_SQL)
def scan_windows_xml(spark, sf):
    path = scratch_path(spark)
    events(spark, sf).select(F.expr(XML).alias("value")).write.text(path)
    return _win(files.read_windows_xml(spark, path))


@query("S04_windows_xml_text", XML_SQL + " WHERE event_id % 9 <> 0")
def windows_xml_text(spark, sf):
    """Events embedded in other text; every ninth is broken off."""
    cut = F.when(F.col("event_id") % 9 == 0, F.substring(F.expr(XML), 1, 180)).otherwise(F.expr(XML))
    df = events(spark, sf).select(F.concat(F.lit("junk "), cut, F.lit(" tail")).alias("blob"))
    return _win(files.windows_events(df, "blob"))


FILES = """CASE user_id % 6 WHEN 0 THEN 'a.json' WHEN 1 THEN 'b.csv.gz' WHEN 2 THEN 'c.log' WHEN 3 THEN 'd.evtx' WHEN 4 THEN 'e.xyz' ELSE 'f' END"""
BODY = """CASE user_id % 4 WHEN 0 THEN concat('{"x":', event_id, '}') WHEN 1 THEN concat('a,b,', event_id) ELSE concat('line ', event_id) END"""


@query("S05_detect_format", f"""WITH l AS (SELECT user_id || {FILES} AS source_file, event_id, user_id, {BODY} AS m,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT source_file, CASE any_value(user_id % 6) WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'syslog' WHEN 3 THEN 'windows_event'
  WHEN 4 THEN 'unknown' ELSE CASE WHEN bool_or(starts_with(m, '{{')) THEN 'json' WHEN bool_or(contains(m, ',')) THEN 'csv'
  ELSE 'syslog' END END AS format FROM l WHERE k <= 5 GROUP BY source_file""")
def detect_format(spark, sf):
    df = table(spark, sf, "events").selectExpr(f"concat(user_id, {FILES}) AS source_file", "event_id AS line_no", f"{BODY} AS message")
    return files.classify_files(df)


@query("S06_scan_log_dir", f"""WITH {LINES} SELECT syslog AS message, event_id % 2 = 0 AS compressed FROM lines""")
def scan_log_dir(spark, sf):
    """A directory tree: half the lines in gz files, with blank lines in between."""
    path = scratch_path(spark)
    df = lines(spark, sf)
    blank = lambda part: part.select(F.concat(F.col("syslog"), F.lit("\n\n  ")).alias("value"))
    blank(df.filter("event_id % 2 = 0")).write.option("compression", "gzip").text(f"{path}/a")
    blank(df.filter("event_id % 2 = 1")).write.text(f"{path}/b")
    return files.read_log_dir(spark, path, "*.txt*", recursive=True).select("message", "compressed")


@query("S08_union_files", f"""WITH {EV} SELECT event_id, username, action, CASE WHEN event_id % 2 = 0 THEN duration END AS duration,
  CASE WHEN event_id % 2 = 1 THEN status END AS status FROM ev""")
def union_files(spark, sf):
    df = events(spark, sf)
    return files.union_files([
        df.filter("event_id % 2 = 0").select("event_id", "username", "action", "duration"),
        df.filter("event_id % 2 = 1").select("status", "action", "username", "event_id"),
    ])


@query("S08_read_many", f"""WITH {EV} SELECT event_id, username, source_ip, action, duration, NULL::VARCHAR AS message_raw FROM ev WHERE event_id % 3 < 2
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'line ' || event_id FROM ev WHERE event_id % 3 = 2""")
def read_many(spark, sf):
    """JSON lines, JSON arrays over several lines, a CSV and text lines, and a path that does not exist."""
    paths = {k: scratch_path(spark) for k in ("json", "csv", "syslog")}
    df, k = _rec(spark, sf), F.col("event_id") % 3
    df.filter((k == 0) & (F.col("event_id") % 2 == 0)).write.json(paths["json"] + "/lines")
    _write_arrays(df.filter((k == 0) & (F.col("event_id") % 2 == 1)), paths["json"] + "/spread")
    df.filter(k == 1).select(*reversed(COLS)).write.option("header", True).csv(paths["csv"])
    df.filter(k == 2).select(F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("value")).write.text(paths["syslog"])
    return files.read_many(spark, {"json": [paths["json"] + "/lines", paths["json"] + "/spread", paths["json"] + "-gone"], "csv": [paths["csv"]], "syslog": [paths["syslog"]]}, REC)


def _pages(spark, sf):
    """Pages of 50 ids in several payload shapes."""
    item = F.to_json(F.struct("event_id", "username"))
    body = F.array_join(F.array_sort(F.collect_list(item)), ",")
    text = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("line "), F.col("event_id").cast("string")))), "\n")
    k = F.col("page") % 5
    paged = events(spark, sf).groupBy(F.expr("event_id div 50").alias("page")).agg(body.alias("b"), text.alias("t"))
    wrap = (F.when(k == 0, F.concat(F.lit("["), "b", F.lit("]"))).when(k == 1, F.concat(F.lit('{"n":1,"data":['), "b", F.lit("]}")))
            .when(k == 2, F.concat(F.lit('{"events":['), "b", F.lit("]}")))
            .when(k == 3, F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit("}")))
            .otherwise(F.concat(F.lit("\n"), "t", F.lit("\n \n"))))
    return paged.select("page", wrap.alias("payload"), F.col("b").alias("body"), F.col("t").alias("text"))


@query("S09_unwrap_api_payload", f"""WITH {EV}, x AS (SELECT *, event_id // 50 AS page FROM ev)
SELECT page, CASE WHEN page % 5 < 3 THEN event_id END AS event_id, CASE WHEN page % 5 < 3 THEN username END AS username,
  CASE WHEN page % 5 = 4 THEN 'line ' || event_id END AS raw FROM x WHERE page % 5 <> 3
UNION ALL SELECT DISTINCT page, NULL, NULL, NULL FROM x WHERE page % 5 = 3""")
def unwrap_api_payload(spark, sf):
    df = p.unwrap_payload(_pages(spark, sf).select("page", "payload"), "payload")
    rec = F.from_json("record", "event_id bigint, username string")
    return df.select("page", rec["event_id"].alias("event_id"), rec["username"].alias("username"), "raw")


@query("S10_json_path_extract", f"""WITH {EV} SELECT event_id // 50 AS page, event_id, username FROM ev WHERE event_id // 50 % 3 <> 0""")
def json_path_extract(spark, sf):
    body = F.when(F.col("page") % 3 == 0, F.lit('{"a":{"b":7}}')).otherwise(
        F.concat(F.lit('{"a":{"x":1,"b":['), "body", F.lit("]}}")))
    df = p.extract_path(_pages(spark, sf).select("page", body.alias("payload")), "payload", "a.b")
    rec = F.from_json("record", "event_id bigint, username string")
    return df.select("page", rec["event_id"].alias("event_id"), rec["username"].alias("username"))


@query("S11_xml_path_extract", f"""WITH {EV} SELECT event_id // 50 AS page, CAST(event_id AS VARCHAR) AS event_id, username AS "user" FROM ev""")
def xml_path_extract(spark, sf):
    item = F.concat(F.lit("<log><event_id>"), F.col("event_id").cast("string"), F.lit("</event_id><user>"), "username", F.lit("</user></log>"))
    df = events(spark, sf).groupBy(F.expr("event_id div 50").alias("page")).agg(
        F.concat(F.lit("<r><inner>"), F.array_join(F.collect_list(item), ""), F.lit("</inner></r>")).alias("payload"))
    return p.extract_xml(df, "payload", ["event_id", "user"])


@query("S12_text_lines_extract", r"""WITH x AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS message FROM documents)
SELECT doc_id, message FROM x WHERE trim(message, ' ') <> ''""")
def text_lines_extract(spark, sf):
    return p.explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("S13_columnar_payload_to_rows", f"""WITH {EV} SELECT event_id // 50 AS page, CAST(event_id AS VARCHAR) AS event_id, username AS "user" FROM ev""")
def columnar_payload_to_rows(spark, sf):
    row = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"'), "username", F.lit('"]'))
    df = events(spark, sf).groupBy(F.expr("event_id div 50").alias("page")).agg(
        F.concat(F.lit('{"columns":[{"name":"id"},{"name":"who"}],"rows":['), F.array_join(F.collect_list(row), ","), F.lit("]}")).alias("payload"))
    out = p.rows_from_columnar(df, "payload")
    return out.select("page", F.col("record")["id"].alias("event_id"), F.col("record")["who"].alias("user"))


@query("S14_incremental_high_water", f"""WITH {EV} SELECT event_id, ts FROM ev
WHERE ts > (SELECT max(ts) FROM ev WHERE ts < TIMESTAMP '2024-01-21')""")
def incremental_high_water(spark, sf):
    """First poll up to a time, its mark stored; the second poll reads only what is newer."""
    df, path = events(spark, sf), scratch_path(spark)
    inc_.save_mark(spark, path, "events", inc_.high_water(df.filter(F.col("ts") < F.lit(at(2024, 1, 21)))))
    return inc_.since(df, inc_.load_mark(spark, path, "events")).select("event_id", "ts")


@query("S15_time_range_pushdown", f"""WITH {EV} SELECT event_id, ts FROM ev
WHERE ts BETWEEN TIMESTAMP '2024-01-14 22:00:00' AND TIMESTAMP '2024-01-15 04:00:00'""")
def time_range_pushdown(spark, sf):
    return inc_.in_timespan(events(spark, sf), 360, at(2024, 1, 15, 4)).select("event_id", "ts")


@query("S16_sink_upsert", f"""WITH {INC}, ch AS (SELECT c_custkey * 15 AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status,
  'C' || c_custkey AS title FROM customer)
SELECT coalesce(inc.id, ch.id) AS id, coalesce(ch.status, inc.status) AS status, coalesce(ch.title, inc.title) AS title,
  inc.severity, coalesce(inc.created_at, TIMESTAMP '2002-01-01') AS created_at FROM inc FULL JOIN ch ON inc.id = ch.id
WHERE coalesce(inc.id, ch.id) % 11 <> 0""")
def sink_upsert(spark, sf):
    """Merge, write, read back, then delete every eleventh id."""
    target = incidents(spark, sf).select("id", "status", "title", "severity", "created_at")
    changes = table(spark, sf, "customer").selectExpr(
        "c_custkey * 15 AS id", "CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status", "concat('C', c_custkey) AS title")
    merged = sinks.upsert(target, changes, "id", ts="created_at", now=at(2002, 1, 1))
    path = scratch_path(spark)
    merged.write.parquet(path)
    stored = spark.read.schema(merged.schema).parquet(path)
    return sinks.delete_ids(stored, stored.filter("id % 11 = 0"), "id")


@query("S16_upsert_table", f"""WITH {INC}, ch AS (SELECT c_custkey * 15 AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status,
  'C' || c_custkey AS title FROM customer),
m AS (SELECT coalesce(inc.id, ch.id) AS id, coalesce(ch.status, inc.status) AS status, coalesce(ch.title, inc.title) AS title,
  inc.severity, coalesce(inc.created_at, TIMESTAMP '2002-01-01') AS created_at FROM inc FULL JOIN ch ON inc.id = ch.id)
SELECT id, CASE WHEN id % 13 = 0 THEN 'reopened' ELSE status END AS status, CASE WHEN id % 13 = 0 THEN 'last of 2' ELSE title END AS title,
  severity, created_at FROM m WHERE id % 11 <> 0""")
def upsert_table(spark, sf):
    """Bulk load, partial update, deletion, two changes of one id in a batch, and that batch once more, read back from storage."""
    target = incidents(spark, sf).select("id", "status", "title", "severity", "created_at")
    store = UpsertTable(spark, scratch_path(spark), "id", target.schema, buckets=8)
    store.merge(target, writer="load", batch=0)
    changes = table(spark, sf, "customer").selectExpr(
        "c_custkey * 15 AS id", "CASE WHEN c_nationkey % 2 = 0 THEN 'closed' END AS status", "concat('C', c_custkey) AS title")
    store.merge(changes, writer="load", batch=1, defaults={"created_at": at(2002, 1, 1)})
    store.delete(store.read().filter("id % 11 = 0"), writer="load", batch=2)
    twice = store.read().filter("id % 13 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    twice = twice.select("id", F.when(F.col("k") == 1, "reopened").alias("status"), F.concat(F.lit("last of "), F.col("k")).alias("title"), "k")
    store.merge(twice, writer="load", batch=3, order="k")
    store.merge(changes, writer="load", batch=1)
    return store.read()


@query("S17_sink_results", f"""WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, round(sum(duration), 4) AS total FROM ev GROUP BY 1""")
def sink_results(spark, sf):
    path = scratch_path(spark)
    sinks.write_features(events(spark, sf).select("event_id", "ts", "duration"), path)
    out = spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("total"))
    return out.withColumn("event_date", F.col("event_date").cast("string"))


@query("S18_sink_json_records", f"""WITH {EV} SELECT '{{"event_id":' || event_id || ',"username":"' || username || '","action":"' || action || '"}}' AS json FROM ev""")
def sink_json_records(spark, sf):
    return sinks.to_json_rows(events(spark, sf).select("event_id", "username", "action"))


@query("S19_table_profile_schema", f"""WITH {EV}, x AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN username END AS username, duration FROM ev)
SELECT * FROM (VALUES (0::BIGINT, 'event_id', 'bigint'), (1::BIGINT, 'username', 'string'), (2::BIGINT, 'duration', 'double')) AS t(position, column_name, data_type),
LATERAL (SELECT count(*) AS row_count, count(*) FILTER (position = 1 AND username IS NULL) AS null_count FROM x)""")
def table_profile_schema(spark, sf):
    df = events(spark, sf).selectExpr("event_id", "CASE WHEN event_id % 9 <> 0 THEN username END AS username", "duration")
    return sinks.describe_schema(df).drop("nullable")


@query("U02_preprocessing_hook", f"""WITH {EV} SELECT event_id, round(ln(duration + 1), 6) AS duration, upper(action) AS action FROM ev WHERE status = 'failure'""")
def preprocessing_hook(spark, sf):
    """Steps are plain DataFrame functions applied in order."""
    steps = [lambda d: d.filter("status = 'failure'"), lambda d: d.withColumn("duration", F.round(F.log1p("duration"), 6)),
             lambda d: d.withColumn("action", F.upper("action"))]
    return preprocess(events(spark, sf), steps).select("event_id", "duration", "action")
