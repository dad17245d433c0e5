"""E01-E12 and the flagship triage query."""

from pyspark.sql import functions as F

from logwarden.functions.values import severity
from logwarden.operators import behaviour as b, features as f, stat
from logwarden.plans.bindings import EV, events, table
from logwarden.plans.registry import query
from logwarden.session import written

R = lambda c: F.round(F.col(c), 6).alias(c)


@query("E01_top_n_other", f"""WITH {EV}, top AS (
  SELECT source_ip FROM ev GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 10)
SELECT event_id, CASE WHEN source_ip IN (SELECT source_ip FROM top) THEN source_ip ELSE 'other' END AS source_ip FROM ev""")
def top_n_other(spark, sf):
    return f.top_n_other(events(spark, sf), "source_ip", 10).select("event_id", "source_ip")


@query("E02_one_hot", f"""WITH {EV}
SELECT event_id, CAST(action = 'click' AS BIGINT) AS action_click, CAST(action = 'error' AS BIGINT) AS action_error,
  CAST(action = 'purchase' AS BIGINT) AS action_purchase, CAST(action = 'signup' AS BIGINT) AS action_signup,
  CAST(action = 'view' AS BIGINT) AS action_view, CAST(action IS NULL AS BIGINT) AS action_nan FROM ev""")
def one_hot(spark, sf):
    df = events(spark, sf).select("event_id", "action")
    values, _ = f.top_values(df, "action", 10)
    return f.one_hot(df, "action", sorted(values))


@query("E03_label_encode", f"""WITH {EV}
SELECT event_id, dense_rank() OVER (ORDER BY source_ip) - 1 AS source_ip_encoded FROM ev""")
def label_encode(spark, sf):
    return f.label_encode(events(spark, sf), "source_ip").select("event_id", "source_ip_encoded")


GAPS = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE duration END"


def _gappy(spark, sf):
    d = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
    return events(spark, sf).select("event_id", d.otherwise(F.col("duration")).alias("duration"))


@query("E04_replace_infinite", f"""WITH {EV}
SELECT event_id, CASE WHEN NOT isinf({GAPS}) THEN {GAPS} END AS duration FROM ev""")
def replace_infinite(spark, sf):
    return f.clean_inf(_gappy(spark, sf), ["duration"])


@query("E05_impute_median", f"""WITH {EV}, c AS (SELECT event_id, CASE WHEN NOT isinf({GAPS}) THEN {GAPS} END AS d FROM ev)
SELECT event_id, round(coalesce(d, (SELECT median(d) FROM c)), 6) AS duration FROM c""")
def impute_median(spark, sf):
    df = f.impute_median(f.clean_inf(_gappy(spark, sf), ["duration"]), ["duration"])
    return df.select("event_id", R("duration"))


@query("E06_log_transform", f"""WITH {EV}, x AS (SELECT event_id, duration, duration - 100 AS shifted FROM ev),
m AS (SELECT min(duration) AS a, min(shifted) AS b FROM x)
SELECT event_id, round(ln(duration + CASE WHEN a >= 0 THEN 1 ELSE abs(a) + 1 END), 6) AS duration_log,
  round(ln(shifted + CASE WHEN b >= 0 THEN 1 ELSE abs(b) + 1 END), 6) AS shifted_log FROM x, m""")
def log_transform(spark, sf):
    df = events(spark, sf).select("event_id", "duration", (F.col("duration") - 100).alias("shifted"))
    df = f.log_feature(f.log_feature(df, "duration"), "shifted")
    return df.select("event_id", R("duration_log"), R("shifted_log"))


@query("E07_quantile_bin", """WITH e AS (
  SELECT list_distinct(quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q,
         list_distinct(quantile_cont(l_discount, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(greatest(len(list_filter(q, lambda x: x < l_quantity)) - 1, 0) AS BIGINT) AS l_quantity_binned,
  CAST(greatest(len(list_filter(d, lambda x: x < l_discount)) - 1, 0) AS BIGINT) AS l_discount_binned FROM lineitem, e""")
def quantile_bin(spark, sf):
    df = f.quantile_bin(f.quantile_bin(table(spark, sf, "lineitem"), "l_quantity", 10), "l_discount", 10)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_binned", "l_discount_binned")


PARTS = """CAST(hour(ts) AS BIGINT) AS hour, CAST(day(ts) AS BIGINT) AS day, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
  CAST(month(ts) AS BIGINT) AS month"""


@query("E08_time_parts", f"SELECT event_id, {PARTS} FROM events")
def time_parts(spark, sf):
    return f.time_parts(events(spark, sf)).select("event_id", "hour", "day", "weekday", "month")


@query("E09_cyclic_time", """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin,
  round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_sin,
  round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_cos FROM events""")
def cyclic_time(spark, sf):
    df = f.cyclic_time(f.time_parts(events(spark, sf)))
    return df.select("event_id", R("hour_sin"), R("hour_cos"), R("weekday_sin"), R("weekday_cos"))


@query("E10_calendar_flags", """SELECT event_id, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, isodow(ts) >= 6 AS is_weekend,
  hour(ts) BETWEEN 9 AND 16 AS is_business_hours FROM events""")
def calendar_flags(spark, sf):
    df = f.calendar_flags(events(spark, sf))
    return df.select("event_id", "day_of_week", "is_weekend", "is_business_hours")


@query("E11_feature_frame", f"""WITH {EV}, w AS (
  SELECT *, count(*) OVER i AS c_ip, min("timestamp") OVER i AS f_ip, max("timestamp") OVER i AS l_ip,
    count(*) OVER u AS c_user, avg(CAST(status = 'failure' AS INT)) OVER u AS ratio,
    lag("timestamp") OVER io AS p_ip, lag(username) OVER io AS p_name, lag("timestamp") OVER uo AS p_user,
    row_number() OVER ao - 1 AS action_count, lag("timestamp") OVER ao AS p_act,
    lag("timestamp") OVER g AS p1, lag("timestamp", 5) OVER g AS p5, lag("timestamp", 20) OVER g AS p20,
    dense_rank() OVER (ORDER BY username) - 1 AS username_encoded
  FROM ev WINDOW i AS (PARTITION BY source_ip), u AS (PARTITION BY username),
    io AS (PARTITION BY source_ip ORDER BY "timestamp", event_id), uo AS (PARTITION BY username ORDER BY "timestamp", event_id),
    ao AS (PARTITION BY action ORDER BY "timestamp", event_id), g AS (ORDER BY "timestamp", event_id))
SELECT event_id, round(duration, 6) AS duration, {PARTS}, c_ip AS source_ip_count,
  round(c_ip / (greatest(l_ip - f_ip, 3600) / 3600), 6) AS source_ip_event_rate, c_user AS username_count,
  round(ratio, 6) AS user_failure_ratio, round(coalesce("timestamp" - p_ip, 0), 6) AS time_since_last_ip_activity,
  CAST(p_name IS NOT NULL AND p_name <> username AS BIGINT) AS username_switched,
  round(coalesce("timestamp" - p_user, 0), 6) AS time_since_last_user_activity, action_count,
  round(coalesce("timestamp" - p_act, 0), 6) AS time_since_last_action,
  round(coalesce("timestamp" - p1, 0), 6) AS event_timestamp_delta,
  round(CASE WHEN p5 IS NULL THEN 0 ELSE 5 / greatest("timestamp" - p5, 1) END, 6) AS velocity_5,
  round(CASE WHEN p20 IS NULL THEN 0 ELSE 20 / greatest("timestamp" - p20, 1) END, 6) AS velocity_20,
  CAST(action = 'error' AS BIGINT) AS action_error, CAST(status = 'failure' AS BIGINT) AS is_failure, username_encoded
FROM w""")
def feature_frame(spark, sf):
    df = f.extract_features(events(spark, sf), one_hot_columns={"action": 10, "status": 10}, label_columns=["username"])
    return df.select(
        "event_id", R("duration"), "hour", "day", "weekday", "month", "source_ip_count", R("source_ip_event_rate"),
        "username_count", R("user_failure_ratio"), R("time_since_last_ip_activity"), "username_switched",
        R("time_since_last_user_activity"), "action_count", R("time_since_last_action"), R("event_timestamp_delta"),
        R("velocity_5"), R("velocity_20"), "action_error", "is_failure", "username_encoded")


@query("E12_assemble_vector", """SELECT l_orderkey, l_linenumber, l_partkey,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem""")
def assemble_vector(spark, sf):
    df = f.assemble(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "features")


TRIAGE = ["duration", "ip_rate", "gap", "fail_ratio"]


@query("flagship_triage", f"""WITH {EV}, x AS (
  SELECT event_id, username, source_ip, action, duration,
    count(*) OVER i / (greatest(max("timestamp") OVER i - min("timestamp") OVER i, 3600) / 3600) AS ip_rate,
    coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY username ORDER BY "timestamp", event_id), 0) AS gap,
    avg(CAST(status = 'failure' AS INT)) OVER (PARTITION BY username) AS fail_ratio
  FROM ev WINDOW i AS (PARTITION BY source_ip)),
l AS (UNPIVOT x ON duration, ip_rate, gap, fail_ratio INTO NAME feature VALUE v),
p AS (SELECT feature, avg(v) AS mu, greatest(stddev_pop(v), 1e-10) AS sd, median(v) AS med FROM l GROUP BY feature),
q AS (SELECT l.feature, greatest(median(abs(v - med)) * 1.4826, 1e-10) AS mad FROM l JOIN p USING (feature) GROUP BY l.feature),
s AS (SELECT event_id, username, source_ip, action,
    (avg(abs((v - mu) / sd)) + avg(abs((v - med) / mad))) / 2 AS raw
  FROM l JOIN p USING (feature) JOIN q USING (feature) GROUP BY ALL),
n AS (SELECT *, raw / greatest(max(raw) OVER (), 1e-10) AS score FROM s)
SELECT event_id, username, source_ip, action, round(score, 6) AS anomaly_score,
  CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.7 THEN 'medium'
       WHEN score >= 0.5 THEN 'low' ELSE 'normal' END AS severity
FROM n ORDER BY score DESC, event_id LIMIT 20""")
def flagship_triage(spark, sf):
    """Events -> entity features -> fitted baseline -> score -> severity -> the 20 highest (a report, hence the limit)."""
    df = b.time_since_last(events(spark, sf), "username", "gap")
    df = b.failure_ratio(b.event_rate(df, "source_ip", "ip_rate"), "username", "fail_ratio")
    # Fitting reads the features several times: write them once.
    df = written(df.select("event_id", "username", "source_ip", "action", *TRIAGE))
    params = stat.fit_statistical(df, TRIAGE)
    scored = stat.score_statistical(df, params)
    top = scored.orderBy(F.desc("anomaly_score"), "event_id").limit(20)
    return top.select("event_id", "username", "source_ip", "action", F.round("anomaly_score", 6).alias("anomaly_score"),
                      severity("anomaly_score").alias("severity"))
