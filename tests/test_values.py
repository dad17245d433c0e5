"""Golden values for parsing, features, scoring and triage."""

import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.functions import values as v
from logwarden.operators import collect, ensemble, features, joins, normalize as n, triage
from logwarden.sources import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, epoch", [
    ("2025-03-15 12:27:24", 1742041644), ("2025-03-15T12:27:24.000Z", 1742041644),
    ("15/Mar/2025:12:27:24 +0000", 1742041644), ("20250315122724", 1742041644), ("2025/03/15 invalid-time", None)])
def test_times(spark, text, epoch):
    assert one(spark, F.unix_seconds(v.parse_ts(F.lit(text)))) == epoch


@pytest.mark.parametrize("text, want", [
    ("10.0.0.1", "10.0.0.1"), ("10.0.0.01", None), ("256.1.1.1", None), ("2001:DB8:0:0:0:0:0:1", "2001:db8::1"), ("x:y", None)])
def test_ip(spark, text, want):
    assert one(spark, v.valid_ip(F.lit(text))) == want


def test_syslog(spark):
    df = spark.createDataFrame([("Mar 15 12:27:24 server sshd[1234]: Failed password for admin from 192.168.1.100 port 22 ssh2",),
                                ("Mar 15 12:28:15 server sshd[1235]: Accepted password for user from 10.0.0.2 port 22 ssh2",)],
                               ["message_raw"])
    got = n.classify_auth(n.parse_syslog(df)).select("hostname", "process", "pid", "event_type", "username", "source_ip").collect()
    assert [tuple(r) for r in got] == [("server", "sshd", "1234", "auth_failure", "admin", "192.168.1.100"),
                                       ("server", "sshd", "1235", "auth_success", "user", "10.0.0.2")]


def test_rfc_lines(spark):
    df = spark.createDataFrame([("<34>1 2025-03-15T12:27:24.003Z host1 su 77 ID47 - 'su root' failed",)], ["message"])
    r = n.normalize_rfc5424(df).first()
    assert (r.facility, r.severity, r.application, r.process, r.message) == ("auth", "critical", "su", "77", "'su root' failed")
    df = spark.createDataFrame([("<13>Mar  5 12:27:24 host2 cron[99]: job done from 10.0.0.1 to 10.0.0.2",)], ["message"])
    r = n.normalize_rfc3164(df, 2025).first()
    assert (r.facility, r.severity, r.process, r.pid, r.source_ip, r.dest_ip) == ("user", "notice", "cron", "99", "10.0.0.1", "10.0.0.2")
    assert r.timestamp == 1741177644.0


def test_cef(spark):
    line = r"CEF:0|Acme|FW|1.0|100|Blocked|7|src=10.0.0.1 dst=2.1.2.2 spt=1232 msg=hello big world a\=b act=blocked act=deny"
    r = n.standardize_cef(n.cef_extensions(n.parse_cef(spark.createDataFrame([(line,)], ["message"])))).first()
    assert r.fields["msg"] == "hello big world a=b" and r.source_port == 1232 and r.action == "deny"
    assert (r.vendor, r.signature_id, r.severity) == ("Acme", "100", "7")


def test_cef_long_text(spark):
    line = "CEF:0|A|B|1|1|N|1|msg=" + "word " * 200_000 + "src=10.0.0.1"
    r = n.cef_extensions(n.parse_cef(spark.createDataFrame([(line,)], ["message"]))).first()
    assert r.fields["source_ip"] == "10.0.0.1" and len(r.fields["msg"]) == 999_999


def test_weblog(spark):
    df = spark.createDataFrame([('10.0.0.9 - bob [15/Mar/2025:12:27:24 +0000] "GET /a HTTP/1.1" 404 -',)], ["message"])
    r = n.parse_weblog(df).first()
    assert (r.user, r.bytes_out, r.method, r.path, r.status, r.timestamp) == ("bob", 0, "GET", "/a", "client_error", 1742041644.0)


def test_numeric_time_unchanged(spark):
    df = spark.createDataFrame([(1741783644.0, "192.168.1.100")], ["timestamp", "source_ip"])
    assert n.to_mini_schema(df).first().timestamp == 1741783644.0


def test_dest_ip_fallback(spark):
    df = spark.createDataFrame([("1.1.1.1",)], ["source_ip"]).withColumn("time", F.lit("2025-03-15 12:27:24"))
    assert n.to_mini_schema(df).first().dest_ip is None
    assert n.to_mini_schema(df, compat=True).first().dest_ip == "1.1.1.1"


def test_calendar(spark):
    times = ["2025-03-15 08:30:00", "2025-03-15 12:15:00", "2025-03-15 18:45:00", "2025-03-16 02:10:00"]
    df = spark.createDataFrame([(t,) for t in times], ["t"]).select(F.to_timestamp("t").alias("ts"))
    got = features.calendar_flags(features.time_parts(df)).collect()
    assert [r["hour"] for r in got] == [8, 12, 18, 2] and got[0].day_of_week == 5 and all(r.is_weekend for r in got)
    assert got[1].is_business_hours and not got[3].is_business_hours


def test_missing_values(spark):
    df = spark.createDataFrame([("a", 0.5), (None, None), ("b", 0.8)], "action string, duration double")
    out = features.one_hot(features.impute_median(df, ["duration"]), "action", ["a", "b"])
    assert sorted(r.duration for r in out.collect()) == [0.5, 0.65, 0.8]
    assert all(r.action_a + r.action_b + r.action_nan == 1 for r in out.collect())


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 2, 3, 4, 10]], ["x"])
    assert [r.x_binned for r in features.quantile_bin(df, "x", 4).orderBy("x").collect()] == [0, 0, 0, 0, 1, 2, 2]


def test_ensemble_arithmetic(spark):
    df = spark.createDataFrame(list(zip([.9, .8, .7, .6, .5], [.5, .6, .7, .8, .9])), ["s", "f"])
    even = [r[0] for r in df.select(ensemble.combine(["s", "f"])).collect()]
    assert even == pytest.approx([.7] * 5)
    two = [r[0] for r in df.select(ensemble.combine(["s", "f"], "weighted_average", {"s": 2})).collect()]
    assert two == pytest.approx([(2 * s + f) / 3 for s, f in zip([.9, .8, .7, .6, .5], [.5, .6, .7, .8, .9])])


def test_rules(spark):
    rules = [triage.Rule("auth_failure", ["action == 'login'", "status == 'failure'"], "high"),
             triage.Rule("unusual_access", ["hour < 6 or hour > 22", "action == 'access'"], "medium"),
             triage.Rule("admin_auth_failure", ["action == 'login'", "status == 'failure'", "username == 'admin'"], "critical", 100)]
    df = spark.createDataFrame([("login", "failure", "bob", 14), ("access", "success", "u", 23), ("login", "failure", "admin", 15),
                                ("view", "success", None, 12)], "action string, status string, username string, hour int")
    got = [(r.classification, r.severity) for r in triage.classify(df, rules).collect()]
    assert got == [("auth_failure", "high"), ("unusual_access", "medium"), ("admin_auth_failure", "critical"),
                   ("unknown_anomaly", "low")]


def test_playbooks(spark):
    books = spark.createDataFrame([(1, True, ["network", "scanning"], ["high"]), (2, True, ["malware", "analysis"], ["high"]),
                                   (3, True, ["network", "isolation", "response"], ["high", "critical"])],
                                  "playbook_id int, enabled boolean, tags array<string>, target_severity array<string>")
    inc = lambda *tags: spark.createDataFrame([(1, "high", list(tags))], "id int, severity string, tags array<string>")
    assert joins.match_playbooks(inc("network"), books).count() == 2
    assert joins.match_playbooks(inc("network", "isolation"), books, all_tags=True).count() == 1
    assert joins.match_playbooks(inc("unknown"), books).count() == 0


def test_cidr(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("10.0.0.200",), ("11.0.0.1",), ("bad",)], ["source_ip"])
    rules = lambda *c: spark.createDataFrame([(x,) for x in c], ["cidr"])
    out = joins.ip_allowed(df, rules("10.0.0.0/8"), rules("10.0.0.128/25", "10.0.0.1/24"))
    assert {r.source_ip: r.allowed for r in out.collect()} == {"10.0.0.1": True, "10.0.0.200": False, "11.0.0.1": False, "bad": False}


def test_stream_filter(spark):
    df = spark.createDataFrame([("192.168.1.100", "login"), ("192.168.1.100", "view"), ("1.1.1.1", "login")], ["source_ip", "action"])
    assert collect.filter_in(df, {"source_ip": ["192.168.1.100"], "action": ["login"]}).count() == 1


def test_jdbc_options():
    o = incremental.jdbc_options("jdbc:x", "SELECT * FROM audit", ts="at", mark=datetime.datetime(2025, 3, 15), user="u")
    assert o["query"].startswith("SELECT * FROM (SELECT * FROM audit) t WHERE at > TIMESTAMP '2025-03-15") and o["user"] == "u"
    o = incremental.jdbc_options("jdbc:x", "SELECT 1", partition_column="id", bounds=(0, 9), partitions=3)
    assert o["numPartitions"] == "3" and o["dbtable"] == "(SELECT 1) q"
