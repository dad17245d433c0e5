"""Triage, incident state and response analytics."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.values import IPV4, SEVERITY_THRESHOLDS, severity
from logwarden.operators.ordered import arrange

INTERNAL_PREFIXES = ["10.", "172.16.", "192.168."]  # fixed values


def report(df: DataFrame, score: str = "anomaly_score", explanation: str = "explanation", n: int = 5) -> DataFrame:
    """Severity, is_anomaly and the ``n`` largest factors (ties by name) of the explanation map."""
    by_size = F.array_sort(F.transform(F.map_entries(explanation),
                                       lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("feature"))))
    top = F.transform(F.slice(by_size, 1, n), lambda s: F.struct(s["feature"].alias("feature"), (-s["neg"]).alias("share")))
    return df.withColumns({
        "severity": severity(score),
        "is_anomaly": F.col(score) >= SEVERITY_THRESHOLDS["low"],
        "top_factors": top,
    })


@dataclass(frozen=True)
class Rule:
    """A classification rule: conditions that must all hold."""

    name: str
    conditions: list[str]
    severity: str = "medium"
    priority: int = 0


def condition(text: str) -> Column:
    """A rule condition as Spark SQL; ``==`` is accepted. Null counts as not met."""
    return F.coalesce(F.expr(text).cast("boolean"), F.lit(False))


def classify(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Name and severity of the matching rule with the highest priority (first listed on ties)."""
    name = kind = F
    for rule in sorted(rules, key=lambda r: -r.priority):
        met = F.lit(True)
        for c in rule.conditions:
            met = met & condition(c)
        name, kind = name.when(met, F.lit(rule.name)), kind.when(met, F.lit(rule.severity))
    return df.withColumns({"classification": name.otherwise("unknown_anomaly"), "severity": kind.otherwise("low")})


def threshold_rule(df: DataFrame, key: str, window: str, n: int) -> DataFrame:
    """Entity and window with at least ``n`` events."""
    counted = df.groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.filter(F.col("events") >= n).select(key, F.col("w.start").alias("window_start"), "events")


def signature_rule(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose field matches a regex."""
    return df.filter(F.col(column).rlike(pattern))


def correlation_rule(df: DataFrame, first: Column, second: Column, key: str, seconds: float, **how) -> DataFrame:
    """Events matching ``second`` within ``seconds`` after the latest ``first`` of the same entity, without a join."""
    o = arrange(df.withColumns({"_a": first, "_b": second}), [key], ["timestamp", "event_id"], **how)
    o.lag(_pa=("_a", 1), _pt=("timestamp", 1))
    o.running(cause_time=("last", F.when(F.col("_pa"), F.col("_pt"))))
    hit = F.col("_b") & (F.col("timestamp") - F.col("cause_time") <= seconds)
    return o.done().filter(hit).drop("_a", "_b", "_pa", "_pt")


def acknowledge(df: DataFrame, ids: DataFrame, user: str, at: datetime.datetime, key: str = "event_id") -> DataFrame:
    """Set the acknowledgement on the listed ids; earlier acknowledgements of other rows stay."""
    before = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    by, when = before("acknowledged_by", "string"), before("acknowledged_at", "timestamp")
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    return marked.withColumns({
        "acknowledged": hit | F.col("acknowledged"),
        "acknowledged_by": F.when(hit, F.lit(user)).otherwise(by),
        "acknowledged_at": F.when(hit, F.lit(at)).otherwise(when),
    }).drop("_hit")


def acknowledge_failed(df: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    """Listed ids that do not exist."""
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def auto_acknowledge(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Low scores count as acknowledged."""
    return df.withColumn("acknowledged", F.col("acknowledged") | (F.col("anomaly_score") < threshold))


def apply_updates(df: DataFrame, updates: DataFrame, key: str, columns: list[str], at: datetime.datetime) -> DataFrame:
    """Overwrite only the supplied (non-null) fields; ``updated_at`` where an update exists, else as before."""
    before = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(new, key, "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns})
    out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(at)).otherwise(before))
    return out.drop("_hit", *[f"_new_{c}" for c in columns])


def diff_timeline(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One entry per changed field with its old and new value; a new id gives a 'created' entry."""
    pack = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = pack(new, "_n").join(pack(old, "_o"), key, "left")
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("field"), a.cast("string").alias("old_value"),
                                        b.cast("string").alias("new_value"))
    nothing = F.lit(None).cast("string")
    changes = F.array_compact(F.array(*[
        F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), entry(c, F.col(f"_o.{c}"), F.col(f"_n.{c}")))
        for c in columns]))
    entries = F.when(F.col("_o").isNull(), F.array(entry("created", nothing, nothing))).otherwise(changes)
    return both.select(key, F.inline(entries))


def status_changes(timeline: DataFrame, **how) -> DataFrame:
    """R11, event-log form: each entry whose status differs from the previous one of the incident."""
    o = arrange(timeline, ["incident_id"], ["changed_at", "entry", "ref"], **how).lag(old_status=("new_status", 1))
    return o.done().filter(~F.col("old_status").eqNullSafe(F.col("new_status")))


def current_state(timeline: DataFrame) -> DataFrame:
    """Latest status per incident."""
    last = F.struct("changed_at", "entry", "ref")
    return timeline.groupBy("incident_id").agg(F.max_by("new_status", last).alias("status"),
                                               F.max("changed_at").alias("since"))


ACTION_STATES = ["pending", "in_progress", "completed", "failed", "skipped"]  # fixed values


def execution_summary(results: DataFrame) -> DataFrame:
    """Actions by status, total and duration per execution."""
    return results.groupBy("execution_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ACTION_STATES],
        F.count(F.lit(1)).alias("total_actions"), F.sum("duration").alias("duration_seconds"))


def execution_metrics(results: DataFrame) -> DataFrame:
    """Mean, largest and smallest action duration and the success percentage."""
    return results.groupBy("execution_id").agg(
        F.avg("duration").alias("avg_action_duration"), F.max("duration").alias("max_action_duration"),
        F.min("duration").alias("min_action_duration"),
        (F.avg((F.col("status") == "completed").cast("int")) * 100).alias("success_rate_percent"))


def rollup_status(results: DataFrame) -> DataFrame:
    """Any failed action fails the execution, else any skipped makes it partial."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return results.groupBy("execution_id").agg(
        F.when(any_of("failed"), "failed").when(any_of("skipped"), "partial").otherwise("completed").alias("status"))


def recent(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` latest executions per playbook; Spark limits each task's group before the shuffle."""
    from pyspark.sql import Window

    runs = results.groupBy("playbook_id", "execution_id").agg(F.max("start_time").alias("start_time"))
    w = Window.partitionBy("playbook_id").orderBy(F.desc("start_time"), "execution_id")
    return runs.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n)


def login_summary(df: DataFrame, now: datetime.datetime, days: int = 30, user: str = "username", ip: str = "source_ip"
                  ) -> DataFrame:
    """Per account, failed attempts in the last days and addresses never used by it before."""
    start = now - datetime.timedelta(days=days)
    ts = F.col("ts")
    pairs = df.filter(ts <= F.lit(now)).groupBy(user, ip).agg(
        F.count_if(ts >= F.lit(start)).alias("recent"), F.count_if(ts < F.lit(start)).alias("before"),
        F.count_if((ts >= F.lit(start)) & (F.col("status") == "failure")).alias("failed"))
    return pairs.filter("recent > 0").groupBy(user).agg(
        F.count_if(F.col("before") == 0).alias("unusual_locations"), F.sum("failed").alias("failed_attempts"))


def is_internal(ip: Column) -> Column:
    hit = F.lit(False)
    for p in INTERNAL_PREFIXES:
        hit = hit | ip.startswith(p)
    return hit


def lateral_movement(df: DataFrame, host: str, dest: str) -> DataFrame:
    """Internal connections, distinct internal destinations and the flag per host."""
    internal = is_internal(F.col(dest))
    return df.groupBy(host).agg(
        F.count_if(internal).alias("connection_count"),
        F.count_distinct(F.when(internal, F.col(dest))).alias("internal_destinations"),
        F.bool_or(internal).alias("lateral_movement"))


SCAN_HOSTS = "array<struct<host:string,malware_detected:boolean,vulnerabilities:array<struct<severity:string>>>>"


def scan_summary(df: DataFrame, payload: str, key: str) -> DataFrame:
    """Infected hosts, critical and high vulnerabilities and action items per scan.

    Each report row is reduced to four numbers first, so a scan with many reports only adds numbers.
    """
    hosts = F.coalesce(F.from_json(F.get_json_object(payload, "$.hosts"), SCAN_HOSTS), F.array().cast(SCAN_HOSTS))
    rows = df.select(key, F.coalesce(F.get_json_object(payload, "$.hosts_scanned").cast("bigint"), F.lit(0)).alias("_n"),
                     hosts.alias("_h"))
    levels = F.flatten(F.transform("_h", lambda h: F.coalesce(h["vulnerabilities"], F.array().cast("array<struct<severity:string>>"))))
    found = lambda level: F.sum(F.size(F.filter("_v", lambda v: v["severity"] == level)).cast("bigint"))
    out = rows.withColumn("_v", levels).groupBy(key).agg(
        F.sum("_n").alias("hosts_scanned"),
        F.sum(F.size(F.filter("_h", lambda h: h["malware_detected"])).cast("bigint")).alias("hosts_infected"),
        found("critical").alias("vuln_critical"), found("high").alias("vuln_high"))
    n = lambda c: F.col(c).cast("string")
    items = F.array_compact(F.array(
        F.when(F.col("hosts_infected") > 0, F.concat(F.lit("Quarantine "), n("hosts_infected"), F.lit(" infected hosts"))),
        F.when(F.col("hosts_infected") > 0, F.lit("Collect forensic evidence from infected hosts")),
        F.when(F.col("vuln_critical") > 0, F.concat(F.lit("Address "), n("vuln_critical"), F.lit(" critical vulnerabilities"))),
        F.when(F.col("vuln_high") > 0, F.concat(F.lit("Plan remediation for "), n("vuln_high"),
                                                F.lit(" high-severity vulnerabilities")))))
    return out.withColumn("action_items", items)


def subnet_of(df: DataFrame, key: str, ip: str, order: list[str], critical: Column | None = None) -> DataFrame:
    """Segment of an incident's addresses: /32 for one, /24 of the first up to ten, /16 beyond."""
    out = df.groupBy(key).agg(
        F.count_distinct(ip).alias("asset_count"), F.min_by(ip, F.struct(*order)).alias("_first"),
        F.bool_or(F.lit(False) if critical is None else critical).alias("contains_critical"))
    net = lambda n, tail: F.concat(F.substring_index("_first", ".", n), F.lit(tail))
    subnet = (F.when(F.col("asset_count") == 1, F.concat("_first", F.lit("/32")))
              .when(F.col("asset_count") <= 10, net(3, ".0/24")).otherwise(net(2, ".0.0/16")))
    return out.withColumn("subnet", subnet).drop("_first")


def validate(df: DataFrame, required: list[str], ips: list[str] | None = None) -> DataFrame:
    """Array of violation codes per row; empty means valid."""
    codes = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing:{c}")) for c in required]
    codes += [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(IPV4), F.lit(f"bad_ip:{c}")) for c in ips or []]
    return df.withColumn("violations", F.array_compact(F.array(*codes)))


def active_blocks(df: DataFrame, now: datetime.datetime) -> DataFrame:
    """Addresses whose latest event is a block that has not expired (no duration: permanent)."""
    last = df.groupBy("ip").agg(F.max_by(F.struct("kind", "ts", "duration"), F.struct("ts", "event_id")).alias("l"))
    until = F.timestamp_seconds(F.unix_seconds("l.ts") + F.col("l.duration"))
    live = (F.col("l.kind") == "block") & (F.col("l.duration").isNull() | (until > F.lit(now)))
    return last.filter(live).select("ip", F.col("l.ts").alias("since"), F.col("l.duration").alias("duration"))
