"""Joins and entity enrichment."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from logwarden.functions.values import ip_bits, masked_bits
from logwarden.operators.normalize import once
from logwarden.operators.ordered import arrange
from logwarden.session import written


def related_events(anomalies: DataFrame, events: DataFrame, seconds: float = 300.0, k: int = 5, **how) -> DataFrame:
    """(event_id, place, related_id): the first ``k`` other events within ``seconds``, else two neighbours each side.

    Every event gets its position in time order, and every anomaly two probes: where its time range begins
    and its own position. An anomaly then asks for k+1 positions from the start of its range and for its four
    neighbours: an equi-join on position with at most k+5 rows per anomaly, however many events share the range.
    """
    base = events.select("timestamp", F.lit(1).alias("_late"), "event_id", F.lit(0).alias("_probe"))
    hits = anomalies.select("timestamp", "event_id")
    starts = hits.select((F.col("timestamp") - seconds).alias("timestamp"), F.lit(0).alias("_late"), "event_id",
                         F.lit(1).alias("_probe"))
    selves = hits.select("timestamp", F.lit(1).alias("_late"), "event_id", F.lit(2).alias("_probe"))
    o = arrange(base.unionByName(starts).unionByName(selves), [], ["timestamp", "_late", "event_id", "_probe"], **how)
    # Both sides of the join below read the places, so they are written once.
    placed = written(o.running(_rank=("count", F.when(F.col("_probe") == 0, 1))).done().select("_probe", "_rank", "event_id", "timestamp"))
    wanted = placed.filter("_probe > 0").select(
        F.col("event_id").alias("_hit"),
        F.when(F.col("_probe") == 1, F.col("timestamp") + 2 * seconds).alias("_until"),
        (F.col("_probe") == 1).alias("_near"),
        F.explode(F.when(F.col("_probe") == 1, F.sequence(F.col("_rank") + 1, F.col("_rank") + k + 1))
                  .otherwise(F.array(*[F.col("_rank") + d for d in (-2, -1, 1, 2)]))).alias("_rank"))
    found = placed.filter("_probe = 0").select("_rank", "event_id", "timestamp").join(wanted, "_rank")
    found = found.filter((F.col("event_id") != F.col("_hit")) & (~F.col("_near") | (F.col("timestamp") <= F.col("_until"))))
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("_rank", "event_id"))))
    lists = found.groupBy("_hit").agg(pick(F.col("_near")).alias("near"), pick(~F.col("_near")).alias("around"))
    chosen = F.slice(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("around")), 1, k)
    return lists.select(F.col("_hit").alias("event_id"), F.posexplode(chosen).alias("place", "r")).select(
        "event_id", (F.col("place") + 1).cast("bigint").alias("place"), F.col("r.event_id").alias("related_id"))


def new_only(anomalies: DataFrame, reported: DataFrame, key: str = "event_id") -> DataFrame:
    """Anomalies not reported before."""
    return anomalies.join(reported.select(key).distinct(), key, "left_anti")


def enrich(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, prefix: str) -> DataFrame:
    """Left lookup; AQE broadcasts the dimension when its measured size allows."""
    renamed = dimension.select(F.col(dimension_key).alias(key),
                               *[F.col(c).alias(f"{prefix}{c}") for c in dimension.columns if c != dimension_key])
    return df.join(renamed, key, "left")


def _networks(rules: DataFrame, cidr: str) -> DataFrame:
    """Valid rules as (network bits, prefix length), IPv4 and IPv6; host bits set or bad text make a rule void."""
    parts = F.split(F.col(cidr), "/")
    bits = ip_bits(F.get(parts, F.lit(0)))
    width = F.when(F.col("_net.family") == 4, 32).otherwise(128)
    length = F.when(F.size(parts) == 1, width).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    out = once(once(rules, {"_net": bits}), {"_len": length, "_width": width})
    out = out.filter("_net is not null and _len between 0 and _width and size(split(%s, '/')) <= 2" % cidr)
    return out.filter(F.col("_net") == masked_bits(F.col("_net"), F.col("_len")))


def cidr_hits(addresses: DataFrame, rules: DataFrame, ip: str, cidr: str, also: dict[str, str] | None = None
              ) -> DataFrame:
    """Distinct (ip, also...) that fall in any rule: equi-join on (prefix length, network), no range join.

    Distinct values go first, so an address on a third of all rows is probed once, with the lengths its family uses.
    """
    also = also or {}
    nets = _networks(rules, cidr).select("_len", "_net", *[F.col(r).alias(c) for c, r in also.items()]).distinct()
    used = nets.groupBy(F.col("_net.family").alias("_family")).agg(F.collect_set("_len").alias("_lengths"))
    probes = once(addresses.select(ip, *also).distinct(), {"_bits": ip_bits(ip)}).filter("_bits is not null")
    # At most two rows, one per family.
    probes = probes.withColumn("_family", F.col("_bits.family")).join(F.broadcast(used), "_family")
    probes = probes.withColumn("_len", F.explode("_lengths")).withColumn("_net", masked_bits(F.col("_bits"), F.col("_len")))
    return probes.join(nets, ["_len", "_net", *also], "left_semi").select(ip, *also).distinct()


def ip_allowed(df: DataFrame, allow: DataFrame | None, block: DataFrame | None, ip: str = "source_ip",
               cidr: str = "cidr") -> DataFrame:
    """``allowed``; a block rule wins, then an allow list, if given, must match."""
    allowed = F.lit(True)
    if allow is not None:
        df = df.join(cidr_hits(df, allow, ip, cidr).withColumn("_ok", F.lit(True)), ip, "left")
        allowed = F.coalesce(F.col("_ok"), F.lit(False))
    if block is not None:
        df = df.join(cidr_hits(df, block, ip, cidr).withColumn("_no", F.lit(True)), ip, "left")
        allowed = allowed & F.col("_no").isNull()
    return df.withColumn("allowed", allowed).drop("_ok", "_no")


def ioc_hits(events: DataFrame, iocs: DataFrame, column: str, indicator: str = "indicator") -> DataFrame:
    """Events that touch a blocked indicator."""
    return events.join(iocs.select(F.col(indicator).alias(column)).distinct(), column, "left_semi")


def match_playbooks(incidents: DataFrame, playbooks: DataFrame, *, all_tags: bool = False,
                    access_level: int | None = None) -> DataFrame:
    """Enabled playbooks for the severity of each incident with a common tag (or all incident tags).

    The playbook list is exploded to (severity, tag) keys, so incidents meet only playbooks they share a key with.
    """
    books = playbooks.filter("enabled")
    if access_level is not None:
        books = books.filter(F.col("access_level") <= access_level)
    keyed = books.select("playbook_id", F.explode(F.array_distinct("target_severity")).alias("severity"),
                         F.array_distinct("tags").alias("_ptags")).select(
        "playbook_id", "severity", F.explode("_ptags").alias("_tag"))
    wanted = incidents.withColumn("_need", F.size(F.array_distinct("tags"))).withColumn(
        "_tag", F.explode(F.array_distinct("tags")))
    pairs = wanted.join(keyed, ["severity", "_tag"])
    if not all_tags:
        return pairs.select("id", "playbook_id").distinct()
    shared = pairs.groupBy("id", "playbook_id").agg(F.count(F.lit(1)).alias("n"), F.first("_need").alias("_need"))
    return shared.filter("n = _need").select("id", "playbook_id")


def incident_links(incidents: DataFrame, detections: DataFrame, executions: DataFrame, *, detection_key: str,
                   execution_key: str) -> DataFrame:
    """J07, long form: (incident_id, kind, linked_id), one row per detection and execution of an incident."""
    ids = incidents.select(F.col("id").alias("incident_id"))
    det = detections.select(F.col(detection_key).alias("incident_id"), F.col("event_id").alias("linked_id"))
    exe = executions.select(F.col(execution_key).alias("incident_id"), F.col("execution_id").alias("linked_id")).distinct()
    both = det.withColumn("kind", F.lit("detection")).unionByName(exe.withColumn("kind", F.lit("execution")))
    return both.join(ids, "incident_id", "left_semi").select("incident_id", "kind", "linked_id")


def incident_detail(incidents: DataFrame, links: DataFrame, related_by: str) -> DataFrame:
    """Each incident with its linked counts and how many other incidents share ``related_by``."""
    counts = links.groupBy("incident_id").agg(
        F.count_if(F.col("kind") == "detection").alias("detections"),
        F.count_if(F.col("kind") == "execution").alias("executions"))
    shared = incidents.groupBy(related_by).agg((F.count(F.lit(1)) - 1).alias("related_incidents"))
    out = incidents.join(counts.withColumnRenamed("incident_id", "id"), "id", "left").join(shared, related_by, "left")
    return out.na.fill(0, ["detections", "executions", "related_incidents"])


def entity_timeline(df: DataFrame, entity: str, value, days: int, end: datetime.datetime, ts: str = "ts") -> DataFrame:
    """Events of one entity over the last ``days`` days in time order; both filters reach the scan."""
    start = end - datetime.timedelta(days=days)
    t = F.col(ts)
    return df.filter((F.col(entity) == F.lit(value)) & (t >= F.lit(start)) & (t <= F.lit(end))).orderBy(ts, "event_id")


def allowed_service(df: DataFrame, rules: DataFrame, ip: str = "dest_ip") -> DataFrame:
    """``allowed`` when a rule covers the address with the same protocol and port."""
    also = {"protocol": "protocol", "port": "port"}
    hits = cidr_hits(df, rules, ip, "subnet", also).withColumn("_ok", F.lit(True))
    out = df.join(hits, [ip, "protocol", "port"], "left")
    return out.withColumn("allowed", F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok")
