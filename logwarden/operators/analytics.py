"""Dashboard counts, trends and entity aggregates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.ordered import arrange

OPEN_STATES = ["open", "investigating", "contained"]  # fixed values


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def response_times(timeline: DataFrame, incidents: DataFrame) -> DataFrame:
    """Seconds from creation to the first response, containment and resolution of each incident."""
    first = lambda *states: F.min(F.when(F.col("new_status").isin(*states), F.col("changed_at")))
    reached = timeline.groupBy("incident_id").agg(
        F.min("changed_at").alias("_response"), first("contained").alias("_containment"), first("resolved").alias("_resolution"))
    joined = incidents.select(F.col("id").alias("incident_id"), "created_at").join(reached, "incident_id")
    since = lambda c: F.unix_seconds(c) - F.unix_seconds("created_at")
    return joined.select(
        "incident_id", since("_response").alias("time_to_response"), since("_containment").alias("time_to_containment"),
        since("_resolution").alias("time_to_resolution"))


def dashboard_stats(incidents: DataFrame, detections: DataFrame, responses: DataFrame, now: datetime.datetime) -> DataFrame:
    """One row of headline counts; the average response time comes from the real timeline."""
    inc = incidents.agg(F.struct(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(OPEN_STATES)).alias("open"),
        F.count_if(F.col("severity") == "critical").alias("critical")).alias("s")).scalar()
    mean = responses.agg(F.avg("time_to_response")).scalar()
    day = F.count_if((F.col("ts") >= F.lit(now - datetime.timedelta(hours=24))) & (F.col("ts") <= F.lit(now)))
    return detections.agg(day.alias("detections_today")).select(
        inc["total"].alias("total_incidents"), inc["open"].alias("open_incidents"),
        inc["critical"].alias("critical_incidents"), "detections_today", mean.alias("avg_response_time"))


def trend(df: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    """Rows per date, empty dates filled with 0 between the first and the last."""
    counts = df.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    calendar = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("period"))
    return calendar.join(counts, "period", "left").na.fill(0, ["n"])


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max, the last one closed; empty bins included."""
    s = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    width = (s["hi"] - s["lo"]) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - s["lo"], width)).cast("int"))
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left").na.fill(0, ["n"])
    return out.select(F.col("bin").cast("bigint").alias("bin"), (s["lo"] + F.col("bin") * width).alias("lower"), "n")


PERIODS = ("hour", "day", "week", "month")


def analytics(df: DataFrame, metrics: dict[str, Column], by: str, *, ts: str, start=None, end=None,
              filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """Metrics by a column or a period, in a date range, with equality filters; largest first when limited."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end))
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    group = F.date_trunc(by, ts) if by in PERIODS else F.col(by)
    out = df.groupBy(group.alias(by)).agg(*[m.alias(n) for n, m in metrics.items()])
    return out.orderBy(F.desc(next(iter(metrics))), by).limit(limit) if limit else out


def entity_risk(df: DataFrame, key: str, keep: int | None = None) -> DataFrame:
    """Total, maximum and number of scores per entity, ranked by the total.

    The rank counts distinct totals with the ordered scan, so it needs no one-task window.
    """
    per = df.groupBy(key).agg(F.sum("anomaly_score").alias("risk"), F.max("anomaly_score").alias("max_score"),
                              F.count(F.lit(1)).alias("detections"))
    per = per.withColumn("_down", -F.round("risk", 6))
    totals = arrange(per.select("_down").distinct(), [], ["_down"]).running(place=("count", F.lit(1))).done()
    ranked = per.join(totals, "_down").drop("_down")
    return ranked.orderBy("place", key).limit(keep) if keep else ranked


def correlate(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: correlation of each pair of columns, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))


def patterns(df: DataFrame, key: str, n: int = 3, column: str = "action", top: int | None = None, **how) -> DataFrame:
    """How often each sequence of ``n`` consecutive events of one entity occurs; the ``top`` ones only when asked for."""
    o = arrange(df, [key], ["timestamp", "event_id"], **how).lag(**{f"_b{i}": (column, i) for i in range(1, n)})
    parts = [F.col(f"_b{i}") for i in range(n - 1, 0, -1)] + [F.col(column)]
    whole = o.done().filter(F.col(f"_b{n - 1}").isNotNull()) if n > 1 else o.done()
    out = whole.groupBy(F.concat_ws(">", *parts).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "pattern").limit(top)


def entity_profile(df: DataFrame, key: str, kind: str = "action", keep: int | None = None) -> DataFrame:
    """First and last seen, events and events per type of every entity, or of the ``keep`` most recently seen ones.

    Aggregates by (entity, type) first, so the map holds one entry per type whatever the entity's size.
    """
    by_kind = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"),
                                        F.max("timestamp").alias("b"))
    out = by_kind.groupBy(key).agg(
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.sum("n").alias("events"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("event_types"))
    return out if keep is None else out.orderBy(F.desc("last_seen"), key).limit(keep)


def processing_stats(df: DataFrame) -> DataFrame:
    """Processed events and the last event time."""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.max("timestamp").alias("last_timestamp"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A14."""
    return df.select(column).distinct()


def retain(df: DataFrame, ts: str, days: int, now: datetime.datetime) -> DataFrame:
    """Rows of the last ``days`` days; a literal bound, so it reaches the scan."""
    return df.filter(F.col(ts) >= F.lit(now - datetime.timedelta(days=days)))
