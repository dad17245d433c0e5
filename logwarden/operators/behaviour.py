"""Behavioural features per entity and over the whole stream.

Order is always (timestamp, event_id). Plain per-entity totals aggregate first and join back, so a
hot entity is pre-aggregated and the join is left to AQE's skew handling; ordered features use
``arrange``, which slices a hot entity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.operators.ordered import arrange, census, largest_group, modes
from logwarden.session import written

FAILURE_WORDS = ["failure", "failed", "error", "denied"]  # fixed values
ORDER = ["timestamp", "event_id"]
SEGMENT_ROWS = 1_000_000


def attach(df: DataFrame, key: list[str], *aggs: Column, base: DataFrame | None = None) -> DataFrame:
    """Join per-key aggregates (of ``base``, or of the rows themselves) to every row; rows with a null key get nulls."""
    return df.join((df if base is None else base).groupBy(*key).agg(*aggs), key, "left")


def entity_count(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Events of the entity on every row."""
    return attach(df, [key], F.count(F.lit(1)).alias(name or f"{key}_count"))


def time_since_last(df: DataFrame, key: str, name: str = "time_since_last", **how) -> DataFrame:
    """Seconds since the previous event of the entity, 0 for its first."""
    o = arrange(df, [key], ORDER, **how).lag(_prev=("timestamp", 1))
    return o.derive(**{name: F.coalesce(F.col("timestamp") - F.col("_prev"), F.lit(0.0))}).done().drop("_prev")


def event_rate(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Events per hour of the entity over its life, at least one hour."""
    hours = F.greatest(F.max("timestamp") - F.min("timestamp"), F.lit(3600.0)) / 3600
    return attach(df, [key], (F.count(F.lit(1)) / hours).alias(name or f"{key}_event_rate"))


def switched(df: DataFrame, key: str, column: str, name: str | None = None, **how) -> DataFrame:
    """1 when ``column`` differs from the entity's previous event; 0 on its first."""
    o = arrange(df, [key], ORDER, **how).lag(_prev=(column, 1))
    changed = F.col("_prev").isNotNull() & ~F.col(column).eqNullSafe(F.col("_prev"))
    return o.derive(**{name or f"{column}_switched": changed.cast("bigint")}).done().drop("_prev")


def running_count(df: DataFrame, key: str, name: str | None = None, **how) -> DataFrame:
    """How many earlier events the entity has."""
    name = name or f"{key}_seen"
    o = arrange(df, [key], ORDER, **how).running(**{name: ("count", F.lit(1))})
    return o.derive(**{name: F.col(name) - 1}).done()


def is_failure(status: str = "status") -> Column:
    """1 when the status is one of the failure words."""
    return F.coalesce(F.col(status).isin(FAILURE_WORDS), F.lit(False)).cast("bigint")


def failure_flag(df: DataFrame) -> DataFrame:
    """W06."""
    return df.withColumn("is_failure", is_failure())


def failure_streak(df: DataFrame, key: str, mode: str = "entity", name: str = "consecutive_failures", **how
                   ) -> DataFrame:
    """1..n position inside a run of failures, 0 otherwise.

    ``entity`` runs follow one entity; ``global`` runs follow the whole stream and end on another entity.
    """
    o = arrange(df.withColumn("_fail", is_failure()), [key] if mode == "entity" else [], ORDER, **how)
    o.lag(_pf=("_fail", 1), _pk=(key, 1))
    begins = F.coalesce(F.col("_pf"), F.lit(0)) == 0
    if mode == "global":
        begins = begins | ~F.col("_pk").eqNullSafe(F.col(key))
    o.running(_rank=("count", F.lit(1)))
    o.running(_begin=("max", F.when((F.col("_fail") == 1) & begins, F.col("_rank"))))
    value = F.when(F.col("_fail") == 1, F.col("_rank") - F.col("_begin") + 1).otherwise(F.lit(0))
    return o.derive(**{name: value}).done().drop("_fail", "_pf", "_pk", "_rank", "_begin")


def failure_ratio(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Share of failures among the entity's events."""
    return attach(df, [key], F.avg(is_failure()).alias(name or f"{key}_failure_ratio"))


def global_delta(df: DataFrame, name: str = "event_delta", **how) -> DataFrame:
    """Seconds since the previous event of the whole stream."""
    o = arrange(df, [], ORDER, **how).lag(_prev=("timestamp", 1))
    return o.derive(**{name: F.coalesce(F.col("timestamp") - F.col("_prev"), F.lit(0.0))}).done().drop("_prev")


def velocity(df: DataFrame, sizes: list[int], key: str | None = None, **how) -> DataFrame:
    """N / seconds spanned by the last n+1 events (at least 1 s), 0 while fewer exist."""
    o = arrange(df, [key] if key else [], ORDER, **how).lag(**{f"_t{n}": ("timestamp", n) for n in sizes})
    for n in sizes:
        o.derive(**{f"velocity_{n}": speed(n, f"_t{n}")})
    return o.done().drop(*[f"_t{n}" for n in sizes])


def speed(n: int, earlier: str) -> Column:
    """n / seconds since the n-th event before, at least one second; 0 without such an event."""
    gap = F.col("timestamp") - F.col(earlier)
    return F.when(gap.isNull(), F.lit(0.0)).otherwise(F.lit(float(n)) / F.greatest(gap, F.lit(1.0)))


def sessionize(df: DataFrame, key: str, gap: float = 60.0, **how) -> DataFrame:
    """Session number, position and elapsed seconds; a pause of ``gap`` seconds opens a session."""
    o = arrange(df, [key], ORDER, **how).lag(_prev=("timestamp", 1))
    opens = F.col("_prev").isNull() | (F.col("timestamp") - F.col("_prev") >= gap)
    o.derive(_opens=opens.cast("bigint"))
    o.running(session_count=("sum", F.col("_opens")), _rank=("count", F.lit(1)),
              _start=("max", F.when(F.col("_opens") == 1, F.col("timestamp"))))
    o.running(_first=("max", F.when(F.col("_opens") == 1, F.col("_rank"))))
    o.derive(actions_in_session=F.col("_rank") - F.col("_first") + 1,
             session_duration=F.col("timestamp") - F.col("_start"))
    return o.done().drop("_prev", "_opens", "_rank", "_start", "_first")


def session_summary(df: DataFrame, key: str, gap: float = 60.0, **how) -> DataFrame:
    """Start, end, events and distinct actions per session; pre-aggregates, so a long session is fine."""
    return sessionize(df, key, gap, **how).groupBy(key, "session_count").agg(
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("action").alias("distinct_actions"),
    )


def windowed_counts(df: DataFrame, key: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per entity and tumbling or sliding window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


def rate_violations(df: DataFrame, key: str, limit: int, size: str = "60 seconds") -> DataFrame:
    """W14 (plain): entity and aligned window with more than ``limit`` events."""
    return windowed_counts(df, key, size).filter(F.col("events") > limit)


def rate_limit(df: DataFrame, key: str, limit: int, window: float = 60.0, *, segment_rows: int = SEGMENT_ROWS,
               **how) -> DataFrame:
    """W14 (anchored): windows start at the entity's first request and restart when older than ``window``.

    Adds window_start, requests, limited, retry_after. A pause longer than the window always restarts it,
    so each stretch between such pauses is independent. Stretches of bounded size are folded in one sorted
    pass; longer ones follow next-window pointers by doubling joins.
    """
    o = arrange(df, [key], ORDER, **how).lag(_prev=("timestamp", 1))
    fresh = F.col("_prev").isNull() | (F.col("timestamp") - F.col("_prev") > window)
    o.derive(_fresh=fresh.cast("bigint")).running(_seg=("sum", F.col("_fresh")), _rank=("count", F.lit(1)))
    rows = written(o.done().drop("_prev"))
    biggest, _ = largest_group(rows, [key, "_seg"])
    if biggest <= segment_rows:
        starts = _fold_starts(rows, key, window)
    else:
        starts = _chain_starts(rows, key, window, **how)
    o = arrange(rows.join(starts.withColumn("_mark", F.lit(True)), [key, "_rank"], "left"), [key], ORDER, **how)
    o.running(window_start=("max", F.when(F.col("_mark"), F.col("timestamp"))),
              _first=("max", F.when(F.col("_mark"), F.col("_rank"))))
    used = F.col("_rank") - F.col("_first") + 1
    age = F.col("timestamp") - F.col("window_start")
    o.derive(requests=used, limited=used > limit,
             retry_after=F.when(used > limit, (F.lit(window) - age).cast("bigint")))
    return o.done().drop("_fresh", "_seg", "_rank", "_mark", "_first")


def _fold_starts(rows: DataFrame, key: str, window: float) -> DataFrame:
    """Window starts by one pass over each task's sorted stretches; only the open window is kept in memory."""
    key_type = rows.schema[key].dataType.simpleString()

    def fold(batches):
        open_key, open_seg, start = None, None, 0.0
        for pdf in batches:
            marked, t, keys, segs = [], pdf["timestamp"].to_numpy(), pdf[key].to_numpy(), pdf["_seg"].to_numpy()
            turns = np.flatnonzero((segs[1:] != segs[:-1]) | (keys[1:] != keys[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(t)]):
                # From window start to window start; the binary search is settled by the same comparison as a row's age.
                at = a
                if segs[a] == open_seg and keys[a] == open_key:
                    at = _leaves(t, a, b, start, window)
                while at < b:
                    start = t[at]
                    marked.append(at)
                    at = _leaves(t, at + 1, b, start, window)
                open_key, open_seg = keys[a], segs[a]
            yield pdf.iloc[marked][[key, "_rank"]]

    sorted_rows = rows.select(key, "_seg", "_rank", "timestamp").repartition(key, "_seg").sortWithinPartitions(
        key, "_seg", "_rank")
    return sorted_rows.mapInPandas(fold, f"`{key}` {key_type}, _rank bigint")


def _leaves(t: np.ndarray, a: int, b: int, start: float, window: float) -> int:
    """First place in a..b whose time is more than ``window`` after ``start``."""
    at = a + int(np.searchsorted(t[a:b], start + window, side="right"))
    while at > a and t[at - 1] - start > window:
        at -= 1
    while at < b and not t[at] - start > window:
        at += 1
    return at


def _chain_starts(rows: DataFrame, key: str, window: float, **how) -> DataFrame:
    """Window starts by pointer doubling: row -> first row of the stretch later than ``window``."""
    base = rows.select(key, "_seg", "_rank", "timestamp", "event_id")
    probes = base.withColumns({"timestamp": F.col("timestamp") + window, "_probe": F.lit(1)})
    both = base.withColumn("_probe", F.lit(0)).unionByName(probes)
    o = arrange(both, [key, "_seg"], ["timestamp", "_probe", "event_id"], **how)
    o.running(_seen=("count", F.when(F.col("_probe") == 0, 1)))
    first = rows.groupBy(key, "_seg").agg(F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
    jump = (o.done().filter("_probe = 1").join(first, [key, "_seg"])
            .select(key, "_rank", (F.col("_lo") + F.col("_seen")).alias("_next"), "_hi")
            .filter("_next <= _hi").select(key, "_rank", "_next"))
    jump = written(jump)
    marks = written(first.select(key, F.col("_lo").alias("_rank")))
    while not jump.isEmpty():
        reached = marks.join(jump, [key, "_rank"]).select(key, F.col("_next").alias("_rank"))
        marks = written(marks.unionByName(reached))
        step = jump.select(key, F.col("_rank").alias("_next"), F.col("_next").alias("_far"))
        jump = written(jump.join(step, [key, "_next"]).select(key, "_rank", F.col("_far").alias("_next")))
    return marks.distinct()


def behaviour_features(df: DataFrame, ip: str = "source_ip", user: str = "username", action: str = "action",
                       counted: DataFrame | None = None, **how) -> DataFrame:
    """All behavioural columns of the feature frame (W01-W10); velocities and deltas follow the stream.

    The stream order goes first, because it writes its slices, then entity order, then the joined totals.
    """
    found, rows = modes(census(df, [ip, user, action]) if counted is None else counted, [ip, user, action])
    sides = {k: {"mode": m, **how} for k, m in found.items()}
    since = lambda c: F.coalesce(F.col("timestamp") - F.col(c), F.lit(0.0))
    base = df = df.withColumn("is_failure", is_failure())
    o = arrange(df, [], ORDER, **{"rows": rows, **how}).lag(_p1=("timestamp", 1), _p5=("timestamp", 5), _p20=("timestamp", 20))
    o.derive(event_timestamp_delta=since("_p1"), velocity_5=speed(5, "_p5"), velocity_20=speed(20, "_p20"))
    df = o.done().drop("_p1", "_p5", "_p20")
    o = arrange(df, [ip], ORDER, **sides[ip]).lag(_pt=("timestamp", 1), _pu=(user, 1), _pf=("is_failure", 1))
    o.derive(
        time_since_last_ip_activity=since("_pt"),
        username_switched=(F.col("_pu").isNotNull() & ~F.col(user).eqNullSafe(F.col("_pu"))).cast("bigint"))
    failed = F.col("is_failure") == 1
    o.running(_rank=("count", F.lit(1)))
    o.running(_begin=("max", F.when(failed & (F.coalesce(F.col("_pf"), F.lit(0)) == 0), F.col("_rank"))))
    o.derive(consecutive_failures=F.when(failed, F.col("_rank") - F.col("_begin") + 1).otherwise(F.lit(0)))
    df = o.done().drop("_pt", "_pu", "_pf", "_rank", "_begin")
    df = time_since_last(df, user, "time_since_last_user_activity", **sides[user])
    o = arrange(df, [action], ORDER, **sides[action]).lag(_pt=("timestamp", 1)).running(action_count=("count", F.lit(1)))
    o.derive(action_count=F.col("action_count") - 1, time_since_last_action=since("_pt"))
    df = o.done().drop("_pt")
    hours = F.greatest(F.max("timestamp") - F.min("timestamp"), F.lit(3600.0)) / 3600
    df = attach(df, [ip], F.count(F.lit(1)).alias(f"{ip}_count"),
                (F.count(F.lit(1)) / hours).alias(f"{ip}_event_rate"), base=base)
    return attach(df, [user], F.count(F.lit(1)).alias(f"{user}_count"), F.avg("is_failure").alias("user_failure_ratio"),
                  base=base)
