"""Structured Streaming forms (T01-T06, W14): the batch operators on streams, plus keyed state.

Rows that need keyed state in time order (T02, W14) are computed per micro-batch by the batch operators, with the
stored state of their keys as rows in front, so a hot key is sliced as in a batch and no task holds its rows. Results and state are
tables whose batches are committed once (``logwarden.sources.tables``): results first, state last, so a batch that failed
anywhere in between is repeated from the old state and leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators import normalize
from logwarden.operators.behaviour import is_failure, rate_limit
from logwarden.operators.ordered import arrange
from logwarden.operators.stat import Baselines, explanation, score_statistical
from logwarden.session import scratch_path, written
from logwarden.sources.tables import BatchLog, UpsertTable


def run_available(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into Parquet, then stop; a restart with the same checkpoint continues."""
    q = (sdf.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_batches(sdf: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand everything available to ``handle(batch, number)``, then stop."""
    q = (sdf.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the version of each key with the highest ``_batch``."""

    def fold(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
        return best.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])

    return fold


def run_updates(sdf: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, fanout: int = 8) -> StreamingQuery:
    """Update mode into a table of changed keys, committed once per batch.

    With ``keys``, every ``fanout`` batches are folded into one that holds the newest version of each key, and so on level by level,
    so the parts that ``latest`` reads grow with the logarithm of the batches.
    """
    fold = newest(keys) if keys else None

    def write(batch: DataFrame, number: int) -> None:
        BatchLog(batch.sparkSession, path, fold=fold, fanout=fanout).append(batch.withColumn("_batch", F.lit(number)), "updates", number)

    return run_batches(sdf, write, checkpoint, "update")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key written by ``run_updates``."""
    return newest(keys)(BatchLog(spark, path).read()).drop("_batch")


def run_results(sdf: DataFrame, path: str, checkpoint: str, ts: str = "ts", writer: str = "results") -> StreamingQuery:
    """Result rows partitioned by event date, each micro-batch committed once: a batch that is run again after a failure
    replaces what it left behind. How many rows are in flight is bounded by the source (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``)."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("event_date", F.to_date(ts))
        BatchLog(batch.sparkSession, path, partition_by=["event_date"]).append(rows, writer, number)

    return run_batches(sdf, write, checkpoint)


def run_upserts(sdf: DataFrame, table: UpsertTable, checkpoint: str, writer: str = "upserts", **how) -> StreamingQuery:
    """Each micro-batch of changes is merged into the table, once."""

    def write(batch: DataFrame, number: int) -> None:
        UpsertTable(batch.sparkSession, table.path, table.key, table.schema, table.buckets, table.spread).merge(
            batch, writer=writer, batch=number, **how)

    return run_batches(sdf, write, checkpoint)


def stream_normalize(sdf: DataFrame, column: str = "message", **how) -> DataFrame:
    """The normalizer cascade; stateless, so it runs on a stream unchanged."""
    return normalize.normalize_all(sdf, column, **how)


DEPTH = 20
USER_STATE = "username string, last double, seen bigint, streak bigint, address string, recent array<double>"


def batch_features(batch: DataFrame, state: DataFrame, **how) -> DataFrame:
    """The features of one batch's rows, behind the stored state of their users; the state's rows have ``_new`` 0.

    A stored user comes back as rows at the last times, before all new rows. ``how`` goes to ``arrange``.
    """
    own = state.join(batch.select("username").distinct(), "username", "left_semi")
    old = own.select("username", "seen", "streak", "address", F.size("recent").alias("n"), F.posexplode("recent").alias("at", "timestamp")).select(
        F.col("at").cast("bigint").alias("event_id"), "username", "timestamp", F.lit(0).alias("_new"), F.lit(0).cast("bigint").alias("_fail"),
        F.when(F.col("at") == F.col("n") - 1, F.col("address")).alias("source_ip"), F.col("seen").alias("_seen"), F.col("streak").alias("_streak"))
    none = F.lit(None).cast("bigint")
    new = batch.select("event_id", "username", "timestamp", F.lit(1).alias("_new"), is_failure().alias("_fail"), "source_ip",
                       none.alias("_seen"), none.alias("_streak"))
    o = arrange(old.unionByName(new), ["username"], ["_new", "timestamp", "event_id"], **how)
    # A late row counts as coming right after the user's last one.
    o.running(t=("max", F.col("timestamp")), place=("sum", F.col("_new")), rank=("count", F.lit(1)), _seen0=("max", F.col("_seen")),
              _streak0=("max", F.col("_streak")))
    o.running(_reset=("max", F.when((F.col("_new") == 1) & (F.col("_fail") == 0), F.col("place"))))
    o.lag(_t1=("t", 1), _t5=("t", 5), _t20=("t", 20), _before=("source_ip", 1))
    speed = lambda n: F.when(F.col(f"_t{n}").isNull(), F.lit(0.0)).otherwise(
        F.lit(float(n)) / F.greatest(F.col("t") - F.col(f"_t{n}"), F.lit(1.0)))
    streak = F.col("place") - F.coalesce("_reset", F.when(F.col("_streak0").isNotNull(), -F.col("_streak0")), F.lit(0))
    o.derive(time_since_last=F.coalesce(F.col("t") - F.col("_t1"), F.lit(0.0)), seen=F.coalesce("_seen0", F.lit(0)) + F.col("place") - 1,
             username_streak=F.when(F.col("_fail") == 1, streak).otherwise(F.lit(0)),
             switched=(F.col("_before").isNotNull() & ~F.col("source_ip").eqNullSafe(F.col("_before"))).cast("bigint"),
             velocity_5=speed(5), velocity_20=speed(20))
    return o.done().select("event_id", "username", "time_since_last", "seen", "username_streak", "switched", "velocity_5", "velocity_20",
                           "t", "rank", "source_ip", "_new")


def user_state(rows: DataFrame) -> DataFrame:
    """The state of the users behind ``batch_features`` rows: last time, count, streak, address and the last 20 times."""
    # Spark keeps 20 rows per user before the shuffle already.
    back = F.row_number().over(Window.partitionBy("username").orderBy(F.desc("rank")))
    ends = rows.withColumn("_back", back).filter(F.col("_back") <= DEPTH)
    return ends.groupBy("username").agg(
        F.max("t").alias("last"), (F.max_by("seen", "rank") + 1).alias("seen"), F.max_by("username_streak", "rank").alias("streak"),
        F.max_by("source_ip", "rank").alias("address"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("recent"))


def run_features(sdf: DataFrame, path: str, checkpoint: str, ttl: float | None = 30 * 86_400.0, **how) -> StreamingQuery:
    """Per-user features whose state survives batches: pause, count, failure streak, address change, velocities.

    State per user is five values and the last 20 times. Rows of one user in one batch are ordered by time; a late row (older
    than the user's last one) counts as coming right after it: its pause is 0, and the stored last time never goes back. Users
    whose last event is more than ``ttl`` seconds behind the newest one are forgotten when the run ends. ``features`` reads the rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        users = UpsertTable(spark, f"{path}/users", "username", USER_STATE)
        if users.commits.done(users.commits.load()[1], "features", number):
            return
        rows = written(batch_features(written(batch), users.read(), **how))
        BatchLog(spark, f"{path}/rows").append(rows.filter("_new = 1").drop("t", "rank", "source_ip", "_new"), "features", number)
        users.merge(user_state(rows), partial=False, writer="features", batch=number)

    q = run_batches(sdf, handle, checkpoint)
    if ttl is not None:
        forget(UpsertTable(sdf.sparkSession, f"{path}/users", "username", USER_STATE), "last", ttl)
    return q


def features(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of ``run_features``."""
    return BatchLog(spark, f"{path}/rows").read()


def forget(table: UpsertTable, last: str, ttl: float) -> None:
    """Remove keys whose ``last`` is more than ``ttl`` seconds behind the newest one."""
    state = table.read()
    newest_ = state.agg(F.max(last)).first()[0]
    old = state.filter(F.col(last) < F.lit(newest_) - ttl) if newest_ is not None else None
    if old is not None and not old.isEmpty():
        table.delete(old)


def run_rate_limit(sdf: DataFrame, key: str, limit: int, window: float, path: str, checkpoint: str, **how) -> StreamingQuery:
    """W14 on a stream: windows start at a client's first request and restart when older than ``window``, across batches.

    State per client is the start of its open window, the requests in it and its last time; a late request counts as
    coming right after the last one. The stored window comes back as a row at its start, so the batch operator goes on from it. Clients
    whose window is over are forgotten when the run ends. ``limited`` reads the rows: window_start, requests, limited, retry_after.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        clients = UpsertTable(spark, f"{path}/clients", key, f"`{key}` {kind}, start double, requests bigint, last double")
        if clients.commits.done(clients.commits.load()[1], "limits", number):
            return
        new = written(batch)
        open_ = written(clients.read().join(new.select(key).distinct(), key, "left_semi"))
        rows = new.join(open_.select(key, "last"), key, "left").withColumn("timestamp", F.greatest("timestamp", "last")).drop("last")
        stored = open_.select(key, F.col("start").alias("timestamp"), F.lit(-1).cast("bigint").alias("event_id"))
        both = rows.select(key, "timestamp", "event_id").unionByName(stored)
        done = rate_limit(both, key, limit, window, **how).drop("limited", "retry_after")
        # The stored row stands for all requests that its window had before.
        more = open_.select(key, F.col("start").alias("window_start"), (F.col("requests") - 1).alias("_more"))
        done = written(done.join(more, [key, "window_start"], "left").withColumn("requests", F.col("requests") + F.coalesce("_more", F.lit(0))).drop("_more"))
        over = F.col("requests") > limit
        left = F.when(over, (F.lit(window) - (F.col("timestamp") - F.col("window_start"))).cast("bigint"))
        BatchLog(spark, f"{path}/rows").append(done.filter("event_id >= 0").select(
            "event_id", key, "window_start", "requests", over.alias("limited"), left.alias("retry_after")), "limits", number)
        clients.merge(done.groupBy(key).agg(
            F.max("window_start").alias("start"), F.max_by("requests", F.struct("window_start", "requests")).alias("requests"),
            F.max("timestamp").alias("last")), partial=False, writer="limits", batch=number)

    q = run_batches(sdf, handle, checkpoint)
    kind = sdf.schema[key].dataType.simpleString()
    forget(UpsertTable(sdf.sparkSession, f"{path}/clients", key, f"`{key}` {kind}, start double, requests bigint, last double"), "start", window)
    return q


def limited(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of ``run_rate_limit``."""
    return BatchLog(spark, f"{path}/rows").read()


def stream_detect(sdf: DataFrame, params: Baselines, threshold: float = 0.7, delay: str = "1 hour") -> DataFrame:
    """Scores against the maximum stored at fit time, above the threshold, each event reported once."""
    if params.max_score is None:
        raise ValueError("stream scoring needs the fitted maximum: fit_statistical(..., fit_max=True)")
    scored = score_statistical(sdf, params).withColumn("explanation", explanation(params))
    hits = scored.filter(F.col("anomaly_score") > threshold)
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_profile(sdf: DataFrame, key: str = "source_ip", kind: str = "action", ttl: str = "1 day", delay: str = "1 hour"
                   ) -> DataFrame:
    """Running profile per entity, type and period; a period's state goes once the watermark passes it.

    Built-in aggregation combines rows inside each task, so a hot entity costs one row per task.
    """
    return sdf.withWatermark("ts", delay).groupBy(key, kind, F.window("ts", ttl).alias("w")).agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count(F.lit(1)).alias("n")).select(
        key, kind, F.col("w.start").alias("period"), "a", "b", "n")


def merge_profile(parts: DataFrame, key: str = "source_ip", kind: str = "action", keep: int | None = None) -> DataFrame:
    """Profiles of all entities from the stored periods, or of the ``keep`` most recently seen ones."""
    by_kind = parts.groupBy(key, kind).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    out = by_kind.groupBy(key).agg(
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.sum("n").alias("events"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("event_types"))
    return out if keep is None else out.orderBy(F.desc("last_seen"), key).limit(keep)


def stream_counts(sdf: DataFrame, key: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per entity and window; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = sdf.withWatermark("ts", delay).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


def stream_sessions(sdf: DataFrame, key: str, gap: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Session windows; emitted once the watermark passes a session's end."""
    out = sdf.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), "events")


def run_metrics(sdf: DataFrame, error: Column, path: str, checkpoint: str, rows_path: str | None = None) -> DataFrame:
    """One row (batch, processed, errors, last_timestamp) per micro-batch, measured while its rows are written.

    With ``rows_path`` the rows go there, committed once per batch, and are counted on their way; without it they are only
    counted. A batch that is run again after a failure has the same row, so sums over the table stay exact for any number of
    batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(error).alias("errors"),
                                F.max("timestamp").alias("last_timestamp"))
        log = BatchLog(spark, path)
        if log.commits.done(log.commits.load()[1], "metrics", number):
            return
        if rows_path is None or not BatchLog(spark, rows_path).append(counted, "metrics", number):
            # Nothing to write, or the rows were committed by an attempt that died before its metrics.
            counted.write.format("noop").mode("overwrite").save()
        found = spark.createDataFrame([(number, *(seen.get[k] for k in ("processed", "errors", "last_timestamp")))],
                                      "batch bigint, processed bigint, errors bigint, last_timestamp double")
        log.append(found, "metrics", number)

    run_batches(sdf, write, checkpoint)
    return BatchLog(sdf.sparkSession, path, fold=None).read()


def new_place(spark: SparkSession) -> tuple[str, str]:
    """Fresh output and checkpoint paths in the shared folder."""
    root = scratch_path(spark)
    return f"{root}/out", f"{root}/checkpoint"
