"""Ordered scans (lag, running aggregates) that survive a hot key.

A window partitioned by an entity puts all rows of that entity into one task. ``arrange`` counts the
rows per key first. Small keys use plain windows. The rows of hot keys, and all rows when there is no
key, are range-partitioned on (key, order) into slices, so a hot key spreads over many slices. Windows
then run inside (slice, key) and only the values that cross a slice border - at most a few rows per
slice - are carried over by a broadcast of slice-count size. The slice count follows the rows and is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from logwarden.session import written

HOT_ROWS = 2_000_000
#: Rows of a slice at most while the number of slices allows it, rows at least, and the bounds of that number.
SLICE_ROWS, LEAST_SLICE_ROWS = 1_000_000, 20_000
SLICES_PER_PARTITION, MOST_SLICES = 4, 20_000
_POSITION_BITS = 33


def _total(fn: str, name: str) -> Column:
    c = F.col(name)
    if fn == "last":
        return F.max_by(c, F.when(c.isNotNull(), F.col("_pos")))
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[fn](c)


def _merge(fn: str, carried: Column, local: Column) -> Column:
    if fn in ("sum", "count"):
        return F.when(carried.isNull(), local).otherwise(carried + F.coalesce(local, F.lit(0)))
    if fn == "last":
        return F.coalesce(local, carried)
    return {"max": F.greatest, "min": F.least}[fn](carried, local)


class Ordered:
    """Rows in (key, order) order; every step adds columns and returns itself."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], edges: list | None):
        self.df, self.key, self.order, self.edges = df, key, order, edges
        self._added = [] if edges is None else ["_key", "_slice", "_pos"]

    @property
    def sliced(self) -> bool:
        return self.edges is not None

    def _window(self):
        if self.sliced:
            return Window.partitionBy("_slice", "_key").orderBy("_pos")
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def _small(self, rows: list, fields: list) -> DataFrame:
        key_type = self.df.schema["_key"].dataType
        schema = T.StructType(
            [T.StructField(n, key_type if t is None else t) for n, t in fields]
        )
        return self.df.sparkSession.createDataFrame(rows, schema)

    def derive(self, **columns: Column) -> "Ordered":
        """Row-wise columns computed from earlier steps."""
        self.df = self.df.withColumns(columns)
        return self

    def lag(self, **outputs: tuple[str, int]) -> "Ordered":
        """``name=(column, n)``: the value ``n`` rows earlier of the same key, null when absent."""
        df = self.df
        if self.sliced:
            depth = max(n for _, n in outputs.values())
            df = df.withColumn("_halo", F.lit(False)).unionByName(self._halo(depth))
        w = self._window()
        df = df.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in outputs.items()})
        self.df = df.filter(~F.col("_halo")).drop("_halo") if self.sliced else df
        return self

    def _halo(self, depth: int) -> DataFrame:
        """Copies of the last ``depth`` rows before each slice whose first key began earlier."""
        feeds: dict[int, list[int]] = {}
        for i, edge in enumerate(self.edges):
            j, have = i - 1, 0
            while j >= 0 and have < depth and self.edges[j]["last"] == edge["first"]:
                feeds.setdefault(j, []).append(i)
                have += self.edges[j]["end"] + 1
                if self.edges[j]["first"] != edge["first"]:
                    break
                j -= 1
        rows = [
            (self.edges[j]["slice"], self.edges[j]["last"], self.edges[j]["end"], self.edges[i]["slice"], i - j)
            for j, targets in feeds.items()
            for i in targets
        ]
        fields = [("_edge_s", T.IntegerType()), ("_edge_k", None), ("_edge_end", T.LongType()),
                  ("_edge_target", T.IntegerType()), ("_edge_gap", T.LongType())]
        ends = F.broadcast(self._small(rows, fields))
        tail = self.df.join(ends, (F.col("_slice") == F.col("_edge_s")) & F.col("_key").eqNullSafe(F.col("_edge_k")))
        tail = tail.filter(F.col("_pos") > F.col("_edge_end") - depth)
        return tail.withColumns({
            "_slice": F.col("_edge_target"),
            "_pos": F.col("_pos") - F.col("_edge_gap") * F.lit(1 << _POSITION_BITS),
            "_halo": F.lit(True),
        }).select(*self.df.columns, "_halo")

    def running(self, **outputs: tuple[str, Column]) -> "Ordered":
        """``name=(fn, value)`` with fn in sum, count, max, min, last: aggregate up to this row."""
        values = {f"_v_{n}": (v.isNotNull().cast("bigint") if fn == "count" else v)
                  for n, (fn, v) in outputs.items()}
        base = self.df.withColumns(values)
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pick = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
                "last": lambda c: F.last(c, ignorenulls=True)}
        df = base.withColumns({n: pick[fn](f"_v_{n}").over(w) for n, (fn, _) in outputs.items()})
        if self.sliced:
            df = self._carry(base, df, {n: fn for n, (fn, _) in outputs.items()})
        self.df = df.drop(*values)
        return self

    def _carry(self, base: DataFrame, df: DataFrame, fns: dict[str, str]) -> DataFrame:
        rows, chain = [], 0
        for i, edge in enumerate(self.edges):
            previous = self.edges[i - 1] if i else None
            if previous is None or previous["last"] != edge["last"]:
                chain = i
            linked = previous is not None and previous["last"] == edge["first"]
            rows.append((edge["slice"], edge["first"], edge["last"], chain, previous["slice"] if linked else None))
        edges = self._small(rows, [("_slice", T.IntegerType()), ("_edge_first", None), ("_edge_last", None),
                                   ("_edge_chain", T.IntegerType()), ("_edge_prev", T.IntegerType())])
        ending = base.join(F.broadcast(edges), "_slice").filter(F.col("_key").eqNullSafe(F.col("_edge_last")))
        totals = ending.groupBy("_edge_chain", "_slice").agg(
            *[_total(fn, f"_v_{n}").alias(f"_t_{n}") for n, fn in fns.items()]
        )
        w = Window.partitionBy("_edge_chain").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
        pick = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
                "last": lambda c: F.last(c, ignorenulls=True)}
        upto = totals.select(
            F.col("_slice").alias("_edge_prev"),
            *[pick[fn](f"_t_{n}").over(w).alias(f"_c_{n}") for n, fn in fns.items()],
        )
        carried = edges.filter("_edge_prev is not null").select("_slice", "_edge_first", "_edge_prev").join(
            F.broadcast(upto), "_edge_prev").drop("_edge_prev")
        out = df.join(F.broadcast(carried), "_slice", "left")
        same = F.col("_key").eqNullSafe(F.col("_edge_first"))
        out = out.withColumns({
            n: F.when(same, _merge(fn, F.col(f"_c_{n}"), F.col(n))).otherwise(F.col(n)) for n, fn in fns.items()
        })
        return out.drop("_edge_first", *[f"_c_{n}" for n in fns])

    def done(self) -> DataFrame:
        return self.df.drop(*self._added)


def largest_group(df: DataFrame, key: list[str]) -> tuple[int, int]:
    """(rows of the biggest key, all rows): one map-side combined pass over the key columns."""
    row = df.groupBy(*key).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, v, n): rows per value (as text) of each column, from one pass; written, so several questions share it."""
    cells = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in dict.fromkeys(columns)])
    return written(df.select(F.explode(cells).alias("c")).groupBy("c.k", "c.v").agg(F.count(F.lit(1)).alias("n")))


def modes(counted: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[dict[str, str], int]:
    """Mode per key of a ``census``, and the rows counted: a key without a hot value needs no check of its own."""
    found = {r["k"]: r for r in counted.groupBy("k").agg(F.max("n").alias("m"), F.sum("n").alias("rows")).collect()}
    rows = max((r["rows"] for r in found.values()), default=0)
    return {k: "auto" if k in found and found[k]["m"] > hot_rows else "plain" for k in keys}, rows


def slice_count(rows: int, partitions: int) -> int:
    """Slices for ``rows`` rows: several per shuffle partition while they stay worth a task, at most ``MOST_SLICES``.

    The borders (one row per slice) are the only thing that reaches the driver, so their number is bounded too.
    """
    fine = min(SLICES_PER_PARTITION * partitions, -(-rows // LEAST_SLICE_ROWS))
    return max(1, min(MOST_SLICES, max(fine, -(-rows // SLICE_ROWS))))


class Parted:
    """Rows of hot keys in slices and the rows of all other keys in plain windows, behind the methods of ``Ordered``."""

    def __init__(self, parts: list[Ordered]):
        self.parts = parts

    def derive(self, **columns: Column) -> "Parted":
        for p in self.parts:
            p.derive(**columns)
        return self

    def lag(self, **outputs: tuple[str, int]) -> "Parted":
        for p in self.parts:
            p.lag(**outputs)
        return self

    def running(self, **outputs: tuple[str, Column]) -> "Parted":
        for p in self.parts:
            p.running(**outputs)
        return self

    def done(self) -> DataFrame:
        first, second = (p.done() for p in self.parts)
        return first.unionByName(second)


def arrange(df: DataFrame, key: list[str], order: list[str], *, mode: str = "auto",
            hot_rows: int = HOT_ROWS, slices: int | None = None, rows: int | None = None) -> Ordered | Parted:
    """Put rows in (key, order) order; ``order`` must end in a unique id. ``rows`` spares a count when it is known.

    ``auto`` counts the rows per key: without a hot key plain windows do; otherwise only the rows of hot keys are sliced.
    ``plain`` and ``sliced`` force one way for all rows.
    """
    if mode == "auto" and key:
        counts = df.groupBy(*key).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= hot_rows:
            return Ordered(df, key, order, None)
        hot = written(counts.filter(F.col("count") > hot_rows).select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(key)], "count"))
        total = hot.agg(F.sum("count")).first()[0]
        same = None
        for i, k in enumerate(key):
            test = F.col(k).eqNullSafe(F.col(f"_hot{i}"))
            same = test if same is None else same & test
        cold = Ordered(df.join(hot, same, "left_anti"), key, order, None)
        return Parted([_sliced(df.join(hot, same, "left_semi"), key, order, slices, total), cold])
    if mode in ("auto", "plain") and key:
        return Ordered(df, key, order, None)
    return _sliced(df, key, order, slices, rows)


def _sliced(df: DataFrame, key: list[str], order: list[str], slices: int | None, rows: int | None) -> Ordered:
    if slices is None:
        slices = slice_count(df.count() if rows is None else rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_key", F.struct(*key) if key else F.struct(F.lit(0).alias("all")))
    cut = written(
        keyed.repartitionByRange(slices, *[F.col(k) for k in key], *[F.col(o) for o in order])
        .sortWithinPartitions(*key, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << _POSITION_BITS) - 1))
    )
    # One row per slice, and at most MOST_SLICES slices (unless the caller names their number).
    of = lambda first: (F.min_by if first else F.max_by)("_key", "_pos")
    borders = cut.groupBy("_slice").agg(F.max("_pos").alias("_end"), of(True).alias("_first"), of(False).alias("_last"))
    edges = [{"slice": r["_slice"], "end": r["_end"], "first": r["_first"], "last": r["_last"]} for r in borders.collect()]
    return Ordered(cut, key, order, sorted(edges, key=lambda e: e["slice"]))
