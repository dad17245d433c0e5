"""Exact percentiles (linear interpolation) of wide columns.

Small inputs use Spark's ``percentile``, which keeps every distinct value in one buffer. Beyond ``BUILTIN_ROWS`` the first
pass builds a mergeable rank sketch per column (``percentile_approx``, rank error at most n / ``ACCURACY``), which gives a bracket
of values around every wanted rank. The second pass counts exactly: rows between the brackets, and inside them the
values themselves when few rows are expected there, else equal-width bins, of which a third pass counts the one that holds the rank.
So two or three passes do at any size; a rank that its bracket missed, or a bin still full, is narrowed further. Ranks
come from counts only, so the sketch decides about speed, never about values. A pass shuffles at most bins x targets rows per task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, functions as F

BUILTIN_ROWS = 100_000
BINS = 4096
DIRECT_ROWS = 50_000
#: Rank error of the sketch is n / ACCURACY; a bracket reaches MARGIN (a share of n) to either side.
ACCURACY, MARGIN = 10_000, 2e-4
#: Rows the sketch sees where the caller knows how many there are; its bracket then reaches six deviations of their ranks further.
SKETCH_ROWS = 2_000_000


def quantiles(df: DataFrame, columns: list[str], qs: list[float], *, builtin_rows: int = BUILTIN_ROWS,
              rows: int | None = None) -> dict[str, list[float | None]]:
    """``{column: [value per q]}``; nulls are ignored, an empty column gives None. ``rows`` (of df) lets the sketch see fewer rows."""
    return measured(df, columns, qs, [], builtin_rows=builtin_rows, rows=rows)[0]


def measured(df: DataFrame, columns: list[str], qs: list[float], also: list, *, builtin_rows: int = BUILTIN_ROWS,
             rows: int | None = None) -> tuple[dict[str, list[float | None]], Row]:
    """``quantiles``, and a row with the aggregates ``also`` taken in the pass that measures the ranges."""
    x = lambda c: F.col(c).cast("double")
    finite = lambda c: (F.abs(x(c)) < math.inf) & ~F.isnan(x(c))
    few = rows is not None and rows > SKETCH_ROWS
    margin = [MARGIN + (6 * math.sqrt(q * (1 - q) / SKETCH_ROWS) if few else 0.0) for q in qs]
    near = [p for q, m in zip(qs, margin) for p in (max(0.0, q - m), min(1.0, q + m))]
    seen = lambda c: finite(c) & F.col("_seen") if few else finite(c)
    # Every row is counted; the sketch only places the brackets.
    stats = (df.withColumn("_seen", F.rand(1) < SKETCH_ROWS / rows) if few else df).agg(
        *[F.percentile_approx(F.when(seen(c), x(c)), near, ACCURACY).alias(f"near{i}") for i, c in enumerate(columns) if qs],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(x(c) == -math.inf).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.count_if(finite(c)).alias(f"mid{i}") for i, c in enumerate(columns)],
        *[F.count_if(x(c) == math.inf).alias(f"high{i}") for i, c in enumerate(columns)],
        *[F.min(F.when(finite(c), x(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.when(finite(c), x(c))).alias(f"hi{i}") for i, c in enumerate(columns)],
        *also,
    ).first()
    if max(stats[f"n{i}"] for i in range(len(columns))) <= builtin_rows:
        wanted = F.array(*[F.lit(float(q)) for q in qs])
        row = df.agg(*[F.percentile(c, wanted).alias(f"p{i}") for i, c in enumerate(columns)]).first()
        return {c: list(row[f"p{i}"] or [None] * len(qs)) for i, c in enumerate(columns)}, stats

    # Order: -inf, finite values, inf, NaN. Only ranks among the finite values are searched for.
    ranks: dict[tuple[int, int], dict] = {}
    for i in range(len(columns)):
        n = stats[f"n{i}"]
        for k, q in enumerate(qs if n else []):
            at = q * (n - 1)
            for r in {math.floor(at) - stats[f"low{i}"], math.ceil(at) - stats[f"low{i}"]}:
                if 0 <= r < stats[f"mid{i}"]:
                    # With infinite values the sketch of the finite ones is asked for other ranks: the count tells.
                    lo, hi = (stats[f"near{i}"] or [stats[f"lo{i}"], stats[f"hi{i}"]] * len(qs))[2 * k:2 * k + 2]
                    ranks[i, r] = {"lo": lo, "hi": hi, "below": None, "ends": (stats[f"lo{i}"], stats[f"hi{i}"]),
                                   "n": 2 * (margin[k] + 1 / ACCURACY) * stats[f"mid{i}"]}
    found = _select(df, columns, ranks)

    def value(i: int, rank: int) -> float:
        r = rank - stats[f"low{i}"]
        if r < 0:
            return -math.inf
        if r < stats[f"mid{i}"]:
            return found[i, r]
        return math.inf if r < stats[f"mid{i}"] + stats[f"high{i}"] else math.nan

    out = {}
    for i, c in enumerate(columns):
        n = stats[f"n{i}"]
        values = []
        for q in qs:
            if not n:
                values.append(None)
                continue
            at = q * (n - 1)
            share = at - math.floor(at)
            low, high = value(i, math.floor(at)), value(i, math.ceil(at))
            values.append(low if share == 0 or low == high else (1 - share) * low + share * high)
        out[c] = values
    return out, stats


def _disjoint(brackets: set[tuple[int, float, float]]) -> list[tuple[int, float, float]]:
    """Brackets that overlap become one, so a row falls in at most one per column."""
    out: list[tuple[int, float, float]] = []
    for i, lo, hi in sorted(brackets):
        if out and out[-1][0] == i and lo <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(out[-1][2], hi))
        else:
            out.append((i, lo, hi))
    return out


def _select(df: DataFrame, columns: list[str], open_ranks: dict) -> dict:
    """Value at each (column index, 0-based rank); ``open_ranks`` maps it to its bracket."""
    found: dict = {}
    while True:
        for key, b in list(open_ranks.items()):
            if b["lo"] == b["hi"] and b["below"] is not None:
                found[key] = b["lo"]
                del open_ranks[key]
        if not open_ranks:
            return found
        brackets = _disjoint({(i, b["lo"], b["hi"]) for (i, _), b in open_ranks.items()})
        inside = {(i, b["lo"], b["hi"]): b["n"] for (i, _), b in open_ranks.items()}
        direct = sum(inside.values()) <= DIRECT_ROWS
        # Rows between brackets count as one cell per gap (bin -1), so that the ranks inside are known.
        cells = {}
        for t, (i, lo, hi) in enumerate(brackets):
            x = F.col(columns[i]).cast("double")
            width = (hi - lo) / BINS or 1.0
            at = F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
            bin_ = F.lit(0) if direct else (
                F.when(x == F.lit(lo), F.lit(0)).when(x == F.lit(hi), F.lit(BINS - 1))
                .otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at))))
            cell = lambda t, b, x: F.struct(F.lit(t).alias("t"), b.alias("b"), x.alias("x"))
            # What lies below the column's first brackets was sorted out by the earlier conditions.
            start = cells.get(i, F.when(~((F.abs(x) < math.inf) & ~F.isnan(x)), None))
            cells[i] = start.when(x < F.lit(lo), cell(t, F.lit(-1), F.lit(lo))).when(x <= F.lit(hi), cell(t, bin_, x))
        rows = df.select(F.explode(F.array(*cells.values())).alias("c")).filter("c is not null").select("c.*")
        if direct:
            counted = rows.groupBy("t", "b", F.col("x").alias("lo")).agg(F.count(F.lit(1)).alias("n")).withColumn("hi", F.col("lo"))
        else:
            counted = rows.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_column: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["t"], r["b"], r["lo"])):
            by_column.setdefault(brackets[r["t"]][0], []).append(r)
        for (i, rank), b in open_ranks.items():
            below, hit = 0, None
            for c in by_column.get(i, []):
                if rank < below + c["n"]:
                    hit = c if c["b"] >= 0 else None
                    break
                below += c["n"]
            if hit is None:
                # The sketch was off for this rank: look everywhere.
                b.update(lo=b["ends"][0], hi=b["ends"][1], below=None, n=math.inf)
            else:
                b.update(lo=hit["lo"], hi=hit["hi"], below=below, n=hit["n"])
