"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 60-bit hash. A source's target beyond its size (whole passes over it) is taken by all its
documents; the rest of the budget is met by a threshold: documents with a smaller hash are taken once more. The threshold
is found from histograms alone: sizes summed by source and the top 12 bits give the bucket in which the budget ends, only
that bucket is split by the next 12 bits, and so on through 60 bits; the last bucket is a single hash and is taken when
that brings the sum nearer to the target. Rows are never sorted, the filter is a comparison with the threshold.

Targets: the sources in code point order, null last, weigh 5, 2, 1, repeating; together they may take 1.5 times all words;
no target exceeds twice its source's size, and what a full source leaves is shared again by weight.

Edge cases: null text has size 0 and is taken 0; null doc_ids share one hash; repeated rows are equal and are taken or left
together; an empty table gives an empty result; other columns are passed through by ``mix_documents`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.session import written

LEVEL_BITS, LEVELS = 12, 5
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def position(doc_id: Column) -> Column:
    """The document's fixed place in 0 .. 2^60 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target. Only the totals per source are ordered and shared out."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: this window holds as many rows as there are sources.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    shares = written(totals.withColumn("weight", weight))
    # A source is full once the level (words per weight) passes its cap / weight; full sources leave, the level rises.
    open_ = F.lit(True)
    while True:
        row = shares.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(~open_, F.col("source_size") * MOST)).alias("full"),
            F.sum(F.when(open_, F.col("weight"))).alias("weights"),
            F.sum(F.when(~open_, 1).otherwise(0)).alias("n"),
        ).first()
        if not row["weights"]:
            level = float("inf")
            break
        level = (row["all"] * BUDGET - (row["full"] or 0.0)) / row["weights"]
        now_open = F.col("source_size") * MOST > F.col("weight") * level
        if shares.filter(~now_open).count() == row["n"]:
            break
        open_ = now_open
    target = F.least(F.col("weight") * level, F.col("source_size") * MOST)
    return shares.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole passes, the hash below which one more copy is taken, and whether the hash itself is included."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn(
        "prefix", F.lit(0).cast("bigint"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sized
        if level:
            s = state.alias("s")
            inside = sized.join(s, sized["source"].eqNullSafe(F.col("s.source")) & (F.shiftright(sized["place"], shift + LEVEL_BITS) == F.col("s.prefix"))).select(
                sized["source"], sized["place"], sized["size"])
        cells = inside.groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("upto", upto)
        # The first cell whose running sum passes the rest of the budget is the boundary cell.
        c, s = cells.alias("c"), state.alias("s")
        hit = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).filter(F.col("upto") > F.col("rest")).groupBy(
            F.col("c.source").alias("source")).agg(F.min(F.struct("cell", "upto", "words")).alias("at"))
        h = hit.alias("h")
        joined = state.alias("s").join(h, F.col("s.source").eqNullSafe(F.col("h.source")), "left")
        # No such cell: the rest takes the whole range, so the boundary lies beyond its last cell.
        past = F.shiftleft(F.col("s.prefix") + 1, LEVEL_BITS) if level else F.lit(1 << LEVEL_BITS).cast("bigint")
        state = written(joined.select(
            "s.source", "source_size", "target", "passes",
            F.when(F.col("at").isNull(), F.col("rest")).otherwise(F.col("rest") - (F.col("at.upto") - F.col("at.words"))).alias("rest"),
            F.coalesce("at.cell", past).alias("prefix"), F.col("at.words").alias("edge")))
    return state.withColumn("inclusive", F.coalesce(F.col("rest") * 2 >= F.col("edge"), F.lit(False)))


def mix_documents(docs: DataFrame) -> DataFrame:
    """All columns and rows of ``docs`` in a struct ``doc``, with size, source_size, target and taken."""
    text = F.col("text")
    sized = written(docs.select("doc_id", "source", word_count(text).alias("size"), position(F.col("doc_id")).alias("place")))
    goals = written(targets(sized))
    edges = written(thresholds(sized, goals))
    d = docs.select(F.struct("*").alias("doc"), F.col("source").alias("_source"), word_count(text).alias("size"),
                    position(F.col("doc_id")).alias("_place"))
    below = (F.col("_place") < F.col("prefix")) | (F.col("inclusive") & (F.col("_place") == F.col("prefix")))
    times = F.coalesce(F.col("passes") + below.cast("bigint"), F.lit(0))
    # One row per source on the small side; the optimiser broadcasts it by its measured size.
    return d.join(edges.withColumnRenamed("source", "_key"), F.col("_source").eqNullSafe(F.col("_key")), "left").select(
        "doc", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies per row, without shuffling texts."""
    slim = docs.select("doc_id", "source", "text")
    return mix_documents(slim).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def draw(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken (0, 1 or 2 times), with its own columns."""
    taken = mix_documents(docs).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from documents),
totals as (
  select source, sum(size)::double as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source),
ranked as (
  select *, 2 * source_size as cap, sum(source_size) over () * 1.5 as budget,
         coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
         sum(weight) over () - coalesce(sum(weight) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights_left
  from totals),
level as (
  select arg_min((budget - full_before) / weights_left, cap / weight) filter (where cap / weight >= (budget - full_before) / weights_left) as l from ranked),
goals as (select source, source_size, least(weight * l, cap) as target,
                 case when source_size > 0 then floor(least(weight * l, cap) / source_size) else 0 end as passes from ranked, level),
summed as (
  select s.*, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size as rest,
         sum(s.size) over (partition by s.source order by s.place) as upto,
         sum(s.size) over (partition by s.source, s.place) as own
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size::bigint as source_size, target,
       (size * (passes + case when upto <= rest or (upto - own <= rest and (rest - (upto - own)) * 2 >= own) then 1 else 0 end))::bigint as taken
from summed
"""
