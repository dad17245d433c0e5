"""Line deduplication that returns keep bitmaps.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ten code points count. Keys are
hashed to 128 bits. The rows of a hash are first summed per salt (a hash of the document), so that a line in a third of all
documents becomes at most ``SALTS`` rows; those are range-partitioned by hash and sorted by hash and document, and the first
document streams down each run of equal hashes. Hashes of two or more documents go back to the lines by an equi-join, where
every line outside the first document is dropped.

The result per document is a bitmap of dropped lines: 64 lines per word, and only words with a dropped line are stored, so a
document without repeated lines has an empty bitmap. Text is rebuilt from document and bitmap by ``apply_bitmaps``.

A document is a doc_id. Rows that repeat a doc_id with another text have bitmaps of their own (told apart by a hash of the
text), but count as one document. Edge cases: null and empty text is one empty line, never dropped; null doc_ids count as
one document after all others; an empty table gives an empty result; extra columns are passed through by ``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.llm.textops import text_hash
from logwarden.session import written

LEAST_LENGTH, SALTS = 10, 16
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    # lower() touches other alphabets too, so it serves pure ASCII lines only.
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def counted_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), position and two 64-bit hashes of every line whose key is long enough."""
    lines = docs.select("doc_id", text_hash(F.col("text")).alias("mark"), F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    keyed = lines.filter(F.octet_length("line") >= LEAST_LENGTH).select("doc_id", "mark", "position", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= LEAST_LENGTH).select(
        "doc_id", "mark", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.reverse("key")).alias("h2"))


def repeated(lines: DataFrame) -> DataFrame:
    """h1, h2 and first_doc of every key that at least two documents hold."""
    # A null id sorts after all ids: (is null, id).
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = lines.groupBy("h1", "h2", salt.alias("salt")).agg(F.min(doc).alias("low"), F.max(doc).alias("high"))
    runs = parts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "low")
    run = Window.partitionBy("h1", "h2").orderBy("low")
    streamed = runs.select("h1", "h2", "low", "high", F.first("low").over(run).alias("first_doc"), F.row_number().over(run).alias("n"),
                           F.lead("low").over(run).alias("next"))
    several = streamed.filter((F.col("n") == 1) & (F.col("next").isNotNull() | (F.col("low") != F.col("high"))))
    return several.select("h1", "h2", F.col("first_doc.none").alias("first_none"), F.col("first_doc.doc_id").alias("first_id"))


def bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, mark, dropped: a map from word number to 64 bits, set where the line is dropped; documents without any are absent."""
    lines = written(counted_lines(docs))
    hits = lines.join(repeated(lines), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    word = F.expr("cast(position div 64 as int)")
    bit = F.expr("shiftleft(cast(1 as bigint), cast(position % 64 as int))")
    words = hits.groupBy("doc_id", "mark", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"))


def is_dropped(bits: Column, position: Column) -> Column:
    word = F.element_at(bits, F.floor(position / 64).cast("int"))
    return F.coalesce(F.getbit(word, (position % 64).cast("int")) == 1, F.lit(False))


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Struct ``doc`` with all columns of ``docs``, and n_lines, n_dropped, kept_text and dropped."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_mark"))
    maps = maps.select(F.col("doc_id").alias("_of"), F.col("mark").alias("_mark"), "dropped")
    joined = rows.join(maps, F.col("_id").eqNullSafe(F.col("_of")) & (rows["_mark"] == maps["_mark"]), "left")
    lines = lines_of(F.col("doc.text"))
    kept = F.array_join(F.filter(lines, lambda line, i: ~is_dropped(F.col("dropped"), i)), "\n")
    count = F.aggregate(F.map_values("dropped"), F.lit(0).cast("bigint"), lambda n, bits: n + F.bit_count(bits))
    return joined.select("doc", F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(count, F.lit(0)).cast("bigint").alias("n_dropped"),
                         F.when(F.col("dropped").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(kept).alias("kept_text"), "dropped")


SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
marked as (select *, min(doc_id) over (partition by key) as lo, max(doc_id) over (partition by key) as hi from keyed),
judged as (select *, length(key) >= 10 and lo <> hi and doc_id <> lo as dropped from marked)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
