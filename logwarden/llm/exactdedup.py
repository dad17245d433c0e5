"""Exact duplicates through a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text without its white space. The index is split into buckets by digest. Per bucket it keeps a
cuckoo filter (16-bit fingerprints, four per slot, two slots per digest) and, in files of its own, the content that the filter
stands for: the full digests with their live counts and best row. A change batch is summed per digest and salt first, so a
digest that a third of all rows share arrives as a few rows. The batch asks the filters of the buckets that it touches. Only
buckets with a hit, or with too little room in their filter, have their content read, which verifies the hits, and rewritten;
in the others all insertions are new and are appended; buckets that the batch does not touch keep their files. When an
insertion finds no place, the filter is built anew with twice the slots from the stored digests. A deletion lowers the live
count, and at zero removes fingerprint and digest. When the buckets overflow, every one is split by the next bits of the digest.

A batch is written under a new name and published by one manifest, so a batch that dies leaves the index as it was, and one
that is repeated changes nothing.

The best row of a digest is the one with the most code points, then the smallest doc_id (null last). A deletion that takes
away the best row while others live leaves the best row open (null) until ``resolve`` is run on the live rows.

Edge cases: null text counts as empty, and all wordless texts are equal; very long texts are read whole; rows that repeat the
winning doc_id with its length are all marked kept, so rows repeated exactly all stay (the SQL twin's rule); an empty batch
leaves the index as it is; extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logwarden.session import scratch_path, written
from logwarden.sources.tables import Commits

SLOT, KICKS, LEAST_SLOTS = 4, 200, 64
#: Digests per bucket, the least and the largest number of buckets, and the salts that a digest's rows are summed under.
BUCKET_DIGESTS, LEAST_BUCKETS, MOST_BUCKETS, SALTS = 20_000, 64, 1 << 16, 16
#: A filter that would be fuller than this is built anew; so many appended files of a bucket become one.
FULL, FILES = 0.85, 8
#: Digests with more than one row in so many are joined by broadcast; there are at most so many of them.
HOT_SHARES = 1_000
SPACE = r"[\x20\x09-\x0D]+"
CONTENT = "bucket int, digest string, live bigint, best_length bigint, best_id bigint"
FILTER = "bucket int, digests bigint, slots int, filter binary"
INDEX = f"kind string, {CONTENT}, digests bigint, slots int, filter binary"


class CuckooFilter:
    """Approximate set with deletion: a fingerprint lies in one of two slots that can be told from each other."""

    def __init__(self, slots: int, table: bytes | None = None):
        self.slots = slots
        self.table = np.zeros((slots, SLOT), dtype=np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(slots, SLOT).copy()

    def places(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[16:20], 16) or 1
        first = int(digest[20:32], 16) & (self.slots - 1)
        return mark, first, self.other(first, mark)

    def other(self, slot: int, mark: int) -> int:
        return (slot ^ (mark * 0x5BD1E995)) & (self.slots - 1)

    def __contains__(self, digest: str) -> bool:
        mark, a, b = self.places(digest)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def add(self, digest: str) -> bool:
        """False when no place was found; the filter then lacks some fingerprint and must be built anew."""
        mark, a, b = self.places(digest)
        for slot in (a, b):
            free = np.flatnonzero(self.table[slot] == 0)
            if len(free):
                self.table[slot, free[0]] = mark
                return True
        slot = a
        for kick in range(KICKS):
            out = int(self.table[slot, kick % SLOT])
            self.table[slot, kick % SLOT] = mark
            mark, slot = out, self.other(slot, out)
            free = np.flatnonzero(self.table[slot] == 0)
            if len(free):
                self.table[slot, free[0]] = mark
                return True
        return False

    def remove(self, digest: str) -> None:
        mark, a, b = self.places(digest)
        for slot in (a, b):
            held = np.flatnonzero(self.table[slot] == mark)
            if len(held):
                self.table[slot, held[0]] = 0
                return

    @classmethod
    def of(cls, digests, slots: int) -> "CuckooFilter":
        while True:
            made = cls(slots)
            if all(made.add(d) for d in digests):
                return made
            slots *= 2


def filter_of(rows: pd.DataFrame) -> tuple[CuckooFilter, int] | None:
    """The filter among a bucket's rows and the number of its digests."""
    kept = rows[rows.slots.notna()]
    return (CuckooFilter(int(kept.slots.iloc[0]), kept["filter"].iloc[0]), int(kept.digests.iloc[0])) if len(kept) else None


def rows_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "bucket", "digest", "live", "best_length", "best_id", "digests", "slots", "filter"], dtype=object)
    return out.astype({"bucket": "int32", "live": "Int64", "best_length": "Int64", "best_id": "Int64", "digests": "Int64", "slots": "Int32"})


def slots_for(digests: int) -> int:
    return max(LEAST_SLOTS, 1 << (max(int(digests / (SLOT * FULL)), 1)).bit_length())


def change_bucket(bucket: int, stored: pd.DataFrame, changes: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """What a batch writes for a bucket: its filter, and its content (``whole``) or else the digests that are new.

    The filter's row has no slots when a filter overflowed whose digests are not among ``stored``.
    """
    held = stored[stored.digest.notna()]
    live = {r.digest: [int(r.live), r.best_length, r.best_id] for r in held.itertuples()}
    index, total = filter_of(stored) or (CuckooFilter(slots_for(changes.digest.nunique())), 0)
    complete = whole or total == 0
    rank = lambda length, doc: (-length, pd.isna(doc), 0 if pd.isna(doc) else doc)
    # Insertions first: a batch may move a digest's rows.
    for r in changes.sort_values(["added"], ascending=False).itertuples():
        known = r.digest in index and r.digest in live
        if r.added:
            if known:
                entry = live[r.digest]
                entry[0] += int(r.rows)
                if not pd.isna(entry[1]) and rank(r.length, r.doc_id) < rank(entry[1], entry[2]):
                    entry[1:] = [r.length, r.doc_id]
            else:
                live[r.digest] = [int(r.rows), r.length, r.doc_id]
                total += 1
                if not index.add(r.digest):
                    if not complete:
                        return rows_of([("filter", bucket, *[None] * 7)])
                    index = CuckooFilter.of(live, index.slots * 2)
        elif known:
            entry = live[r.digest]
            entry[0] -= int(r.rows)
            if entry[0] <= 0:
                del live[r.digest]
                index.remove(r.digest)
                total -= 1
            elif not pd.isna(entry[1]) and rank(r.length, r.doc_id) <= rank(entry[1], entry[2]):
                entry[1:] = [None, None]
    return rows_of([("content", bucket, d, n, a, i, None, None, None) for d, (n, a, i) in live.items()]
                   + [("filter", bucket, None, None, None, None, total, index.slots, index.table.tobytes())])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points and digest of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("bigint").alias("length"),
                       F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256).alias("digest"))


def summed(rows: DataFrame, added: bool) -> DataFrame:
    """A change batch: rows per digest and salt, with the best of them."""
    best = F.max(F.struct("length", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("low"))).alias("best")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    return rows.groupBy("digest", salt.alias("salt")).agg(best, F.count("*").alias("rows")).select(
        "digest", "rows", F.col("best.length").alias("length"), (-F.col("best.low")).alias("doc_id"), F.lit(added).alias("added"))


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def buckets_for(digests: int) -> int:
    """Buckets for so many digests, a power of two."""
    wanted = min(max(LEAST_BUCKETS, digests // BUCKET_DIGESTS), MOST_BUCKETS)
    return 1 << (wanted - 1).bit_length()


class LiveIndex:
    """Live digests under a path of a file system that all executors share. One writer at a time.

    A manifest names per bucket the batch that wrote its filter and the batches that wrote its content. Only numbers of buckets
    (at most ``MOST_BUCKETS``) come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """``buckets``: how many a new index begins with, a power of two; chosen by its first batch if not given."""
        self.spark, self.path, self.buckets = spark, path or scratch_path(spark), buckets
        self.commits = Commits(spark, self.path)

    def _read(self, kind: str, schema: str, parts: dict, chosen: set[int] | None) -> DataFrame:
        names = [(b, n) for b, files in parts.items() if chosen is None or int(b) in chosen for n in files]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}/_kind={kind}/_bucket={b}" for b, n in names])

    def _filters(self, state: dict, chosen: set[int] | None) -> DataFrame:
        return self._read("filter", FILTER, {b: [n] for b, n in state.get("filters", {}).items()}, chosen)

    def content(self, chosen: set[int] | None = None) -> DataFrame:
        """bucket, digest, live, best_length and best_id of the live digests, of the chosen buckets or of all."""
        return self._read("content", CONTENT, self.commits.load()[1].get("content", {}), chosen)

    def apply(self, changes: DataFrame, *, writer: str | None = None, batch: int | None = None) -> bool:
        """Apply ``summed`` insertions and deletions; whether they were applied (a repeated batch of a writer is not)."""
        version, state = self.commits.load()
        if self.commits.done(state, writer, batch):
            return False
        changes = changes if state or self.buckets else written(changes)
        buckets = state.get("buckets") or self.buckets or buckets_for(changes.count())
        placed = written(changes.withColumn("bucket", bucket_of(F.col("digest"), buckets)))
        touched = {r[0] for r in placed.select("bucket").distinct().collect()}
        content = dict(state.get("content", {}))
        whole = {int(b) for b, files in content.items() if len(files) >= FILES} & touched
        if state.get("filters"):
            whole |= {r[0] for r in self._asked(state, placed, touched, False).select("bucket").distinct().collect()}
        while True:
            name = uuid.uuid4().hex
            self._changed(state, placed, touched, whole).write.partitionBy("_kind", "_bucket").parquet(f"{self.path}/data/{name}")
            overflow = [r[0] for r in self.spark.read.schema(FILTER).parquet(f"{self.path}/data/{name}/_kind=filter").filter(
                "slots is null").select("bucket").collect()] if touched else []
            if not overflow:
                break
            whole |= set(overflow)
        there = {int(f.split("=")[1]) for f in self.commits.folders(f"data/{name}/_kind=content") if f.startswith("_bucket=")}
        for b in touched:
            files = [*([] if b in whole else content.get(str(b), [])), *([name] if b in there else [])]
            content[str(b)] = files
        state = {"buckets": buckets, "content": content, "filters": {**state.get("filters", {}), **{str(b): name for b in touched}},
                 "writers": {**state.get("writers", {}), **({} if writer is None else {writer: batch})}}
        self.commits.publish(version + 1, state)
        self.split()
        return True

    def _changed(self, state: dict, placed: DataFrame, touched: set[int], whole: set[int]) -> DataFrame:
        stored = self._filters(state, touched).unionByName(self._read("content", CONTENT, state.get("content", {}), whole), allowMissingColumns=True)

        def run(key, stored: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            return change_bucket(int(key[0]), stored, batch, int(key[0]) in whole)

        out = stored.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInPandas(run, INDEX)
        return out.withColumn("_kind", F.col("kind")).withColumn("_bucket", F.col("bucket"))

    def _asked(self, state: dict, placed: DataFrame, touched: set[int], hits_only: bool) -> DataFrame:
        """bucket and digest of the rows that hit their filter; unless ``hits_only`` also one row of a bucket without room."""

        def run(key, stored: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            index, total = filter_of(stored) or (None, 0)
            asked = batch.digest.unique()
            hits = [d for d in asked if index is not None and d in index]
            if not hits and not hits_only and index is not None and total + len(asked) > FULL * SLOT * index.slots:
                hits = [None]
            return pd.DataFrame({"bucket": int(key[0]), "digest": pd.Series(hits, dtype=object)})

        return self._filters(state, touched).groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInPandas(run, "bucket int, digest string")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The distinct digests of ``rows`` that are live: the filters are asked, hits are verified against the content."""
        state = self.commits.load()[1]
        if not state.get("filters"):
            return rows.select("digest").limit(0)
        asked = rows.select("digest").distinct().withColumn("bucket", bucket_of(F.col("digest"), state["buckets"]))
        hits = written(self._asked(state, asked, set(map(int, state["filters"])), True))
        chosen = {r[0] for r in hits.select("bucket").distinct().collect()}
        return hits.select("digest").join(self._read("content", CONTENT, state["content"], chosen).select("digest"), "digest", "left_semi")

    def split(self) -> bool:
        """Split all buckets by the next bits of the digest when they hold more than they should on average; whether they did.

        Digests spread evenly, so all buckets overflow at about the same time.
        """
        version, state = self.commits.load()
        total = self._filters(state, None).agg(F.sum("digests")).first()[0] or 0
        if total <= state.get("buckets", 0) * BUCKET_DIGESTS or state["buckets"] >= MOST_BUCKETS:
            return False
        stored, buckets = self.content(), buckets_for(total)
        placed = written(stored.select("digest", F.col("live").alias("rows"), F.col("best_length").alias("length"), F.col("best_id").alias("doc_id"),
                                       F.lit(True).alias("added"), bucket_of(F.col("digest"), buckets).alias("bucket")))
        touched, name = {r[0] for r in placed.select("bucket").distinct().collect()}, uuid.uuid4().hex
        self._changed({}, placed, touched, set()).write.partitionBy("_kind", "_bucket").parquet(f"{self.path}/data/{name}")
        self.commits.publish(version + 1, {**state, "buckets": buckets, "content": {str(b): [name] for b in touched},
                                           "filters": {str(b): name for b in touched}})
        return True

    def vacuum(self) -> None:
        """Delete the data folders that the newest manifest does not name; no reader may still use them."""
        state = self.commits.load()[1]
        self.commits.drop_except({n for files in state.get("content", {}).values() for n in files} | set(state.get("filters", {}).values()))


def resolve(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, by inserting all rows into a new index.

    Rows of digests that many rows share meet their group by broadcast, all others by shuffle.
    """
    rows = written(digests(docs))
    index = LiveIndex(docs.sparkSession)
    index.apply(summed(rows, True))
    groups = index.content().select("digest", F.col("live").alias("group_size"), F.col("best_id").alias("keep_id"), F.col("best_length").alias("_best"))
    hot = F.col("group_size") > max(rows.count() // HOT_SHARES, 1)
    few = F.broadcast(groups.filter(hot))
    found = rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~hot), "digest"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("_best"))
    return found.select("doc_id", "keep_id", "group_size", same.alias("kept"), F.col("digest").alias("text_sha256"))


SQL = """
with rows as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256
  from documents),
best as (
  select *, first_value(doc_id) over w as keep_id, first_value(n) over w as best, count(*) over (partition by text_sha256) as group_size
  from rows window w as (partition by text_sha256 order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id and n = best as kept, text_sha256 from best
"""
