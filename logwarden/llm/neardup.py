"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A text becomes the set of its 5-word shingles (64-bit hashes). One hash per shingle gives all minima: the top bits name
the bin, the smallest value of a bin is its minimum, and an empty bin takes the minimum of the first filled bin in its
own fixed random order of bins. Bands of four bins are the buckets.

Rows with equal sets form a class first, so copies never meet in a bucket. In a bucket every class is paired with the
class of the smallest doc_id only: a star, as many pairs as members. Pairs whose signatures agree in at least 77 of 128 bins
(five standard deviations below similarity 0.75) are confirmed on their full sets, and links give components.

A set of few shingles fills few bins, and its signature strays further: of 40,000 simulated pairs with 3 shared of 4 shingles
95 fell below 77 of 128. So pairs whose smaller set has fewer than ``FEW`` shingles skip the cut-off and are judged by their full
sets. What can still be lost are pairs that share no bucket: 5 of the 40,000 pairs with 3 of 4, none of 40,000 with 6 of 8 or
with 4 of 5; and larger sets near similarity 0.75 by the cut-off: 6 of 40,000 pairs that share 30 of 35 and 35 shingles, 2 with
32 of 42, 3 with 36 of 48.

A star alone may lose a link between two classes that are both unlike the centre. So the classes around a centre that are
not in its component (the outsiders) are compared with all classes around that centre that are in another component, in blocks
of at most about ``BLOCK`` by ``BLOCK`` classes per group, so no task grows with a group. Pairs that the 128 bins do not tell apart
are judged by their full sets inside the block, and only a spanning forest leaves it, never pairs. The rows that are
dealt to blocks still grow with outsiders times members: n_out * n_all / 256 copies of a set.

Edge cases: null or wordless text has no shingles and links to nothing; fewer than five words are one shingle; a null
doc_id links to nothing and is kept; rows that repeat a doc_id are judged by their own text; very long texts count whole; an
empty table gives an empty result; other columns are not read, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.textops import BASE, ODD, SPACES, U64, Hasher, Words, binary_parts, chunks, fits, lists, map_texts, mix, text_hash
from logwarden.session import written

BINS, BAND, NIBBLES = 128, 4, 8
LEAST_AGREEMENT = 77
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Pairs whose smaller set has fewer shingles are not judged by signatures; the larger one can have a third more.
FEW = 32
#: Ids of at most so many candidate documents (8 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the set sizes."""
    words = Words(data, bounds, SPACES)
    (h,) = hasher.spans(words.data, words.starts, words.ends)
    left = words.left()
    total = np.minimum(left, size).astype(U64) * ODD[7]
    for j in range(size):
        here = left > j
        total[here] += h[np.flatnonzero(here) + j] * ODD[j]
    head = np.zeros(len(h), dtype=bool)
    head[words.first[:-1][words.counts > 0]] = True
    whole = (left >= size) | head & (np.repeat(words.counts, words.counts) < size)
    shingles = mix(total[whole])
    lengths = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    ends = np.cumsum(lengths)
    for a, b in zip(ends - lengths, ends):
        if b - a > 1:
            shingles[a:b].sort()
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = shingles[1:] != shingles[:-1]
    fresh[(ends - lengths)[lengths > 0]] = True
    seen = np.concatenate([[0], np.cumsum(fresh)])
    return shingles[fresh], seen[ends] - seen[ends - lengths]


def probe_order(bins: int = BINS) -> np.ndarray:
    """Row i: the bins in the order in which an empty bin i looks for a filled one."""
    keys = mix(np.arange(bins * bins, dtype=U64) * U64(BASE) + ODD[5]).reshape(bins, bins)
    return keys.argsort(axis=1, kind="stable")


def places_in(order: np.ndarray) -> np.ndarray:
    """The inverse of a probe order, each bin before all others in its own row."""
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(order))[None, :], axis=1)
    np.fill_diagonal(place, -1)
    return place


def minima(shingles: np.ndarray, sizes: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One-permutation minima of every set, densified; rows of empty sets are 0."""
    total = len(order)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bins = (shingles >> U64(64 - total.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(shingles), dtype=bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    out, filled = np.zeros((len(sizes), total), dtype=U64), np.zeros((len(sizes), total), dtype=bool)
    out[doc[first], bins[first]] = shingles[first]
    filled[doc[first], bins[first]] = True
    known = filled.sum(axis=1)
    # Small sets: every bin picks among the few filled ones at once. Large ones: the few empty bins probe on.
    small = (known > 0) & (known <= total // 8)
    for i in np.flatnonzero(small):
        there = np.flatnonzero(filled[i])
        out[i] = out[i, there[place[:, there].argmin(axis=1)]]
    d, b = np.nonzero(~filled & ((known > 0) & ~small)[:, None])
    for j in range(total):
        if not len(d):
            break
        source = order[b, j]
        found = filled[d, source]
        out[d[found], b[found]] = out[d[found], source[found]]
        d, b = d[~found], b[~found]
    return out


def set_digests(shingles: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums per set that do not depend on order."""
    ends = np.cumsum(sizes)
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(shingles ^ k))]) for k in ODD[2:4]]
    return [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text hash, set size, 128-bit digest of the set, band hashes and 4 bits of every minimum."""

    def make():
        hasher, order = Hasher(), probe_order()
        place = places_in(order)

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(2)):
                shingles, sizes = shingle_sets(data, bounds, hasher)
                digests = set_digests(shingles, sizes)
                low = minima(shingles, sizes, order, place)
                grouped = low.reshape(len(sizes), BINS // BAND, BAND)
                bands = mix((grouped * ODD[:BAND]).sum(axis=2, dtype=U64) + np.arange(BINS // BAND, dtype=U64) * ODD[6])
                bits = (low & U64(15)).reshape(len(sizes), NIBBLES, 16) << (np.arange(16, dtype=U64) * U64(4))
                packed = np.bitwise_or.reduce(bits, axis=2)
                full = lambda m: lists(m.view(np.int64).ravel(), np.full(len(m), m.shape[1]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(sizes, pa.int64()),
                     *map(pa.array, digests), full(bands), full(packed)], names=["doc_id", "_mark", "n", "d1", "d2", "bands", "bits"])

        return step

    return map_texts(docs.select("doc_id", text_hash(F.col("text")).alias("_mark"), F.col("text").cast("binary").alias("text")), make,
                     "doc_id bigint, _mark bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, bits array<bigint>")


def agreeing(a: str, b: str) -> Column:
    """How many of the 128 stored minima agree in their 4 bits."""
    out = F.lit(BINS)
    for i in range(NIBBLES):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3))
        out = out - F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def promising(a: str, b: str) -> Column:
    """Both sizes allow a similarity of 0.75, and the signatures agree well enough or one set is small."""
    low, high = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (low * 100 >= high * 75) & ((low < FEW) | (agreeing(f"{a}_bits", f"{b}_bits") >= LEAST_AGREEMENT))


def of_classes(wanted: DataFrame, docs: DataFrame, name: str, make_values) -> DataFrame:
    """(cid, ``name``) of the wanted classes (cid, doc_id, d2), computed from the text of their representative.

    ``make_values()`` gives a function of (shingles, sizes) that returns one bytes object per text.
    """
    ids = wanted.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids, "doc_id", "left_semi")

    def make():
        hasher, values = Hasher(), make_values()

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(1)):
                shingles, sizes = shingle_sets(data, bounds, hasher)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *map(pa.array, set_digests(shingles, sizes)),
                     pa.array(values(shingles, sizes), pa.binary())], names=["doc_id", "cid", "d2", name])

        return step

    found = map_texts(texts.select("doc_id", F.col("text").cast("binary").alias("text")), make,
                      f"doc_id bigint, cid bigint, d2 bigint, {name} binary")
    # A representative's id may be repeated with other texts: the digest picks its own set, once.
    return written(found.join(wanted, ["doc_id", "cid", "d2"], "left_semi").dropDuplicates(["cid"]).select("cid", name))


def full_sets(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, shingles) of the classes named: their sorted shingle hashes, one after the other."""

    def whole():
        return lambda shingles, sizes: [shingles[e - n:e].tobytes() for e, n in zip(np.cumsum(sizes), sizes)]

    wanted = written(cids.distinct().join(classes.select("cid", F.col("rep").alias("doc_id"), "d2"), "cid"))
    return of_classes(wanted, docs, "shingles", whole)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those with 100 * intersection >= 75 * union of their full shingle sets."""

    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), classes, docs)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def make_tests():
        def step(batch):
            (x, xo), (y, yo) = binary_parts(batch.column(2)), binary_parts(batch.column(3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(v[o[i]:o[i + 1]].tobytes(), dtype=U64) for v, o in ((x, xo), (y, yo)))
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * common >= 75 * (len(s) + len(t) - common)
            yield batch.filter(pa.array(keep)).select([0, 1])

        return step

    return written(map_texts(both, make_tests, "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large-star and small-star steps until nothing changes."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now, before = written(edges.filter("a <> b").select(big.alias("a"), small.alias("b")).distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
        sides = now.union(now.select("b", "a"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        now = written(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            met.select("a", F.col("m").alias("b"))).distinct())


def similar_sets(asked: np.ndarray, values: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets have 100 * intersection >= 75 * union with ``asked``; ``values`` are their sorted shingles with their ``owners``."""
    lo, hi = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
    at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    common = np.bincount(owners[at], minlength=len(sizes))
    return 100 * common >= 75 * (sizes + len(asked) - common)


def around_centres(spokes: DataFrame, state: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between classes around one centre that are in different components: a spanning forest per block.

    Every such pair has an outsider: a class in another component than the centre. So blocks of outsiders meet blocks of
    all classes around the centre; a block holds about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles of either side, whatever
    the size of the group. Inside a block, pairs are judged by their full sets, and one link per merged pair of components
    leaves it: at most one less than it has classes, however many pairs are alike.
    """
    placed = spokes.join(state, F.col("a") == F.col("cid")).drop("cid").join(
        state.select(F.col("cid").alias("b"), F.col("root").alias("own")), "b").select(
        F.col("b").alias("centre"), F.col("a").alias("cid"), "root", (F.col("root") != F.col("own")).alias("outside")).join(
        classes.select("cid", "n", "bits"), "cid")
    parts = lambda chosen: F.ceil(F.greatest(F.count_if(chosen) / BLOCK, F.sum(F.when(chosen, F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    groups = placed.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), parts(F.lit(True)).alias("p_all"),
                                          parts(F.col("outside")).alias("p_out")).filter("lo <> hi").drop("lo", "hi")
    members = written(placed.join(groups, "centre"))
    sets = full_sets(members.select("cid"), classes, docs)
    members = members.join(sets, "cid")
    here = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["centre", "cid", "root", "n", "bits", "shingles", "outside"]
    left = members.filter("outside").select(*own, F.lit(0).alias("side"), here("p_out").alias("i"), all_of("p_all").alias("j"))
    right = members.select(*own, F.lit(1).alias("side"), here("p_all").alias("j"), all_of("p_out").alias("i"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sides = [block[block.side == k] for k in (0, 1)]
        cid, root, n, out = ([x[c].to_numpy().copy() for x in sides] for c in ("cid", "root", "n", "outside"))
        links = []
        if len(cid[0]) and len(cid[1]):
            bits = [np.stack([np.asarray(v, dtype=np.int64).view(U64) for v in x.bits]) for x in sides]
            sets = [[np.frombuffer(v, dtype=U64) for v in x.shingles] for x in sides]
            values, owners = np.concatenate(sets[1]), np.repeat(np.arange(len(n[1])), n[1])
            order = values.argsort(kind="stable")
            values, owners = values[order], owners[order]
        for k in range(len(cid[0]) if len(cid[1]) else 0):
            # A pair of outsiders is met from both sides; the smaller id asks.
            ask = (root[1] != root[0][k]) & (~out[1] | (cid[1] > cid[0][k])) & (
                np.minimum(n[1], n[0][k]) * 100 >= np.maximum(n[1], n[0][k]) * 75)
            at = np.flatnonzero(ask & (np.minimum(n[1], n[0][k]) >= FEW))
            x = bits[1][at] ^ bits[0][k]
            x = (x | x >> U64(1) | x >> U64(2) | x >> U64(3)) & U64(0x1111111111111111)
            ask[at] = BINS - np.bitwise_count(x).sum(axis=1, dtype=np.int64) >= LEAST_AGREEMENT
            if not ask.any():
                continue
            for j in np.flatnonzero(ask & similar_sets(sets[0][k], values, owners, n[1])):
                old, new = root[1][j], root[0][k]
                if old != new:
                    links.append((cid[0][k], cid[1][j]))
                    for r in root:
                        r[r == old] = new
        both = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": both.max(axis=1), "b": both.min(axis=1)})

    blocks = left.select(*own, "side", "i", "j").unionByName(right.select(*own, "side", "i", "j"))
    return written(blocks.groupBy("centre", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct())


def link(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest reachable doc_id), kept, class_size."""
    return judged(docs).drop("_mark")


def judged(docs: DataFrame) -> DataFrame:
    """``link`` with the hash of each row's text, for ids that are repeated with other texts."""
    rows = written(signatures(docs))
    classes = written(rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("bands").alias("bands"),
        F.first("bits").alias("bits")).withColumnRenamed("d1", "cid"))
    slots = classes.select(F.explode("bands").alias("band"), "cid", "rep")
    crowded = slots.groupBy("band").agg(F.min_by("cid", "rep").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    spokes = written(slots.join(crowded.select("band", "centre"), "band").filter("cid <> centre").select(
        F.col("cid").alias("a"), F.col("centre").alias("b")).distinct())
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))
    pairs = written(spokes.join(side("a"), "a").join(side("b"), "b").filter(promising("a", "b")).select("a", "b"))
    roots = components(confirm(pairs, classes, docs))
    # Roots of all classes that share a bucket with another one.
    crowd = spokes.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    state = written(crowd.join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root")))
    links = around_centres(spokes, state, classes, docs)
    if not links.isEmpty():
        of = lambda c: state.select(F.col("cid").alias(c), F.col("root").alias(f"{c}_root"))
        edges = links.join(of("a"), "a").join(of("b"), "b")
        merged = components(edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).distinct()
        state = state.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select(
            "cid", F.coalesce("_to", "root").alias("root"))
    reps = classes.select("cid", "d2", "n", "rep", "class_size").join(state, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = reps.groupBy("root").agg(F.min("rep").alias("lowest"))
    known = reps.join(lowest, "root").select(F.col("cid").alias("d1"), "d2", "n", "lowest", "class_size")
    out = rows.select("doc_id", "_mark", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return out.select("doc_id", "_mark", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; repeated equal rows stay once."""
    key = ["_id", "_mark"]
    dropped = judged(docs).filter("not kept").select(F.col("doc_id").alias("_id"), "_mark").distinct()
    # The row travels as one struct, so no column of the caller's can clash with the key.
    rows = docs.select(F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_mark"), F.struct("*").alias("_row"))
    kept = rows.join(dropped, key, "left_anti")
    again = written(kept.filter("_id is not null").groupBy(*key).count().filter("count > 1").drop("count"))
    single = kept.join(again, key, "left_anti")
    repeated = kept.join(again, key, "left_semi").dropDuplicates(key)
    return single.unionByName(repeated).select("_row.*")
