"""N-gram Jaccard join: globally ordered 4-word shingle sets in tries, shared partial overlaps, remaining-length bounds.

**Global order.** A shingle is a 64-bit hash. All rows count their shingles into 2^18 buckets by its top bits (a table of
bounded size), and the rank of a bucket, most frequent first, replaces these bits: a one-to-one code whose numeric order is the
global order, by frequency, then by hash. A set is the ascending array of its codes.

**Candidates.** Rows with equal sets form a class. A similarity of 0.85 needs 85 of 100 shingles in common, so two alike sets share
one of their n - ceil(0.85 n) + 1 rarest codes: these *tail* codes are the keys. Codes in one tail only need no partner.

**Trie.** The sets under one key are stored in a trie along the global order, with paths without branches as one edge. A probe goes
down all branches at once, level by level; sets that begin alike share the overlap counted so far. A branch is left when
the overlap, plus what the probe and the sizes below leave at most, cannot reach the threshold, when all sets below are in
the probe's component already, or when they have all been probes before. The judgement at a set's end is exact.

**Two rounds.** First every class goes to ``PICKS`` of its keys only, chosen by hash, so that near copies meet; the links give
components. Then the keys are visited under which two components still meet, each list of classes once. Any two alike sets share a
key, so they are in one component by then, or meet under a mixed key: no link between components is lost. In both rounds *outlines*
travel first: counts of a set's codes in cells, a byte for two to four codes. Two sets have no more in common than the smaller
counts of their cells add up to, so a bound on every pair decides which sets go to a key's trie at all. What leaves a trie are
links that merge two components, so never more than classes, however many pairs are alike. Keys with more than ``BLOCK`` classes
or ``BLOCK_CODES`` codes are cut into parts, and every pair of parts is a task of its own.

Edge cases: null or wordless text has no shingles and links to nothing; fewer than four words are one shingle; a null doc_id
links to nothing and its component is null; rows that repeat a doc_id are judged by their own text, and each row's component is that
of its text; very long texts count whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.neardup import components, set_digests, shingle_sets
from logwarden.llm.textops import ARROW_ROWS, U64, Hasher, binary_parts, chunks, fits, lists, map_texts
from logwarden.session import written

SIZE, LEAST = 4, 85
BUCKET_BITS = 18
PICKS, BLOCK, BLOCK_CODES = 2, 2048, 1 << 20
#: Tables of at most so many ids (8 bytes each) are broadcast to filter by; longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A class of more than one row in so many is hot; there are at most so many.
HOT_SHARES = 50_000
LOW = U64(64 - BUCKET_BITS)


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (written), with a broadcast hint when its size is proven."""
    return F.broadcast(df) if fits(df, BROADCAST_IDS) else df


def text_of(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n, d1, d2 (set size and digest); beside them, per task, rows (bucket, times) that count all its shingles."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches):
        hasher, total = Hasher(), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        names = ["doc_id", "n", "d1", "d2", "bucket", "times"]
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                shingles, sizes = shingle_sets(data, bounds, hasher, SIZE)
                total += np.bincount((shingles >> LOW).astype(np.int64), minlength=len(total))
                none = pa.nulls(to - at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()),
                                                  *map(pa.array, set_digests(shingles, sizes)), none, none], names=names)
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(used), pa.array(total[used])], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bucket bigint, times bigint")


def bucket_ranks(counts: DataFrame) -> np.ndarray:
    """Rank of each of the 2^18 buckets, the most frequent first (at most 2^18 rows reach the driver)."""
    times = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    summed = counts.groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    times[summed.column("bucket").to_numpy()] = summed.column("times").to_numpy()
    ranks = np.empty(len(times), dtype=np.int32)
    ranks[np.argsort(-times, kind="stable")] = np.arange(len(times))
    return ranks


def ordered_codes(shingles: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The codes of each set, ascending, one set after the other."""
    codes = ranks[(shingles >> LOW).astype(np.int64)].astype(U64) << LOW | shingles & ((U64(1) << LOW) - U64(1))
    end = 0
    for n in sizes:
        codes[end:end + n].sort()
        end += n
    return codes


def tail_length(n):
    """How many of the rarest codes of a set of n must hold one that an alike set has among its own."""
    return n - (LEAST * n + 99) // 100 + 1


def tails(docs: DataFrame, ranks) -> DataFrame:
    """(cid, tail) of every class: its rarest codes."""

    def make():
        hasher = Hasher()

        def step(batch):
            for _, _, data, bounds in chunks(batch.column(1)):
                shingles, sizes = shingle_sets(data, bounds, hasher, SIZE)
                cid = set_digests(shingles, sizes)[0]
                codes, ends, wanted = ordered_codes(shingles, sizes, ranks.value), np.cumsum(sizes), tail_length(sizes) * (sizes > 0)
                at = np.repeat(ends - wanted, wanted) + np.arange(wanted.sum()) - np.repeat(np.cumsum(wanted) - wanted, wanted)
                out = pa.RecordBatch.from_arrays([pa.array(cid), lists(codes[at].view(np.int64), wanted, pa.int64())], names=["cid", "tail"])
                yield out.filter(pa.array(sizes > 0))

        return step

    return map_texts(text_of(docs), make, "cid bigint, tail array<bigint>").dropDuplicates(["cid"])


def of_classes(wanted: DataFrame, docs: DataFrame, name: str, make_values) -> DataFrame:
    """(cid, ``name``) of the wanted classes (cid, doc_id), from the text of their representative.

    ``make_values()`` gives a function of (shingles, sizes) that returns one bytes object per text.
    """
    ids = written(wanted.select("doc_id").distinct())
    texts = text_of(docs).join(bounded(ids), "doc_id", "left_semi")

    def make():
        hasher, values = Hasher(), make_values()

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(1)):
                shingles, sizes = shingle_sets(data, bounds, hasher, SIZE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(set_digests(shingles, sizes)[0]), pa.array(values(shingles, sizes), pa.binary())],
                    names=["doc_id", "cid", name])

        return step

    found = map_texts(texts, make, f"doc_id bigint, cid bigint, {name} binary")
    # A representative's id may be repeated with other texts: the digest picks its own set, once.
    return written(found.join(wanted, ["doc_id", "cid"], "left_semi").dropDuplicates(["cid"]).select("cid", name))


def code_sets(wanted: DataFrame, docs: DataFrame, ranks) -> DataFrame:
    """(cid, codes) of the wanted classes; codes as big-endian bytes."""

    def make():
        def values(shingles, sizes):
            codes, ends = ordered_codes(shingles, sizes, ranks.value).astype(">u8"), np.cumsum(sizes)
            return [codes[e - n:e].tobytes() for e, n in zip(ends, sizes)]

        return values

    return of_classes(wanted, docs, "codes", make)


def outline_cells(n: int) -> int:
    """Cells of a set's outline: a power of two, a quarter to half of its size."""
    return 1 << max(4, int(n // 2).bit_length() - 1)


def outline(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each cell by their low bits, a byte each; empty where a byte does not do."""
    cells = outline_cells(len(shingles))
    counts = np.bincount((shingles & U64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def outlines(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, outline) of the wanted classes."""
    return of_classes(wanted, docs, "outline", lambda: lambda shingles, sizes: [
        outline(shingles[e - n:e]) for e, n in zip(np.cumsum(sizes), sizes)])


class Trie:
    """Sets of ascending ids, sorted, as a trie whose nodes are edges without branches, numbered so that children follow one another."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        common = [0]
        for a, b in zip(sets, sets[1:]):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common.append(int(differ.argmax()) if differ.any() else m)
        # Nodes as (first set, last set, depth at the end, parent), found level by level from the depths at which neighbours part.
        first, last, depth, begin, child, end_child, term = [0], [len(sets)], [0], [0], [0], [0], [-1]
        spans, common = [np.zeros(0, dtype=np.int64)], np.array([*common, 0], dtype=np.int64)
        node = 0
        while node < len(first):
            a, b, d = first[node], last[node], depth[node]
            child[node] = len(first)
            if len(sets[a]) == d:
                term[node] = a
                a += 1
            if a < b:
                # Children begin where a set has no more than d ids in common with the one before it.
                cuts = np.flatnonzero(common[a + 1:b] <= d) + a + 1
                for x, y in zip([a, *cuts], [*cuts, b]):
                    to = len(sets[x]) if y - x == 1 else int(min(common[x + 1:y].min(), len(sets[x])))
                    first.append(int(x)), last.append(int(y)), depth.append(to), begin.append(d), child.append(0), end_child.append(0), term.append(-1)
                    spans.append(sets[x][d:to])
            end_child[node] = len(first)
            node += 1
        self.first, self.last, self.depth, self.child, self.end_child, self.term = (
            np.array(x, dtype=np.int64) for x in (first, last, depth, child, end_child, term))
        self.ids = np.concatenate(spans)
        lengths = np.array([len(s) for s in spans], dtype=np.int64)
        self.to = np.cumsum(lengths)
        self.at = self.to - lengths
        self.sizes = sizes
        self.least, self.most = self._ranges(sizes, np.minimum), self._ranges(sizes, np.maximum)

    def _ranges(self, values: np.ndarray, of) -> np.ndarray:
        """min or max of ``values`` over the sets below each node."""
        return of.reduceat(np.append(values, values[-1]), np.stack([self.first, self.last], axis=1).ravel())[::2]

    def uniform(self, roots: np.ndarray) -> np.ndarray:
        """The root that all sets below a node have, or -1 where they differ (roots are not negative)."""
        changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
        return np.where(changes[self.first] == changes[self.last - 1], roots[self.first], -1)

    def alike(self, m: int, known: np.ndarray, mark: np.ndarray, skip: np.ndarray) -> list[int]:
        """Sets with 100 * intersection >= 85 * union with a probe of ``m`` codes; nodes in ``skip`` are left out.

        ``known`` are the probe's ids that stored sets have, ascending, and ``mark`` says the same of every id.
        """
        found = []
        nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(nodes):
            # All children of all nodes of this level.
            many = self.end_child[nodes] - self.child[nodes]
            below = np.repeat(self.child[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())
            overlap = np.repeat(overlap, many)
            keep = ~skip[below]
            nodes, overlap = below[keep], overlap[keep]
            if not len(nodes):
                break
            length = self.to[nodes] - self.at[nodes]
            starts = np.cumsum(length) - length
            span = np.repeat(self.at[nodes] - starts, length) + np.arange(length.sum())
            overlap = overlap + np.add.reduceat(mark[self.ids[span]].astype(np.int64), starts)
            depth = self.depth[nodes]
            rest = len(known) - np.searchsorted(known, self.ids[self.to[nodes] - 1], "right")
            size = np.clip(depth + rest, self.least[nodes], self.most[nodes])
            able = (100 + LEAST) * (overlap + np.minimum(rest, size - depth)) >= LEAST * (m + size)
            nodes, overlap, depth = nodes[able], overlap[able], depth[able]
            hit = (self.term[nodes] >= 0) & ((100 + LEAST) * overlap >= LEAST * (m + depth))
            found += self.term[nodes[hit]].tolist()
        return found


def link_sets(cid: np.ndarray, root: np.ndarray, codes: list[bytes], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that merge components: sets of side 0 among each other, or, where side 1 exists, those of side 0 with those of side 1."""
    stored = 1 if (side == 1).any() else 0
    order = sorted(np.flatnonzero(side == stored), key=lambda i: codes[i])
    if not order or len(cid) < 2:
        return []
    arrays = [np.frombuffer(c, dtype=">u8").astype(U64) for c in codes]
    known = np.unique(np.concatenate([arrays[i] for i in order]))
    # Local ids keep the order of the codes. A probe's codes that no stored set has count for its size only.
    trie = Trie([np.searchsorted(known, arrays[i]) for i in order])
    _, roots = np.unique(root, return_inverse=True)
    own = roots[order].copy()
    one, mark = trie.uniform(own), np.zeros(len(known), dtype=bool)
    times = np.bincount(trie.ids, minlength=len(known))
    hits = {i: np.flatnonzero(np.isin(known, arrays[i], assume_unique=True)) if stored else np.searchsorted(known, arrays[i])
            for i in np.flatnonzero(side == 0)}
    # Sets made of widely shared codes first: they link many others, and what is linked need not be visited again.
    ranked = sorted(hits, key=lambda i: (-times[hits[i]].sum() / max(len(arrays[i]), 1), codes[i]))
    place = np.full(len(cid), len(cid), dtype=np.int64)
    if not stored:
        place[ranked] = np.arange(len(ranked))
    latest = trie._ranges(place[order], np.maximum)
    links = []
    for rank, i in enumerate(ranked):
        if one[0] == roots[i]:
            continue
        mark[hits[i]] = True
        found = trie.alike(len(arrays[i]), hits[i], mark, (one == roots[i]) | (latest <= rank))
        mark[hits[i]] = False
        for k in found:
            old, new = own[k], roots[i]
            if old != new:
                links.append((int(cid[i]), int(cid[order[k]])))
                roots[roots == old] = new
                own[own == old] = new
        if found:
            one = trie.uniform(own)
    return links


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns; rows come sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def deal(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members (key, cid, root, n) with their payload, dealt to cells (key, i, j): every two parts of a key meet in one cell.

    A key with more than ``BLOCK`` classes, or ``BLOCK_CODES`` shingles, has several parts. ``side`` is 1 for part j where it is not i.
    """
    size = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_CODES)).cast("int")
    groups = members.groupBy("key").agg(size.alias("parts"), F.count("*").alias("many")).filter("many > 1").drop("many")
    placed = members.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = placed.select("key", "cid", "root", "n", "own", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "root", "n",
        F.when((F.col("own") > F.col("other")), 1).otherwise(0).alias("side"))
    dealt = cells.join(payload, "cid").select("key", "i", "j", "side", "cid", "root", "n", payload.columns[-1])
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def in_cells(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work(table, side, cid, root, n, payload)`` on every cell that has two sets to compare; it returns a RecordBatch."""

    def run(batches):
        for table in grouped(batches, 3):
            side, cid, root, n = (table.column(c).to_numpy() for c in ("side", "cid", "root", "n"))
            if table.num_rows > 1 and (table.column("i")[0] == table.column("j")[0] or side.min() != side.max()):
                data, at = binary_parts(table.column(table.num_columns - 1))
                yield work(table, side, cid, root, n, [data[a:b].tobytes() for a, b in zip(at, at[1:])])

    return dealt.mapInArrow(run, schema)


def possible(side: np.ndarray, root: np.ndarray, n: np.ndarray, payload: list[bytes]) -> np.ndarray:
    """Which sets of a cell may be alike one of another component, by sizes and outlines.

    Two sets share no more than the sum of the smaller counts of their cells, so no alike pair is passed over. The outline of the
    larger set is folded to the cells of the smaller one.
    """
    keep, cross = np.zeros(len(n), dtype=bool), bool((side == 1).any())
    counts = [np.frombuffer(p, dtype=np.uint8).astype(np.int32) for p in payload]
    cells = np.array([len(c) for c in counts])
    by_cells = {c: np.flatnonzero(cells == c) for c in np.unique(cells)}
    tables = {c: np.stack([counts[i] for i in at]) for c, at in by_cells.items() if c}
    folded = {c: t[:, :c // 2] + t[:, c // 2:] for c, t in tables.items()}
    index = np.arange(len(n))
    for i in np.flatnonzero(side == 0):
        asked = (root != root[i]) & (100 * np.minimum(n, n[i]) >= LEAST * np.maximum(n, n[i])) & ((side == 1) if cross else (index > i))
        if not asked.any():
            continue
        c = cells[i]
        if c == 0 or asked[cells == 0].any():
            # No outline, no bound.
            hit = asked if c == 0 else asked & (cells == 0)
            keep |= hit
            keep[i] = True
        for d in (c // 2, c, 2 * c) if c else ():
            at = by_cells.get(d, index[:0])
            chosen = asked[at]
            if d and chosen.any():
                own = counts[i] if d >= c else counts[i][:d] + counts[i][d:]
                table = folded[d] if d > c else tables[d]
                most = np.minimum(table[chosen], own).sum(axis=1)
                hit = at[chosen][(100 + LEAST) * most >= LEAST * (n[at[chosen]] + n[i])]
                keep[hit] = True
                keep[i] |= len(hit) > 0
    return keep


def linked(members: DataFrame, outlines_: DataFrame, classes: DataFrame, docs: DataFrame, ranks) -> DataFrame:
    """Links (a, b) that merge components among the classes of each key; members are (key, cid, root, n).

    Outlines travel to all keys first; full sets only to those under which they leave a pair possible.
    """

    def chosen(table, side, cid, root, n, payload):
        keep = pa.array(possible(side, root, n, payload))
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(keep) for c in ("key", "cid", "root", "n")],
                                          names=["key", "cid", "root", "n"])

    left = written(in_cells(deal(members, outlines_), chosen, "key bigint, cid bigint, root bigint, n bigint").distinct())
    sets = code_sets(left.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("doc_id")), "cid").select("cid", "doc_id"),
                     docs, ranks)

    def join(table, side, cid, root, n, payload):
        links = np.array(link_sets(cid, root, payload, side), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links.max(axis=1)), pa.array(links.min(axis=1))], names=["a", "b"])

    return written(in_cells(deal(left, sets), join, "a bigint, b bigint").distinct())


def merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (cid, root, n) after the links (a, b) between classes."""
    of = lambda c: state.select(F.col("cid").alias(c), F.col("root").alias(f"{c}_root"))
    edges = links.join(of("a"), "a").join(of("b"), "b")
    roots = components(edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).distinct()
    return written(state.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select(
        "cid", F.coalesce("_to", "root").alias("root"), "n"))


def shared_keys(found: DataFrame) -> DataFrame:
    """(key, cid) of the keys that two classes have; most have one. Rows pass once, sorted by key, and one row is held at a time."""
    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    def run(batches):
        held, twin = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held is not None:
                key, cid = np.append(held[0], key), np.append(held[1], cid)
            same = key[1:] == key[:-1]
            keep = np.append(twin, same) | np.append(same, False)
            held, twin = (key[-1:], cid[-1:]), bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep[:-1]]), pa.array(cid[:-1][keep[:-1]])], names=["key", "cid"])
        if held is not None and twin:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["key", "cid"])

    keys = found.select(F.explode("tail").alias("key"), "cid").repartition("key").sortWithinPartitions("key")
    return written(keys.mapInArrow(run, "key bigint, cid bigint"))


def class_roots(docs: DataFrame, classes: DataFrame, ranks) -> DataFrame:
    """(cid, root) of all classes that share a key with another one."""
    held = shared_keys(tails(docs, ranks))
    state = written(held.select("cid").distinct().join(classes.select("cid", "n"), "cid").select("cid", F.col("cid").alias("root"), "n"))
    drawn = outlines(state.join(classes.select("cid", F.col("rep").alias("doc_id")), "cid").select("cid", "doc_id"), docs)
    salted = [F.xxhash64("key", F.lit(i)) for i in range(PICKS)]
    picked = held.groupBy("cid").agg(F.array_distinct(F.array(*[F.min_by("key", h) for h in salted])).alias("keys"))
    first = picked.select(F.explode("keys").alias("key"), "cid").join(state, "cid")
    state = merged(state, linked(written(first), drawn, classes, docs, ranks))
    placed = written(held.join(state, "cid"))
    print_ = F.sum(F.xxhash64("cid").cast("decimal(38,0)"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"), print_.alias("print"))
    # Keys with the same classes are visited once.
    once = written(mixed.filter("lo < hi").groupBy("many", "print").agg(F.min("key").alias("key")).select("key"))
    return merged(state, linked(written(placed.join(bounded(once), "key")), drawn, classes, docs, ranks)).drop("n")


def link(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest reachable doc_id, null for a null id), class_size."""
    spark = docs.sparkSession
    seen = written(scan(docs))
    ranks = spark.sparkContext.broadcast(bucket_ranks(seen.filter("bucket is not null")))
    rows = seen.filter("bucket is null").drop("bucket", "times")
    classes = written(rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("class_size")).withColumnRenamed("d1", "cid"))
    state = class_roots(docs, classes, ranks)
    reps = classes.join(state, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = reps.groupBy("root").agg(F.min("rep").alias("lowest"))
    known = written(reps.join(lowest, "root").select(F.col("cid").alias("d1"), "d2", "n", "lowest", "class_size"))
    key = ["d1", "d2", "n"]
    hot = F.col("class_size") > max(rows.count() // HOT_SHARES, 1)
    frequent, rest = F.broadcast(known.filter(hot)), known.filter(~hot)
    asked = rows.filter("doc_id is not null")
    out = asked.join(frequent, key).unionByName(asked.join(frequent.select(*key), key, "left_anti").join(rest, key, "left")).unionByName(
        rows.filter("doc_id is null"), allowMissingColumns=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"),
                      F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) AS shingles
  FROM w WHERE len(words) > 0),
classes AS (SELECT list_sort(shingles) AS shingles, len(shingles) AS n, min(doc_id) AS rep FROM s GROUP BY ALL),
t AS (SELECT rep, n, hash(unnest(shingles)) AS shingle FROM classes),
shared AS (SELECT shingle FROM t GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT t.* FROM t JOIN shared USING (shingle)),
links AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 185 * count(*) >= 85 * (any_value(a.n) + any_value(b.n))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rep, met) AS (SELECT rep, rep FROM classes UNION SELECT reach.rep, ways.b FROM reach JOIN ways ON reach.met = ways.a),
comps AS (SELECT rep, min(met) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(s.shingles), 0) AS BIGINT) AS n_shingles, coalesce(comps.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN classes ON list_sort(s.shingles) = classes.shingles LEFT JOIN comps USING (rep)
"""
