"""Filter audit, n-gram join and hard negatives against plain Python, on tables with every odd case."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from conftest_rows import messy_rows, sentence

import corpus_brute as brute
from logwarden.llm import filteraudit, hardneg, ngramjoin

ROWS, _ = messy_rows()


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


LABELS = [(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (8, 1, 1), (200, 1, 0), (201, 0, 1), (202, 1, 1), (None, 1, 1), (999, 1, 1), (100, 0, 0)]


def test_filter_audit(messy, spark):
    """Every order is applied row by row."""
    labels = spark.createDataFrame([(*r, "x", 5) for r in LABELS], "doc_id bigint, quality int, toxic int, source string, class int")
    got = filteraudit.audit(messy, labels).collect()
    good, toxic = ({r[0] for r in LABELS if r[0] is not None and r[k] == 1} for k in (1, 2))
    first = {}
    for doc, text, _, _ in ROWS:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    marks = [("".join(x for x in filteraudit.FILTERS if x in brute.failed(t) or x == "E" and d is not None and d > first[t or ""]), d, s or "")
             for d, t, _, s in ROWS]
    want, total = {}, collections.Counter()
    for part in {m[2] for m in marks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [m for m in marks if m[2] == part], []
            for step, f in enumerate(order):
                removed = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                want[part, order, step + 1] = [len(left), len(removed), sum(f in m[0] for m in gone), sum(m[0] == f and m[2] == part for m in marks),
                                               sum(m[1] in good for m in removed), sum(m[1] in toxic for m in removed)]
                total[part, f] += len(removed)
                gone += removed
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    assert len(got) == len(want) and all(r.shapley == total[r.part, r.filter_order[r.step - 1]] for r in got)


def test_filter_audit_of_nothing(empty, spark):
    assert filteraudit.audit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).isEmpty()


def test_filter_audit_gives_sums_away(messy, spark, monkeypatch):
    """More parts than a task holds: sums given early add up to the same."""
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    want = bag(filteraudit.audit(messy, labels).collect())
    monkeypatch.setattr(filteraudit, "MOST_HELD", 1)
    assert bag(filteraudit.audit(messy, labels).collect()) == want


def test_positional_popcounts():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 2, 3, 1000, 7)]
    counter = filteraudit.Popcounts()
    for p in parts:
        counter.add(p)
    words = np.concatenate(parts)
    assert counter.counts().tolist() == [int((words >> np.uint32(s) & 1).sum()) for s in range(32)]
    assert all(len(level) <= 2 for level in counter.levels)


def near(rows):
    return bag(brute.near(rows, ngramjoin.SIZE, ngramjoin.LEAST))


def join(df):
    return bag(ngramjoin.link(df).select("doc_id", "n_shingles", "component_id").collect())


def test_ngram_join(messy):
    assert join(messy) == near([(r[0], r[1]) for r in ROWS])


def test_ngram_join_of_nothing(empty):
    assert ngramjoin.link(empty).isEmpty()


def around_threshold(k, seed):
    """One text with one to three words changed, families apart from it, and chains: many similarities lie around 0.85."""
    rng = random.Random(seed)
    base, rows = sentence(rng, 80).split(), []
    for i in range(k):
        t = list(base)
        for at in rng.sample(range(len(t)), rng.choice([1, 2, 3])):
            t[at] = rng.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(t[rng.choice([0, 0, 1, 3]):])))
    chain = sentence(rng, 90).split()
    for i in range(20):
        rows.append((5000 - i, " ".join(chain)))
        chain = chain[2:] + sentence(rng, 2).split()
    return rows


@pytest.mark.parametrize("block, picks", [(2048, 2), (16, 1)])
def test_ngram_join_around_the_threshold(spark, monkeypatch, block, picks):
    """Keys cut into parts, and fewer picked keys, so that the second round has more to do."""
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "PICKS", picks)
    monkeypatch.setattr(ngramjoin, "BROADCAST_IDS", ngramjoin.BROADCAST_IDS if picks == 2 else 0)
    rows = around_threshold(300, picks)
    assert join(spark.createDataFrame(rows, "doc_id bigint, text string")) == near(rows)


def test_tries_find_all_alike_sets():
    rng = random.Random(9)
    for trial in range(60):
        base = sorted(rng.sample(range(400), rng.choice([1, 5, 30, 60])))
        sets = {tuple(base)}
        for _ in range(rng.choice([1, 5, 40])):
            s = set(base)
            for _ in range(rng.randint(0, 6)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(400))
            sets.add(tuple(sorted(s))[:rng.choice([len(s), len(s), max(1, len(s) - 3)])])
        sets = sorted(sets)
        alike = lambda a, b: 185 * len(set(a) & set(b)) >= 85 * (len(a) + len(b))
        trie = ngramjoin.Trie([np.array(s) for s in sets])
        none = np.zeros(len(trie.first), dtype=bool)
        for s in sets:
            mark = np.zeros(400, dtype=bool)
            mark[list(s)] = True
            assert sorted(trie.alike(len(s), np.array(s), mark, none)) == [i for i, t in enumerate(sets) if alike(s, t)]
        # Links of a block of its own, and of one block against another.
        codes = [np.array(s, dtype=">u8").tobytes() for s in sets]
        n = len(sets)
        for side in (np.zeros(n, dtype=int), np.arange(n) % 2):
            pairs = [(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j]) and (not side.any() or side[i] != side[j])]
            found = ngramjoin.link_sets(np.arange(n), np.arange(n), codes, side)
            assert groups(n, found) == groups(n, pairs) and len(found) < n


def test_outlines_pass_over_no_alike_pair():
    rng = np.random.default_rng(12)
    for trial in range(40):
        base = rng.integers(0, 1 << 63, rng.choice([2, 30, 64, 200]), dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97])], rng.integers(0, 1 << 63, rng.integers(1, 20), dtype=np.uint64)]))
                for _ in range(12)] + [np.unique(rng.integers(0, 1 << 63, len(base), dtype=np.uint64)) for _ in range(6)]
        n, root = np.array([len(s) for s in sets]), rng.integers(0, 9, len(sets))
        outlines = [ngramjoin.outline(s) for s in sets]
        if trial % 4 == 0:
            outlines[3] = b""
        for side in (np.zeros(len(sets), dtype=int), np.arange(len(sets)) % 2):
            keep = ngramjoin.possible(side, root, n, outlines)
            for i, j in itertools.combinations(range(len(sets)), 2):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 185 * common >= 85 * (n[i] + n[j]) and root[i] != root[j] and (not side.any() or side[i] != side[j]):
                    assert keep[i] and keep[j]
            assert trial % 4 == 0 or len(base) < 200 or not keep[12:].any()


def groups(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return [root.index(r) for r in root]


def vector_rows():
    rng = random.Random(21)
    rows = [(i, [round(rng.gauss(0.2, 0.4), 3) for _ in range(7)], rng.choice([0, 1, 2, 9])) for i in range(450)]
    rows += [(1000 + i, list(rows[100][1]), i % 3) for i in range(30)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [1.0, math.nan], 1), (800, [math.inf], 1), (900, [0.5] * 7, None), (None, [0.5] * 7, 1),
             (2000, [], 1), (2001, [0.75], 2), (2100, [0.5] * 9, 2), (300, rows[300][1], rows[300][2]), (3, rows[3][1], rows[3][2]), (4, [0.3] * 7, 0)]
    return rows


def mined(rows):
    taken = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
             if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, la, va in taken:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in taken if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fit = [s for s in scored if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit)]
    return bag(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    """Also with many small cells and tiles, so that heaps merge."""
    if small:
        for name, value in (("ANCHORS", 2), ("CANDIDATES", 50)):
            monkeypatch.setattr(hardneg, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id bigint, embedding array<double>, label int, score int, anchor string")
    got = hardneg.mine(df)
    assert bag(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hardneg.mine(df).isEmpty()
    assert hardneg.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], df.schema)).isEmpty()


def test_strassen_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(hardneg, "LEAF", 2)
    for shape in [(1, 1, 1), (3, 5, 7), (16, 16, 16), (33, 18, 41), (0, 4, 3), (4, 0, 3)]:
        for most in (10, 1 << 20, 1 << 28):
            a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
            want = a.astype(object) @ b.astype(object) if all(shape) else np.zeros((shape[0], shape[2]))
            assert (hardneg.strassen(a, b) == want).all()
    a, b = rng.integers(-9, 9, (5, 2500)), rng.integers(-9, 9, (6, 2500))
    assert (hardneg.tile_scores(a, b) == a @ b.T).all()


def test_heaps_merge():
    rng = np.random.default_rng(8)
    score, ids = rng.integers(0, 20, 500), rng.permutation(500)
    heaps = hardneg.Heaps(10)
    for part in np.array_split(np.arange(500), 7):
        heaps.add("k", *hardneg.best(score[part], ids[part], 10))
    want = sorted(zip(-score, ids))[:10]
    assert list(zip(-heaps.held["k"][0], heaps.held["k"][1])) == want
