"""The corpus operators with exact contracts against plain Python and SQL, on tables with every odd case."""

import collections

import pytest
from compare import compare, connect
from conftest_rows import messy_rows, sentence
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_brute as brute
from logwarden.llm import decontam, exactdedup, linededup, mixing, neardup, sharding, textops, tokencounts, urlfilter

ROWS, PASSAGE = messy_rows()
PAIRS = [(r[0], r[1]) for r in ROWS]
ORACLES = [n for n in entry.oracle_sql() if n.startswith("op")]


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(name, spark, sf):
    assert compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_near_duplicates(messy):
    got = neardup.link(messy)
    assert bag(got.select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.near(PAIRS))
    assert got.filter("kept <> coalesce(doc_id = component_id, true)").isEmpty()


def test_near_duplicates_lose_no_link_behind_a_star(spark):
    """Classes that are unlike their bucket's centre but like each other: a chain and two families around one text."""
    import random

    rng = random.Random(3)
    base = sentence(rng, 60).split()
    rows = []
    for family in range(6):
        own = base[:34] + sentence(rng, 26).split()
        for k in range(6):
            t = list(own)
            t[36 + 3 * k] = f"x{family}{k}"
            rows.append((family + 6 * k, " ".join(t)))
    chain = sentence(rng, 90).split()
    for k in range(12):
        rows.append((500 - k, " ".join(chain)))
        chain = chain[2:] + sentence(rng, 2).split()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert bag(neardup.link(df).select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.near(rows))


def test_keep_one(messy):
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    want = {(d, t) for (d, t), (_, _, c) in zip(PAIRS, brute.near(PAIRS)) if d is None or d == c}
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == {k: 1 for k in want if k[0] is not None}
    assert kept.filter("doc_id is null").count() == 2


def test_keep_one_judges_rows_of_a_repeated_id_by_their_text(spark):
    """Id 5 has a copy of id 1 and a text of its own, which stands for id 6."""
    import random

    rng = random.Random(11)
    shared, own, other = (sentence(rng, 40) for _ in range(3))
    rows = [(1, shared), (5, shared + " end"), (5, own), (5, own), (6, own + " end"), (7, other), (None, shared)]
    kept = neardup.keep_one(spark.createDataFrame([(t, d) for d, t in rows], "text string, doc_id bigint"))
    assert kept.columns == ["text", "doc_id"]
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag([(1, shared), (5, own), (7, other), (None, shared)])


def short_pairs(bins):
    """Pairs of texts of 7 and 8 words, alike by 3 of 4 shingles, and how many of their minima agree."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(bins)
    long = [sentence(rng, 8) for _ in range(3000)]
    order, hasher = neardup.probe_order(bins), textops.Hasher()
    place, low = neardup.places_in(order), []
    for texts in ([t.rsplit(" ", 1)[0] for t in long], long):
        column = pa.array([t.encode() for t in texts], pa.binary())
        parts = [neardup.shingle_sets(data, bounds, hasher) for _, _, data, bounds in textops.chunks(column)]
        low.append(np.concatenate([neardup.minima(*p, order, place) for p in parts]))
    return [(t.rsplit(" ", 1)[0], t) for t in long], [m & np.uint64(15 if bins == neardup.BINS else 255) for m in low]


def test_near_duplicates_of_headline_size(spark):
    pairs, (x, y) = short_pairs(neardup.BINS)
    far = [p for p, n in zip(pairs, (x == y).sum(axis=1)) if n < neardup.LEAST_AGREEMENT]
    assert far
    rows = [(2 * i + k, t) for i, p in enumerate(far) for k, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert bag(neardup.link(df).select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.near(rows))


def test_outsiders_of_headline_size(spark):
    """Both texts of each pair lie around one centre that is unlike them."""
    # Pairs that 1024 bins, read as five deviations below 0.75, would lose.
    pairs, (x, y) = short_pairs(1024)
    far = [p for p, n in zip(pairs, (x == y).sum(axis=1)) if n < 700]
    assert far
    docs = spark.createDataFrame([(0, "a text that is like no other one")] + [(2 * i + k + 1, t) for i, p in enumerate(far) for k, t in enumerate(p)],
                                 "doc_id bigint, text string")
    classes = neardup.signatures(docs).select(F.col("d1").alias("cid"), "d2", "n", F.col("doc_id").alias("rep"), "bits").cache()
    ids = {r.rep: r.cid for r in classes.collect()}
    spokes = spark.createDataFrame([(c, ids[0]) for d, c in ids.items() if d], "a bigint, b bigint")
    got = neardup.around_centres(spokes, classes.select("cid", F.col("cid").alias("root")), classes, docs)
    assert bag(got.collect()) == bag((max(p), min(p)) for p in ((ids[2 * i + 1], ids[2 * i + 2]) for i in range(len(far))))


def around_threshold(k):
    """Texts of 60 words, one or two of them changed: similarities lie around 0.75, so many are unlike the smallest id."""
    import random

    rng = random.Random(k)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(k):
        t = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2])):
            t[at] = f"x{i}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("k", [1000, 2000, 4000])
def test_pairs_around_a_centre_grow_with_its_classes(spark, monkeypatch, k):
    """What leaves the blocks is a spanning forest: never more links than classes."""
    seen, links = [], neardup.around_centres
    monkeypatch.setattr(neardup, "around_centres", lambda *a: seen.append(links(*a)) or seen[-1])
    rows = around_threshold(k)
    got = neardup.link(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert seen[0].count() < 2 * k
    if k == 1000:
        assert bag(got) == bag(brute.near(rows))


def test_keep_one_leaves_columns_of_the_caller(spark):
    rows = [(1, "a b c d e f", "keepme", 7), (2, "a b c d e f", "gone", 8)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, _mark string, _id int"))
    assert kept.columns == ["doc_id", "text", "_mark", "_id"] and bag(kept.collect()) == bag(rows[:1])


def test_probe_order_and_densification():
    import numpy as np

    order = neardup.probe_order()
    assert (np.sort(order, axis=1) == np.arange(neardup.BINS)).all()
    sets = np.sort(textops.mix(np.arange(9, dtype=np.uint64)))
    place = neardup.places_in(order)
    low = neardup.minima(sets, np.array([9, 0]), order, place)
    assert set(low[0]) <= set(sets) and len(set(low[0])) > 4 and (low[1] == 0).all()
    # Both ways of filling empty bins take the first filled bin of the probe order.
    many = np.sort(textops.mix(np.arange(100, dtype=np.uint64)))
    for made in (sets, many):
        got, bins = neardup.minima(made, np.array([len(made)]), order, place)[0], (made >> np.uint64(57)).astype(int)
        first = {b: v for b, v in zip(bins[::-1], made[::-1])}
        assert all(got[b] == first[b if b in first else next(p for p in order[b] if p in first)] for b in range(neardup.BINS))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (203, 202), (202, 201)]
    got = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).distinct().collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 201: 201, 202: 201, 203: 201}


def test_mixing(messy):
    got = mixing.mixture(messy)
    assert got.count() == len(ROWS)
    per = collections.defaultdict(int)
    words = [(r[0], r[3], len(brute.spaced(r[1]))) for r in ROWS]
    for _, source, n in words:
        per[source] += n
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(per.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * per[s] <= weight[s] * level}
        target |= {s: 2.0 * per[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    rows = mixing.mix_documents(messy).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert bag((r.doc_id, r.source, r["size"]) for r in rows) == bag(words)
    taken = collections.defaultdict(int)
    for r in rows:
        assert r.source_size == per[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    biggest = collections.defaultdict(int)
    for (doc, source, n) in words:
        biggest[source] = max(biggest[source], sum(m for d, s, m in words if s == source and d == doc))
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    assert mixing.draw(messy).columns == messy.columns
    assert mixing.draw(messy).count() == sum(r.taken // r["size"] if r["size"] else 0 for r in rows) + got.filter("size = 0").agg(F.sum("copies")).first()[0]


def test_exact_duplicates(messy):
    got = exactdedup.resolve(messy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert bag(got) == bag(brute.exact(PAIRS))


def test_cuckoo_filter_inserts_deletes_and_grows():
    import hashlib

    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    index = exactdedup.CuckooFilter.of(names[:2000], 64)
    assert index.slots > 64 and all(n in index for n in names[:2000])
    for n in names[:1000]:
        index.remove(n)
    assert all(n in index for n in names[1000:2000]) and sum(n in index for n in names[:1000]) < 5


def test_index_of_live_digests(messy, spark):
    rows = exactdedup.digests(messy)
    index = exactdedup.LiveIndex(spark, buckets=8)
    assert index.lookup(rows).isEmpty() and index.content().isEmpty()
    index.apply(exactdedup.summed(rows, True))
    copies = rows.filter("doc_id between 200 and 238")
    index.apply(exactdedup.summed(copies, False))
    one = rows.filter("doc_id = 239").first().digest
    entry_ = index.content().filter(F.col("digest") == one).first()
    assert entry_.live == 1 and entry_.best_id is None
    assert index.lookup(rows).count() == rows.select("digest").distinct().count()
    index.apply(exactdedup.summed(rows.filter("doc_id = 239"), False))
    gone = index.lookup(rows)
    assert gone.filter(F.col("digest") == one).isEmpty() and gone.count() == rows.select("digest").distinct().count() - 1
    before = index.content().count()
    index.apply(exactdedup.summed(rows.limit(0), True))
    assert index.content().count() == before


def digest_rows(spark, start, stop):
    return spark.range(start, stop).select(F.col("id").alias("doc_id"), F.lit(5).cast("bigint").alias("length"),
                                           F.sha2(F.col("id").cast("string"), 256).alias("digest"))


def test_a_batch_rewrites_only_buckets_with_hits(spark):
    index = exactdedup.LiveIndex(spark, buckets=4)
    index.apply(exactdedup.summed(digest_rows(spark, 0, 400), True))
    first = index.commits.load()[1]
    fresh = digest_rows(spark, 1000, 1400)
    bucket = lambda rows: rows.withColumn("b", exactdedup.bucket_of(F.col("digest"), 4))
    # New digests of one bucket: appended to it, unless the filter hits by chance; the other buckets keep their files.
    few = bucket(fresh).filter("b = 2").limit(5).drop("b")
    few = spark.createDataFrame(few.collect(), few.schema)
    assert index.apply(exactdedup.summed(few, True), writer="w", batch=1)
    second = index.commits.load()[1]
    assert all(second[k][b] == first[k][b] for k in ("content", "filters") for b in "013")
    assert second["content"]["2"][0] == first["content"]["2"][0] and len(second["content"]["2"]) == 2
    assert index.content().count() == 405 and index.content().filter("live <> 1").isEmpty()
    # Known digests: the bucket is read, verified and written whole.
    assert index.apply(exactdedup.summed(few, True), writer="w", batch=2)
    third = index.commits.load()[1]
    assert len(third["content"]["2"]) == 1 and all(third["content"][b] == first["content"][b] for b in "013")
    assert index.content().count() == 405 and index.content().filter("live = 2").count() == 5
    # A repeated batch changes nothing; a deletion takes both copies away.
    assert not index.apply(exactdedup.summed(few, True), writer="w", batch=2) and index.commits.load()[1] == third
    index.apply(exactdedup.summed(few.union(few), False))
    assert index.content().count() == 400 and index.lookup(few).isEmpty()
    index.vacuum()
    assert index.lookup(digest_rows(spark, 0, 400)).count() == 400


def test_filters_and_buckets_grow(spark, monkeypatch):
    index = exactdedup.LiveIndex(spark, buckets=2)
    for i in range(3):
        index.apply(exactdedup.summed(digest_rows(spark, i * 1000, i * 1000 + 1000), True))
    assert index.lookup(digest_rows(spark, 0, 3500)).count() == 3000 and index.commits.load()[1]["buckets"] == 2
    monkeypatch.setattr(exactdedup, "BUCKET_DIGESTS", 20)
    index.apply(exactdedup.summed(digest_rows(spark, 0, 1), True))
    assert not index.split()
    assert index.commits.load()[1]["buckets"] == 256
    assert max(r["count"] for r in index.content().groupBy("bucket").count().collect()) <= 40
    assert index.lookup(digest_rows(spark, 0, 3500)).count() == 3000
    index.apply(exactdedup.summed(digest_rows(spark, 0, 1000).union(digest_rows(spark, 0, 1)), False))
    assert index.content().count() == 2000 and index.lookup(digest_rows(spark, 0, 3500)).count() == 2000


def test_a_filter_that_overflows_is_built_from_stored_digests(spark, monkeypatch):
    index = exactdedup.LiveIndex(spark, buckets=1)
    index.apply(exactdedup.summed(digest_rows(spark, 0, 200), True))
    # Nothing foresees the overflow: the write finds it and is repeated with the bucket's content.
    monkeypatch.setattr(exactdedup.LiveIndex, "_asked", lambda self, state, placed, touched, hits_only: placed.limit(0))
    index.apply(exactdedup.summed(digest_rows(spark, 200, 1500), True))
    monkeypatch.undo()
    assert index.content().count() == 1500 and index.lookup(digest_rows(spark, 0, 2000)).count() == 1500
    assert len(index.commits.load()[1]["content"]["0"]) == 1


URLS = [(1, "http://a.example.net/en/1"), (1, "http://a.example.net/en/1"), (2, None), (3, ""), (4, "no scheme"), (5, "x://net"), (6, "x://net/"),
        (7, "x://NET/?q"), (8, "https://www.Example.COM/de/x?y#z"), (9, "https://notexample.com/de/x"), (10, "a://b.org/fr/1"), (11, "a://org/fr"),
        (12, "a://example.net/en"), (13, "a://u@example.net:80/en/"), (14, "a://x.net?/en/://b.org/fr/"), (15, "://.net/"), (16, "a\nb://c.org/fr/\n"),
        (None, "http://example.com/de/"), (17, "a://evil.example.com.net/de/"), (18, "a://example.net/en/" + "p/" * 3000), (19, "a://net#x")]


@pytest.mark.parametrize("most", [urlfilter.BROADCAST_RULES, 0])
def test_url_rules(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", most)
    pages = spark.createDataFrame([(*u, "r", 1) for u in URLS], "page_id bigint, url string, rule string, length int")
    for rules in (urlfilter.RULES, [*urlfilter.RULES, ("block", "b.org", "/fr/(1"), ("allow", "c.org", "/f")]):
        got = urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()
        assert bag(got) == bag(brute.urls(URLS, rules))
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).isEmpty()


def test_rules_without_a_host_are_refused(spark):
    for host in ("", "a..b", ".net"):
        with pytest.raises(ValueError):
            urlfilter.rule_table(spark, [("block", host, "/x/")])


def test_rollup_survives_a_lost_commit_and_stays_small(spark, monkeypatch):
    from logwarden.sources.tables import Commits

    roll = tokencounts.Rollup(spark, fanout=4)
    one = spark.createDataFrame([("s", "en", "v1", 5, 1)], "source string, lang string, version string, tokens bigint, sign int").coalesce(1)
    roll.commit("feed", one)
    publish = Commits.publish
    monkeypatch.setattr(Commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        roll.commit("feed", one, 1)
    monkeypatch.setattr(Commits, "publish", publish)
    assert bag(roll.totals().collect()) == [("s", "en", "v1", 1, 5)]
    for n in range(1, 100):
        assert roll.commit("feed", one, n)
        assert len(roll.log.parts()) <= 16
    assert not roll.commit("feed", one, 99) and bag(roll.totals().collect()) == [("s", "en", "v1", 100, 500)]


def test_sharding(messy):
    got = sharding.plan(messy, 7).collect()
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in got) == bag(brute.sizes(PAIRS))
    per = collections.Counter(r.shard for r in got)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    assert bag((r.shard, r.slot) for r in got) == bag((s, i) for s in per for i in range(per[s]))
    whole = sharding.assign(messy, 7)
    assert whole.columns == [c for c in messy.columns if c != "shard"] + ["shard", "slot"]
    sources = collections.Counter(r[3] for r in ROWS)
    mix = collections.Counter((r.source, r.shard) for r in whole.collect())
    assert all(abs(mix[s, k] - n / 7) <= 1.5 for s, n in sources.items() for k in range(7))


def test_near_matches(spark):
    """Passages with words put in, left out, or replaced by one that no other text has."""
    import random

    rng = random.Random(17)
    item = sentence(rng, 14).split()
    rows = [(1, " ".join(item)), (2, " ".join(item[:6] + ["zzz", "yyy"] + item[6:])), (3, " ".join(item[:5] + item[6:])),
            (4, " ".join(item[:4] + ["onlyhere"] + item[5:])), (5, sentence(rng, 300)), (None, " ".join(item[3:])), (6, None),
            (7, " ".join([item[0]] * 40 + [item[1]] * 40))]
    items = [(1, " ".join(item)), (2, " ".join(item[:4] + ["nowhere"] + item[5:])), (3, "nowhere at all"), (4, f"{item[0]} {item[1]}"), (5, item[2])]
    got = decontam.near_matches(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = brute.near_leaks(rows, items)
    assert {tuple(r) for r in got.collect()} == want and {2, 4} <= {w[1] for w in want} and len(want) > 40


def test_many_small_sources_share_no_bucket(spark, monkeypatch):
    """20,000 sources of one row, 3,000 of two and a large one: no bucket of the last ranking exceeds its bound by much."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1000)
    monkeypatch.setattr(sharding, "LEAST_BUCKETS", 16)
    rows = [(i, f"one{i}") for i in range(20_000)] + [(30_000 + i, f"two{i // 2}") for i in range(6_000)] + [(40_000 + i, None) for i in range(4_000)]
    seen, ranked = [], sharding.ranked
    monkeypatch.setattr(sharding, "ranked", lambda df, groups, bucket, *a: seen.append(
        df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]) or ranked(df, groups, bucket, *a))
    docs = spark.createDataFrame([(d, "t", s) for d, s in rows], "doc_id bigint, text string, source string").repartition(4)
    got = sharding.plan(docs, 7).collect()
    assert seen[1] < 3 * 1000
    key = {r[0]: r[1] for r in docs.select("doc_id", sharding.shuffle_key(F.col("doc_id"))).collect()}
    by, place = collections.defaultdict(list), []
    for d, s in rows:
        by[s].append((key[d], d))
    for s, members in by.items():
        place += [((2 * k + 1) / (2 * len(members)), s is None, s or "", *m) for k, m in enumerate(sorted(members))]
    want = {p[-1]: i * 7 // len(rows) for i, p in enumerate(sorted(place))}
    assert {r.doc_id: r.shard for r in got} == want and bag((r.shard, r.slot) for r in got) == bag(
        (s, i) for s, n in collections.Counter(want.values()).items() for i in range(n))


def test_decontamination(messy, spark):
    items = [(1, PASSAGE), (2, "one copy"), (3, ""), (4, None), (None, "a b"), (5, "never there at all in any of these texts whatever"),
             (6, PASSAGE.upper() + "."), (7, "one copy that a third of all rows share with each other")]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id bigint, text string, window string")
    want = []
    for (doc, n, hit, names), (_, text) in zip(brute.leaks(PAIRS, items), PAIRS):
        want.append((doc, n, hit, [x for x in names if x != "None"]))
    got = decontam.report(messy, bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == bag(want)
    kept = decontam.clean(messy, bench)
    assert kept.columns == messy.columns
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag(p for p, w in zip(PAIRS, want) if not w[2])


def test_proximity_matches(spark):
    w = [f"w{i}" for i in range(10)]
    text = lambda ws: " ".join(ws)
    docs = spark.createDataFrame([(1, text(w)), (2, text(w[:5] + ["gap"] + w[5:])), (3, text(w[:5] + ["gap"] * 9 + w[5:])), (4, text(reversed(w)))],
                                 "doc_id bigint, text string")
    got = decontam.report(docs, spark.createDataFrame([(1, text(w))], "item_id bigint, text string"))
    found = {r.doc_id: (r.n_hit, r.n_near) for r in got.collect()}
    assert found[1] == (10, 0) and all(found[d][0] == 0 for d in (2, 3, 4)) and found[3][1] <= found[2][1]


def test_decontamination_beyond_the_broadcast_bound(messy, spark, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    small = messy.filter("doc_id between 11 and 21")
    want = bag(decontam.report(small, bench).select("doc_id", "n_hit").collect())
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(decontam, "BROADCAST_DOCS", 0)
    assert bag(decontam.report(small, bench).select("doc_id", "n_hit").collect()) == want and sum(r[1] for r in want) == 90


def test_line_dedup(messy):
    out = linededup.apply_bitmaps(messy, linededup.bitmaps(messy)).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert bag(out) == bag(brute.lines(PAIRS))


def test_token_rollup(spark, messy):
    roll = tokencounts.Rollup(spark)
    frame = lambda *r: spark.createDataFrame(r, "source string, lang string, version string, tokens bigint, sign int, extra int")
    a = frame(("s", "en", "v1", 5, 1, 0), ("s", "en", "v1", None, 1, 0), (None, None, "v1", 7, 1, 0), ("s", "en", "v1", 9, None, 0))
    roll.commit("a", a)
    roll.commit("a", a)
    assert bag(roll.totals().collect()) == bag([("s", "en", "v1", 2, 5), (None, None, "v1", 1, 7)])
    roll.commit("b", frame((None, None, "v1", 7, -1, 0), ("s", "en", "v1", 5, -1, 0), ("s", "en", "v1", 8, 1, 0)))
    roll.commit("c", a.limit(0))
    assert bag(roll.totals().collect()) == bag([("s", "en", "v1", 2, 8)])
    assert bag(tokencounts.Rollup(spark, roll.path).totals().collect()) == bag([("s", "en", "v1", 2, 8)])
    plain = tokencounts.maintain(messy, tokencounts.Rollup(spark)).filter("version = 'spaces-1'").agg(F.sum("documents")).first()[0]
    texts, live = {}, 0
    for doc, text in PAIRS:
        if doc is not None:
            texts[text or ""] = min(doc, texts.get(text or "", doc))
    for doc, text in PAIRS:
        live += doc is None or texts[text or ""] >= doc
    assert plain == live


def test_bpe_counter(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(tokencounts.bpe_counter(F.col("text"), public.path("byte_bpe_50k.json"))).collect()]
    assert got == [2, 0, 0]


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    none = bench.limit(0)
    assert neardup.link(empty).isEmpty() and neardup.keep_one(empty).isEmpty()
    assert mixing.mixture(empty).isEmpty() and mixing.draw(empty).isEmpty()
    assert exactdedup.resolve(empty).isEmpty()
    assert sharding.plan(empty).isEmpty() and sharding.assign(empty).isEmpty()
    assert decontam.report(empty, bench).isEmpty() and decontam.clean(empty, none).isEmpty()
    assert linededup.apply_bitmaps(empty, linededup.bitmaps(empty)).isEmpty()
    assert tokencounts.maintain(empty, tokencounts.Rollup(spark)).isEmpty()


def test_empty_benchmark_leaves_all(messy, spark):
    assert decontam.clean(messy, spark.createDataFrame([], "item_id bigint, text string")).count() == len(ROWS)
