"""Toxicity and language ID: chain inference and parsing against brute force, held-out accuracy, odd inputs; the pipeline."""

import itertools

import numpy as np
import pytest
from conftest_rows import messy_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_brute as brute
import corpus_pipeline
from logwarden.llm import langid, mixing, toxicity
from logwarden.llm.textops import NON_WORD, SPACES, Hasher, Words

BIG = "/root/testdata/sf0.01"
ROWS, PASSAGE = messy_rows()


@pytest.mark.parametrize("n", [1, 2, 7])
def test_chain_marginals_by_enumeration(n):
    rng = np.random.default_rng(n)
    score, step = rng.normal(0, 2, n), np.exp(rng.normal(0, 1, (2, 2)))
    total, want = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(s for s, t in zip(score, tags) if t)) * np.prod([step[a, b] for a, b in zip((0, *tags), tags)])
        total += weight
        want += weight * np.array(tags)
    assert np.allclose(toxicity.chain_marginals(score, np.array([n]), step), want / total)


def test_chain_blocks_are_exact():
    """Texts longer than a block, empty ones between them: as one plain forward-backward per text."""
    rng = np.random.default_rng(0)
    counts, step = np.array([0, 5, 64, 65, 0, 300, 1, 0]), np.exp(rng.normal(0, 1, (2, 2)))
    score, at, want = rng.normal(0, 2, counts.sum()), 0, []
    for n in counts[counts > 0]:
        want.append(toxicity.forward_backward(np.exp(score[at:at + n])[None], np.ones((1, n), bool), step, np.array([[1.0, 0.0]]), np.ones((1, 2)))[0])
        at += n
    assert np.allclose(toxicity.chain_marginals(score, counts, step), np.concatenate(want))


@pytest.mark.parametrize("separators, plain", [(SPACES, brute.spaced), (NON_WORD, brute.letters)])
def test_words_match_plain_splitting(separators, plain):
    texts = [t or "" for _, t, *_ in ROWS]
    data = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), separators)
    spans = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends)]
    assert spans == [w for t in texts for w in plain(t)] and list(words.counts) == [len(plain(t)) for t in texts]
    (h,) = Hasher().spans(words.data, words.starts, words.ends)
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(spans, h)) and len(set(by_word.values())) == len(by_word)


def held(rows, labels):
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_held_out(spark):
    rows = entry.queries()["op1_toxicity"](spark, BIG).collect()
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (brute.crc_fold(r.doc_id) == 2) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    pairs = held(rows, labels)
    hits = sum(r.predicted and y for r, y in pairs)
    assert hits >= 0.6 * sum(y for _, y in pairs) and hits >= 0.9 * sum(r.predicted for r, _ in pairs)


def test_toxicity_spans_and_odd_inputs(spark, messy, empty):
    bad = [(i, f"plain words number {i} stand here" + (" you awful grublin, go" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, "Été! Grublin went awful grublin home", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (5, "nothing here", 1),
                                 (6, "calm " * 30_000 + "awful grublin", 1)], "doc_id bigint, text string, score int")
    got = {r.doc_id: r for r in odd.select("doc_id", "text", toxicity.toxicity(model, F.col("text")).alias("t")).collect()}
    assert got[1].t.score >= 0.3 > got[2].t.score == got[3].t.score == got[4].t.score and got[5].t.score < 0.3 <= got[6].t.score
    marked = [got[1].text[s.start:s.stop].lower() for s in got[1].t.spans]
    assert marked and all("grublin" in m or "awful" in m for m in marked) and got[6].text[got[6].t.spans[-1].start:].endswith("grublin")
    kept = toxicity.keep_clean(odd.unionByName(docs.withColumn("score", F.lit(1))), labels)
    assert kept.columns == odd.columns and kept.filter("text like '%grublin%'").isEmpty() and kept.filter("doc_id in (2, 3, 4)").count() >= 3
    assert toxicity.score(messy, labels.limit(0)).filter("score <> 0 or predicted <> 0").isEmpty()
    assert toxicity.score(empty, labels).isEmpty()
    sure = toxicity.score(docs, labels.filter("toxic = 1"))
    assert sure.filter("score <> 1").isEmpty()


def test_language_held_out(spark):
    rows = entry.queries()["op5_language_id"](spark, BIG).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    pairs = held(rows, langs)
    assert len(rows) == len(langs) and sum(r.lang_pred == y for r, y in pairs) >= 0.97 * len(pairs)
    assert all(0 <= r.score <= 1 for r in rows)


def test_phrases_by_plain_search():
    parser = langid.Parser({"xx": "the cat sat on the mat", "yy": "abba cddc"})
    assert parser.languages == ["xx", "yy"]
    texts = ["the cats mat", "abba", "zzz", "on the c", "a" * (langid.BLOCK + 3)]
    code = {c: i + 2 for i, c in enumerate(parser.alphabet)} | {" ": 1}
    symbols = np.array([code.get(c, 0) for t in texts for c in t])
    got = langid.parse(parser, symbols, np.array([len(t) for t in texts]))

    def plain(text, sample):
        phrases = 0
        for block in range(0, len(text), langid.BLOCK):
            phrase = None
            for c in text[block:block + langid.BLOCK]:
                c = c if c in code else "\0"
                if phrase is None or phrase + c not in sample:
                    phrases += 1
                    phrase = c if c in sample else ""
                else:
                    phrase += c
        return phrases

    for i, sample in enumerate(("the cat sat on the mat", "abba cddc")):
        want = [plain(t, sample) for t in texts]
        assert all(abs(a - b) <= 1 + len(t) // langid.BLOCK for a, b, t in zip(got[:, i], want, texts)), (got[:, i], want)


def test_language_odd_inputs(spark, messy, empty):
    got = langid.predict(messy)
    assert got.count() == len(ROWS)
    seen = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (21, "und"), (None, "und")} <= seen and (20, "und") not in seen
    assert langid.predict(empty).isEmpty()
    none = langid.predict(messy.withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("lang_pred <> 'und' or score <> 0").isEmpty()


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on what its predecessor kept: near copies, leaks, mixture and shards by plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{name}"
        out.write.mode("overwrite").parquet(path)
        seen.append((docs, spark.read.parquet(path)))
        docs = seen[-1][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(out.columns == columns for _, out in seen[:-1])
    start, kept = seen[0]
    flagged = {r.doc_id for r in toxicity.score(start, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids(kept) == sorted(set(ids(start)) - flagged)
    start, kept = seen[1]
    rows = [(r.doc_id, r.text) for r in start.collect()]
    assert ids(kept) == sorted(d for d, _, c in brute.near(rows) if d == c)
    start, kept = seen[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in start.collect()]
    assert ids(kept) == sorted(d for d, _, hit, _ in brute.leaks(rows, items) if not hit)
    start, kept = seen[3]
    taken = {r.doc_id: r.copies for r in mixing.mixture(start).collect()}
    assert ids(kept) == sorted(d for d, n in taken.items() for _ in range(n))
    start, kept = seen[4]
    assert ids(kept) == ids(start)
    per = [r["count"] for r in kept.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1


def test_transitions_laid_over_each_other():
    rng = np.random.default_rng(3)
    follow = [{int(c): int(rng.integers(300)) for c in rng.choice(40, rng.integers(0, 8), replace=False)} for _ in range(300)]
    place, comb = langid.overlaid(follow, 40)
    assert len(set(place.tolist())) == len(follow)
    for state, row in enumerate(follow):
        for c in range(40):
            owner, to = int(comb[place[state] + c]) >> 32, int(comb[place[state] + c]) & 0xFFFFFFFF
            assert (owner == place[state]) == (c in row)
            assert c not in row or to == place[row[c]]


def test_many_languages_keep_their_samples():
    """100 languages of 250 letters together: whole samples, a table that follows the sample, every text told apart."""
    rng = np.random.default_rng(4)
    words = {f"l{i:03d}": ["".join(chr(0x4E00 + (i * 97 + int(j)) % 2500) for j in rng.integers(0, 250, 3)) for _ in range(150)] for i in range(100)}
    sample = lambda k, n: " ".join(words[k][int(j)] for j in rng.integers(0, 150, n))
    texts = {k: sample(k, 400) for k in words}
    parser = langid.Parser(texts)
    assert parser.sizes == [len(texts[k]) for k in parser.languages] and len(parser.alphabet) > 2000
    assert parser.table.nbytes <= 40 * sum(parser.sizes) + 100 * 32 * len(parser.alphabet)
    code = {c: i + 2 for i, c in enumerate(parser.alphabet)} | {" ": 1}
    asked = [sample(k, 30) for k in parser.languages]
    symbols = np.array([code.get(c, 0) for t in asked for c in t], dtype=np.uint16)
    got = langid.parse(parser, symbols, np.array([len(t) for t in asked])) * parser.cost
    assert got.argmin(axis=1).tolist() == list(range(100))


@pytest.mark.parametrize("languages", [0, 1, 4, 100, 1000, 100_000, 5_000_000])
def test_language_shares_are_bounded(languages):
    pieces, piece = langid.shares(languages, langid.PIECES, langid.PIECE)
    assert 1 <= pieces <= langid.PIECES and 1 <= piece <= langid.PIECE
    assert languages * pieces * piece <= max(langid.MOST_CHARACTERS, languages)
    assert languages > 100 or (pieces, piece) == (langid.PIECES, langid.PIECE)


def test_a_common_start_hides_no_language(spark):
    start = "all texts begin with these same words that tell nothing about what follows " * 8
    words = {"aa": ["lomi", "tenu", "raka", "sipo", "munde"], "bb": ["krzt", "vlach", "dobry", "strc", "prst"]}
    rows = [(i, start + " ".join(words[k][(i * 7 + j * j) % 5] for j in range(120)), k) for i in range(400) for k in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs).collect()}
    assert all(got[i] == k for i, _, k in rows)
