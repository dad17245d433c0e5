"""Toxic spans by a linear-chain conditional random field; marginals give document scores and offending offsets.

Fit. Labels are per document, so tokens are labelled first: over a sample of labelled documents, words and five-byte word
beginnings are counted once per document and class; those tied to the toxic class by a likelihood ratio above
``MIN_RATIO`` form the lexicon, and its words inside toxic documents are the toxic tokens. Windows around listed words
of both classes and windows of clean documents train a two-tag chain (weights per word, beginning and transition) by AdaGrad on the exact
gradient from forward-backward. Last, a logistic curve maps what the marginals add up to in a document (largest marginal,
expected toxic tokens, their share) to the probability of label 1.

Bounds, all parameters of ``fit``: about ``max_documents`` labelled documents, ``max_windows`` windows of 32 tokens and
``max_lexicon`` lexicon entries. Scoring covers every token of every text.

Edge cases: labels without an id or class are ignored, conflicting ones count as toxic; without training rows every score
is 0; with one class only, the score is that class's share; null, empty and wordless texts get the score of a text without
toxic tokens; extra columns are passed through; rows are scored on their own, so repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.textops import ARROW_ROWS, NON_WORD, ODD, U64, Hasher, Words, chunks, fold, lists, map_texts
from logwarden.session import written

PREFIX, WINDOW, BLOCK = 5, 32, 64
MIN_RATIO, MIN_DOCS = 24.0, 3
REJECT_AT = 0.3
SCORE_TYPE = "struct<score:double,toxic_words:double,spans:array<struct<start:int,stop:int,probability:double>>>"


def token_features(words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word and of its first five bytes (for longer words; else 0)."""
    word, start = hasher.spans(words.data, words.starts, words.ends, np.minimum(words.ends, words.starts + PREFIX))
    return word, np.where(words.ends - words.starts > PREFIX, start ^ ODD[3], U64(0))


def forward_backward(emit: np.ndarray, real: np.ndarray, step: np.ndarray, enter: np.ndarray, leave: np.ndarray, pairs=False):
    """Marginals of tag 1 for rows of tokens, given the messages entering and leaving each row (and expected tag pairs)."""
    rows, width = emit.shape
    alpha = np.zeros((width + 1, rows, 2))
    alpha[0] = enter
    for t in range(width):
        a = alpha[t] @ step
        a[:, 1] *= emit[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t + 1] = np.where(real[:, t, None], a, alpha[t])
    out, beta, both = np.zeros((rows, width)), leave.copy(), np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        p = alpha[t + 1] * beta
        out[:, t] = p[:, 1] / p.sum(axis=1)
        b = beta.copy()
        b[:, 1] *= emit[:, t]
        if pairs:
            xi = alpha[t][:, :, None] * step * b[:, None, :]
            xi /= xi.sum(axis=(1, 2), keepdims=True)
            both += xi[real[:, t]].sum(axis=0)
        b = b @ step.T
        b /= b.sum(axis=1, keepdims=True)
        beta = np.where(real[:, t, None], b, beta)
    return (out, both) if pairs else out


def chain_marginals(score: np.ndarray, counts: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(tag 1) of every token of consecutive texts. Texts are cut into blocks; block products carry the messages exactly."""
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    out = np.zeros(len(score))
    if not total:
        return out
    text = np.repeat(np.arange(len(counts)), blocks)
    index = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(counts) - counts)[text] + index * BLOCK
    size = np.minimum(BLOCK, counts[text] - index * BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    at = np.minimum(begin[:, None] + np.arange(BLOCK), len(score) - 1)
    emit = np.where(real, np.exp(np.clip(score, -30, 30))[at], 1.0)
    enter, leave = np.tile([1.0, 0.0], (total, 1)), np.ones((total, 2))
    if blocks.max() > 1:
        product = np.tile(np.eye(2), (total, 1, 1))
        for t in range(BLOCK):
            p = product @ step
            p[:, :, 1] *= emit[:, t, None]
            p /= p.sum(axis=(1, 2), keepdims=True)
            product = np.where(real[:, t, None, None], p, product)
        for k in range(1, int(blocks.max())):
            here = np.flatnonzero(index == k)
            e = np.einsum("ri,rij->rj", enter[here - 1], product[here - 1])
            enter[here] = e / e.sum(axis=1, keepdims=True)
        for k in range(int(blocks.max()) - 1, 0, -1):
            here = np.flatnonzero(index == k)
            b = np.einsum("rij,rj->ri", product[here], leave[here])
            leave[here - 1] = b / b.sum(axis=1, keepdims=True)
    p = forward_backward(emit, real, step, enter, leave)
    out[at[real]] = p[real]
    return out


@dataclass
class Model:
    """Known token features (sorted) and their weights, the transition weights, and the document curve."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U64))
    word_weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U64))
    start_weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -5.0
    step: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-np.inf, 0.0, 0.0, 0.0, 0.0]))

    def emissions(self, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.bias + self.word_weights[slot(self.words, word)] + self.start_weights[slot(self.starts, start)]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ self.curve[1:] if np.isfinite(self.curve[0]) else np.full(len(features), self.curve[0])
        return 1 / (1 + np.exp(-z))


def slot(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted array, or its length where the value is unknown."""
    if not len(known):
        return np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: largest marginal and its fourth power, logs of the expected toxic words and of their rate per thousand words."""
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected, counts = np.maximum(total[first[1:]] - total[first[:-1]], 0), np.diff(first)
    top = np.zeros(len(counts))
    if len(p):
        some = counts > 0
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.stack([top, top ** 4, np.log1p(expected), np.log1p(1000 * expected / (counts + 20))], axis=1)


def analyse(model: Model, data: np.ndarray, bounds: np.ndarray, hasher: Hasher) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(data, bounds, NON_WORD)
    p = chain_marginals(model.emissions(*token_features(words, hasher)), words.counts, model.step)
    return words, p, document_features(p, words.first)


def toxicity(model: Model, text: Column) -> Column:
    """Struct of score, expected toxic words and offending spans (code point offsets) of a text column."""

    @F.arrow_udf(SCORE_TYPE)
    def run(column: pa.Array) -> pa.Array:
        hasher, scores, expected, counts, spans = Hasher(), [], [], [], []
        for _, _, data, bounds in chunks(column):
            words, p, features = analyse(model, data, bounds, hasher)
            scores.append(model.score(features))
            expected.append(np.expm1(features[:, 2]))
            hit = np.flatnonzero(p >= 0.5)
            text_of = np.searchsorted(words.first, hit, side="right") - 1
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = (np.diff(hit) > 1) | (np.diff(text_of) > 0)
            opens = np.flatnonzero(fresh)
            closes = np.append(opens[1:], len(hit))[:len(opens)] - 1
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[bounds[text_of[opens]]]
            best = np.maximum.reduceat(p[hit], opens) if len(opens) else np.zeros(0)
            spans.append((points[words.starts[hit[opens]]] - base, points[words.ends[hit[closes]]] - base, best))
            counts.append(np.bincount(text_of[opens], minlength=len(bounds) - 1))
        if not counts:
            return pa.array([], type=pa.struct([("score", pa.float64()), ("toxic_words", pa.float64()), ("spans", pa.list_(
                pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())])))]))
        a, b, best = (np.concatenate(x) for x in zip(*spans))
        items = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(best, pa.float64())],
                                           names=["start", "stop", "probability"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(np.concatenate(expected)),
                                           pa.ListArray.from_arrays(offsets, items)], names=["score", "toxic_words", "spans"])

    return run(text.cast("binary"))


def evidence(sample: DataFrame) -> DataFrame:
    """(feature, toxic documents, clean documents) over the sample: words and beginnings, once per document."""

    def make():
        hasher = Hasher()

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(0)):
                words = Words(data, bounds, NON_WORD)
                text = np.repeat(np.arange(to - at), words.counts).astype(U64)
                label = np.asarray(batch.column(1))[at:to]
                found = []
                for f in token_features(words, hasher):
                    pairs = np.unique(np.stack([f, text], axis=1)[f > 0], axis=0) if len(f) else np.zeros((0, 2), dtype=U64)
                    found.append(np.stack([pairs[:, 0], label[pairs[:, 1].astype(np.int64)].astype(U64)], axis=1))
                all_found = np.concatenate(found)
                feature, at_feature = np.unique(all_found[:, 0], return_inverse=True)
                toxic = np.bincount(at_feature, weights=all_found[:, 1].astype(float), minlength=len(feature)).astype(np.int64)
                both = np.bincount(at_feature, minlength=len(feature))
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(toxic), pa.array(both - toxic)],
                                                 names=["feature", "toxic", "clean"])

        return step

    return map_texts(sample.select("bytes", "label"), make, "feature bigint, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training_windows(sample: DataFrame, lexicon: np.ndarray, share: float, most: int) -> list:
    """Windows of tokens as (word hashes, beginning hashes, tags): around the first listed tokens of every
    document (tagged toxic only in toxic ones), and one anywhere in each drawn clean document."""

    def make():
        hasher = Hasher()

        def step(batch):
            rows = {"draw": [], "word": [], "start": [], "tag": []}
            for at, to, data, bounds in chunks(batch.column(0)):
                words = Words(data, bounds, NON_WORD)
                word, start = token_features(words, hasher)
                listed = (slot(lexicon, word) < len(lexicon)) | (slot(lexicon, start) < len(lexicon))
                for i in range(to - at):
                    a, b = words.first[i], words.first[i + 1]
                    draw = batch.column(2)[at + i].as_py()
                    if b == a:
                        continue
                    centres = np.flatnonzero(listed[a:b])[:8]
                    windows = {max(0, int(c) - WINDOW // 2) for c in centres}
                    if draw < share and not batch.column(1)[at + i].as_py():
                        windows.add(int(draw * (1 << 30)) % max(1, b - a - WINDOW + 1))
                    for w in sorted(windows):
                        x, y = a + w, min(b, a + w + WINDOW)
                        rows["draw"].append(draw)
                        rows["word"].append(word[x:y].view(np.int64))
                        rows["start"].append(start[x:y].view(np.int64))
                        rows["tag"].append((listed[x:y] & bool(batch.column(1)[at + i].as_py())).astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["draw"], pa.float64()), *[pa.array(rows[k], pa.list_(pa.int64())) for k in ("word", "start")],
                 pa.array(rows["tag"], pa.list_(pa.int8()))], names=["draw", "word", "start", "tag"])

        return step

    found = map_texts(sample.select("bytes", "label", "draw"), make,
                      "draw double, word array<bigint>, start array<bigint>, tag array<tinyint>")
    return found.orderBy("draw", F.hash("word")).limit(most).collect()


def train_chain(windows: list, steps: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Exact-gradient AdaGrad on the conditional likelihood of the windows."""
    size = np.array([len(w["tag"]) for w in windows])
    real = np.arange(WINDOW) < size[:, None]
    pad = lambda k, kind: np.array([list(w[k]) + [0] * (WINDOW - len(w[k])) for w in windows], dtype=kind)
    word, start, tag = pad("word", np.int64).view(U64), pad("start", np.int64).view(U64), pad("tag", np.int8).astype(float)
    known = []
    for f in (word, start):
        values, counts = np.unique(f[real], return_counts=True)
        known.append(values[(counts >= 2) & (values > 0)])
    at = [slot(k, f.ravel()).reshape(f.shape) for k, f in zip(known, (word, start))]
    weights, moving = [np.zeros(len(k) + 1) for k in known], np.zeros((2, 2))
    bias = np.log(max(tag[real].sum(), 1) / max(real.sum(), 1))
    seen = [np.full(len(w), 1e-6) for w in weights]
    seen_bias, seen_moving = 1e-6, np.full((2, 2), 1e-6)
    before = np.concatenate([np.zeros((len(tag), 1)), tag[:, :-1]], axis=1)
    counted = np.array([[((before == i) & (tag == j) & real).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    enter, leave = np.tile([1.0, 0.0], (len(tag), 1)), np.ones((len(tag), 2))
    for _ in range(steps):
        score = bias + weights[0][at[0]] + weights[1][at[1]]
        p, pairs = forward_backward(np.exp(np.clip(score, -30, 30)), real, np.exp(moving), enter, leave, pairs=True)
        slope = np.where(real, tag - p, 0.0)
        for i in (0, 1):
            g = np.bincount(at[i].ravel(), weights=slope.ravel(), minlength=len(weights[i])) - decay * len(tag) * weights[i]
            g[-1] = 0.0
            seen[i] += g * g
            weights[i] += rate * g / np.sqrt(seen[i])
        g = slope.sum()
        seen_bias += g * g
        bias += rate * g / np.sqrt(seen_bias)
        g = counted - pairs - decay * len(tag) * moving
        seen_moving += g * g
        moving += rate * g / np.sqrt(seen_moving)
        moving = np.clip(moving, -4, 4)
    return Model(known[0], weights[0], known[1], weights[1], float(bias), np.exp(moving))


def fit_curve(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x, w = np.concatenate([np.ones((len(features), 1)), features], axis=1), np.zeros(features.shape[1] + 1)
    ridge = np.diag([1e-6, *[1.0] * features.shape[1]])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, x.T @ (label - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = 20_000, max_windows: int = 6_000,
        max_lexicon: int = 5_000) -> Model:
    """A model from the labelled documents outside fold 2; see the module text for the bounds."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("label")).filter(fold(F.col("doc_id")) != 2)
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marks = marks.withColumn("draw", draw).filter(F.col("draw") < max_documents / max(n, 1))
    # At most about max_documents label rows remain, each a few bytes: the bound holds by the draw above.
    sample = written(docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).join(F.broadcast(marks), "doc_id").filter(
        "bytes is not null").drop("doc_id"))
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(curve=np.array([-np.inf if not toxic else np.inf, 0.0, 0.0, 0.0, 0.0]))
    together = F.col("toxic") + F.col("clean")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), together * (toxic / (toxic + clean))) + part(F.col("clean"), together * (clean / (toxic + clean))))
    listed = evidence(sample).filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") * clean > F.col("clean") * toxic * 8)).withColumn(
        "ratio", ratio).filter(F.col("ratio") > min(MIN_RATIO, 5.0 * np.log1p(toxic))).orderBy(
        F.desc("ratio"), "feature").limit(max_lexicon).select("feature").collect()
    lexicon = np.sort(np.array([r[0] for r in listed], dtype=np.int64).view(U64))
    windows = training_windows(sample, lexicon, 0.5 * max_windows / clean, max_windows)
    if not any(any(w["tag"]) for w in windows):
        return Model(curve=np.array([np.log(toxic / clean), 0.0, 0.0, 0.0, 0.0]))
    model = train_chain(windows)

    def make():
        hasher = Hasher()

        def step(batch):
            for at, to, data, bounds in chunks(batch.column(0)):
                features = analyse(model, data, bounds, hasher)[2]
                yield pa.RecordBatch.from_arrays([lists(features.ravel(), np.full(to - at, 4), pa.float64()),
                                                  batch.column(1).slice(at, to - at)], names=["features", "label"])

        return step

    seen = map_texts(sample.select("bytes", "label"), make, "features array<double>, label int").collect()
    model.curve = fit_curve(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], dtype=float))
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, score, predicted, toxic_words and spans, from a model fitted on the same documents."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    found = docs.select("doc_id", toxicity(fit(docs, labels), F.col("text")).alias("found")).select("doc_id", "found.*")
    return found.withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return docs.filter(toxicity(fit(docs, labels), F.col("text"))["score"] < REJECT_AT)
