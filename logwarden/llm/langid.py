"""Language identification by cross-parsing.

Per language a suffix automaton is built over a sample of its labelled text. A text is parsed greedily into the longest
phrases that occur in the sample; the language that needs the fewest phrases, each counted with the logarithm of the sample's
size and divided by the text's length, wins. Texts are lower-cased and reduced to letters with single spaces between words.
Phrases do not cross blocks of ``BLOCK`` symbols, so that all blocks of a batch are parsed side by side. The automata are
stored sparsely, as rows of transitions laid over each other in one array; a failing step restarts at the root and counts one
phrase.

The fit is bounded: ``pieces`` hash-chosen documents per language with at most ``piece`` characters of each, from a
hash-chosen place of the text. Where the languages together would exceed ``MOST_CHARACTERS``, every language gets the same
smaller number of characters, and all its pieces are cut alike. The most frequent ``MOST_LETTERS`` letters of all samples have
symbols of their own, all others share one. Prediction reads every character of every text, however long.

Edge cases: null text and text without a letter is ``und`` with score 0; without learned languages every text is; texts in
unknown alphabets get the first language at score 1 / languages; ties go to the first language by name; repeated rows agree;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.textops import ARROW_ROWS, chunks, fold

PIECES, PIECE = 64, 400
#: Sampled characters of all languages (at most 40 bytes of table each), letters told apart, symbols per block.
MOST_CHARACTERS, MOST_LETTERS, BLOCK = 3_200_000, 8_000, 512
#: Pieces shorter than this tell little: beyond the bound there are fewer pieces rather than shorter ones.
LEAST_PIECE = 40
#: Symbol of what is no letter.
OTHER = 65535
RESULT = "struct<lang:string,score:double>"


class SuffixAutomaton:
    """States of all substrings of a text; ``next[s][c]`` leads on while the phrase still occurs."""

    def __init__(self, symbols):
        self.next, self.link, self.length, last = [{}], [-1], [0], 0
        for c in symbols:
            new, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new


def letters_only(text: str) -> str:
    """Letters of a lower-cased text, other characters as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text).split())


def overlaid(follow: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place per state, and one array of all transitions: entry ``place + symbol`` holds owner's place << 32 | next place.

    States take the first free places where none of their entries meets another's, those with many transitions first. No two
    states have the same place, so the owner tells whose entry it is.
    """
    size = len(follow) + sum(map(len, follow)) + 2 * width
    free, unused = np.ones(size + width, dtype=bool), np.ones(size, dtype=bool)
    place = np.full(len(follow), -1, dtype=np.int64)
    single: dict[int, list[int]] = {}
    at = 0
    for state in sorted(range(len(follow)), key=lambda s: -len(follow[s])):
        symbols = np.fromiter(follow[state], dtype=np.int64)
        if len(symbols) < 2:
            single.setdefault(int(symbols[0]) if len(symbols) else -1, []).append(state)
            continue
        begin, step, found = at, 64, np.zeros(0, dtype=np.int64)
        while not len(found):
            if begin >= size:
                size, free, unused = 2 * size, np.pad(free, (0, size), constant_values=True), np.pad(unused, (0, size), constant_values=True)
            tried = np.arange(begin, min(begin + step, size))
            found = tried[unused[tried] & free[tried[:, None] + symbols].all(axis=1)]
            begin, step = begin + step, step * 2
        place[state] = found[0]
        unused[found[0]], free[found[0] + symbols] = False, False
        # Crowded places at the front are not tried again and again; single transitions fill them up.
        at = max(at, int(found[0]) - 128)
    for symbol, states in sorted(single.items(), reverse=True):
        found = np.flatnonzero(unused & free[symbol:symbol + size]) if symbol >= 0 else np.flatnonzero(unused)
        if len(found) < len(states):
            found = np.concatenate([found, np.arange(size, size + len(states))])
            free, unused = np.pad(free, (0, len(states)), constant_values=True), np.pad(unused, (0, len(states)), constant_values=True)
            size += len(states)
        place[states] = found[:len(states)]
        unused[place[states]] = False
        if symbol >= 0:
            free[place[states] + symbol] = False
    comb = np.full(int(place.max()) + width, -1, dtype=np.int64)
    for state, row in enumerate(follow):
        for c, to in row.items():
            comb[place[state] + c] = place[state] << 32 | place[to]
    return place, comb


class Parser:
    """The automata of all languages as one array of transitions, with a full row of each root's."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = {k: letters_only(samples[k]) for k in self.languages}
        seen = Counter(c for t in texts.values() for c in t if c != " " and ord(c) < 65536)
        self.alphabet = sorted(sorted(seen, key=lambda c: (-seen[c], c))[:MOST_LETTERS])
        # Symbols: 0 any unknown letter, 1 a space, then the alphabet.
        code = {c: i + 2 for i, c in enumerate(self.alphabet)} | {" ": 1}
        width = len(self.alphabet) + 2
        combs, self.sizes, base = [], [len(texts[k]) for k in self.languages], 0
        self.starts = np.zeros(len(texts), dtype=np.int64)
        self.roots = np.zeros((len(texts), width), dtype=np.int64)
        for i, k in enumerate(self.languages):
            follow = SuffixAutomaton([code.get(c, 0) for c in texts[k]]).next
            place, comb = overlaid(follow, width)
            combs.append(np.where(comb < 0, -1, comb + (base << 32 | base)))
            self.starts[i] = self.roots[i, :] = place[0] + base
            for c, to in follow[0].items():
                self.roots[i, c] = place[to] + base
            base += len(comb)
        self.cost = np.log2(np.maximum(self.sizes, 2))
        self.table = np.concatenate(combs) if combs else np.zeros(0, dtype=np.int64)

    def symbols(self) -> np.ndarray:
        """Symbol per code point below 65536."""
        out = np.full(65536, OTHER, dtype=np.uint16)
        out[[i for i in range(65536) if chr(i).isalpha()]] = 0
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = i + 2
        return out


def parse(parser: Parser, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Phrases per text and language."""
    blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), blocks)
    begin = (np.cumsum(counts) - counts)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    size = np.minimum(BLOCK, np.cumsum(counts)[text] - begin)
    order = np.argsort(-size, kind="stable")
    begin, longest = begin[order], size[order]
    grid = symbols[np.minimum(begin[:, None] + np.arange(BLOCK), max(len(symbols) - 1, 0))].T.astype(np.int64)
    active = np.searchsorted(-longest, -np.arange(BLOCK), side="left")
    state = np.tile(parser.starts[:, None], (1, len(begin)))
    phrases = np.ones_like(state)
    for t in range(BLOCK):
        n = active[t]
        if not n:
            break
        here = state[:, :n]
        step = parser.table[here + grid[t, :n]]
        failed = step >> 32 != here
        phrases[:, :n] += failed
        state[:, :n] = np.where(failed, parser.roots[:, grid[t, :n]], step & 0xFFFFFFFF)
    out = np.zeros((len(counts), len(parser.languages)))
    np.add.at(out, text[order], phrases.T)
    return out


def prepared(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of consecutive lower-cased texts, runs of other characters as one space, and the symbols per text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    if lead[-1] != len(points):
        pieces = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    symbols = np.where(points < 65536, table[np.minimum(points, 65535)], np.uint16(OTHER))
    for i in np.flatnonzero(points >= 65536):
        symbols[i] = 0 if chr(int(points[i])).isalpha() else OTHER
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(lead))
    other = symbols == OTHER
    first = np.ones(len(symbols), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    after_letter = np.zeros(len(symbols), dtype=bool)
    after_letter[1:] = ~other[:-1] & ~first[1:]
    keep = ~other | after_letter
    symbols = np.where(other, np.uint16(1), symbols)[keep]
    return symbols, np.bincount(text[keep], minlength=len(bounds) - 1)


def language(parser: Parser, text: Column) -> Column:
    """Struct of language and score of a text column."""
    names = [*parser.languages, "und"]

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        table, best, scores = parser.symbols(), [], []
        for at, to, data, bounds in chunks(column):
            symbols, counts = prepared(data, bounds, table)
            if not len(names) > 1:
                counts = counts * 0
            some = counts > 0
            pick, score = np.full(to - at, len(names) - 1), np.zeros(to - at)
            if some.any():
                bits = parse(parser, symbols, counts)[some] * parser.cost / counts[some, None]
                odds = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                pick[some], score[some] = bits.argmin(axis=1), 1 / odds.sum(axis=1)
            best.append(pick)
            scores.append(score)
        chosen = np.concatenate(best) if best else np.zeros(0, dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(names).take(pa.array(chosen)), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                          names=["lang", "score"])

    # Lower-casing runs in the JVM, as in the fit.
    return run(F.lower(text).cast("binary"))


def shares(languages: int, pieces: int, piece: int) -> tuple[int, int]:
    """Pieces per language and characters per piece that keep all languages together below ``MOST_CHARACTERS``."""
    each = MOST_CHARACTERS // max(languages, 1)
    pieces = min(pieces, max(each // min(LEAST_PIECE, piece), 1))
    return pieces, min(piece, max(each // pieces, 1))


def fit(docs: DataFrame, *, pieces: int = PIECES, piece: int = PIECE) -> Parser:
    """Automata from a bounded sample of the rows with a language outside fold 2."""
    rows = docs.filter("lang is not null and text is not null").filter(fold(F.col("doc_id")) != 2)
    pieces, piece = shares(rows.agg(F.count_distinct("lang")).first()[0], pieces, piece)
    draw = F.xxhash64(F.lit(5), "doc_id", "text")
    place = F.pmod(F.xxhash64(F.lit(6), "text"), F.greatest(F.char_length("text") - piece + 1, F.lit(1))).cast("int") + 1
    # The first document by hash in each of ``pieces`` hash classes: one partial row per language, class and task.
    chosen = rows.groupBy("lang", F.pmod(draw, F.lit(pieces)).alias("class")).agg(
        F.min_by(F.lower(F.substring(F.col("text"), place, F.lit(piece))), draw).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "class").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    joined = {k: " ".join(v) for k, v in samples.items()}
    return Parser({k: v for k, v in joined.items() if letters_only(v)})


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every row, from automata of the same documents' labelled rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    found = docs.select("doc_id", language(fit(docs), F.col("text")).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
