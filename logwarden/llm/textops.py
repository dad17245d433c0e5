"""Shared helpers: Arrow map functions over whole texts, vectorised words and their 64-bit hashes, folds.

Texts travel as UTF-8 bytes, so that only ASCII letters are lower-cased and no character is cut. All arrays are built
per chunk of about a megabyte of text; a single longer text forms a chunk of its own and is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1 << 20
ARROW_ROWS = "500"
U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: white space only, or every ASCII character but letters and digits (after lower-casing).
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
NON_WORD = np.ones(256, dtype=bool)
NON_WORD[48:58] = NON_WORD[97:123] = NON_WORD[128:] = False
BASE = 0x9E3779B97F4A7C15
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all their bits look random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base & (2**64 - 1), dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes of byte spans from one running sum per piece; the powers are kept between calls."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=U64)

    def spans(self, data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """One array of hashes per array of ends; the spans must be in order and the first ends the longest."""
        out = [np.zeros(len(starts), dtype=U64) for _ in ends]
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_BYTES)))
            base, stop = int(starts[at]), int(ends[0][to - 1])
            if stop - base > len(self.up):
                size = max(2 * (stop - base), CHUNK_BYTES)
                self.up, self.down = powers(BASE, size), powers(pow(BASE, -1, 2**64), size)
            total = np.zeros(stop - base + 1, dtype=U64)
            np.cumsum((data[base:stop].astype(U64) + U64(1)) * self.up[:stop - base], out=total[1:])
            s = starts[at:to] - base
            for hashes, e in zip(out, ends):
                length = e[at:to] - starts[at:to]
                hashes[at:to] = mix((total[s + length] - total[s]) * self.down[s] + length.astype(U64) * ODD[1])
            at = to
        return out


class Words:
    """The words of consecutive texts: byte spans in ``data`` and, per text, the range of its words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
        self.data = LOWER[data]
        inside = ~separators[self.data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | border[1:-1]
        last[:-1] &= ~inside[1:] | border[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def left(self) -> np.ndarray:
        """Per word: how many words its text has from here on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a binary Arrow column (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), bounds.astype(np.int64)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of runs of whole texts of about CHUNK_BYTES."""
    data, bounds = binary_parts(column)
    at, n = 0, len(column)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1))
        yield at, to, data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def map_texts(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches; ``make()`` runs once per task and returns RecordBatch -> iterator of RecordBatch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def text_hash(text: Column) -> Column:
    """Tells apart rows that repeat a document id with another text; null and empty differ."""
    return F.xxhash64(text, text.isNull())


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows, without counting further than that."""
    return df.limit(rows + 1).count() <= rows
