"""One JSON array over many lines and blocks, read by many tasks.

A block of bytes cannot be parsed without knowing how it begins: inside a text or outside, behind a backslash, how deep. Its
*effect* can: for each of the three ways to begin (outside a text, inside, inside behind a backslash) the way it ends and by
how much it changes the depth. Effects compose, so running them in order over the blocks of a file (a few numbers per block)
gives every block its beginning. Then every task finds the records that begin in its block, at depth one, and reads on into the next
block where the last of them ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.sources.ranges import BLOCK_BYTES, CHUNK_BYTES, ranges, read_at, store_of
from logwarden.session import written

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
QUOTE, BACKSLASH, COMMA = 34, 92, 44


def quotes(data: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
    """Places of the quotes that open or close a text, and the state at the end, from the state at the beginning."""
    # A byte behind an odd run of backslashes is escaped; backslashes outside texts are no JSON and count alike.
    slash = data == BACKSLASH
    starts = np.flatnonzero(slash & ~np.concatenate([[False], slash[:-1]]))
    ends = np.flatnonzero(slash & ~np.concatenate([slash[1:], [False]])) + 1
    odd = ((ends - starts) & 1).astype(bool)
    # A run at the very beginning of a block that begins escaped is one shorter.
    if begin == ESCAPED and len(starts) and starts[0] == 0:
        odd[0] = ~odd[0]
    behind = ends[odd]
    escaped = np.zeros(len(data) + 1, dtype=bool)
    escaped[behind] = True
    if begin == ESCAPED and len(data) and not slash[0]:
        escaped[0] = True
    places = np.flatnonzero((data == QUOTE) & ~escaped[:-1])
    inside = (begin != OUTSIDE) ^ (len(places) & 1)
    if not len(data):
        return places, begin
    return places, (ESCAPED if escaped[-1] else INSIDE) if inside else OUTSIDE


def depth_steps(data: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(+1 or -1 per byte for brackets outside texts, whether a byte is outside texts, state at the end)."""
    places, end = quotes(data, begin)
    flips = np.zeros(len(data), dtype=np.int8)
    flips[places] = 1
    inside = (np.cumsum(flips) + (begin != OUTSIDE)) & 1
    outside = (inside == 0) & (flips == 0)
    low = data | 32  # [ and {, ] and } differ by this bit
    steps = ((low == 123) & outside).astype(np.int32) - ((low == 125) & outside)
    return steps, outside, end


#: Numbers per beginning in an effect, and the lowest depth of a block that closes nothing.
WIDTH, NEVER = 4, 1 << 40


def effect(data: bytes) -> list[int]:
    """For each of the three beginnings: end state, change of depth, lowest change behind a closing bracket, and how often that."""
    out, array = [], np.frombuffer(data, dtype=np.uint8)
    for begin in (OUTSIDE, INSIDE, ESCAPED):
        steps, _, end = depth_steps(array, begin)
        change = np.cumsum(steps, dtype=np.int32)
        closed = change[steps == -1]
        low = int(closed.min()) if len(closed) else NEVER
        out += [end, int(change[-1]) if len(change) else 0, low, int((closed == low).sum())]
    return out


def record_spans(data: bytes, begin: int, depth: int) -> list[tuple[int, int | None]]:
    """Spans of the array's elements that begin in a block; the last may end in a later block (None).

    An element of the array lies between commas at depth one, its opening bracket and its closing one.
    """
    array = np.frombuffer(data, dtype=np.uint8)
    steps, outside, _ = depth_steps(array, begin)
    after = depth + np.cumsum(steps, dtype=np.int32)
    borders = np.flatnonzero(outside & ((array == COMMA) & (after == 1) | (steps == 1) & (after == 1) | (steps == -1) & (after == 0)))
    opens = [b for b in borders.tolist() if array[b] == COMMA or steps[b] == 1]
    closes = [b for b in borders.tolist() if array[b] == COMMA or steps[b] == -1]
    spans, k = [], 0
    for b in opens:
        while k < len(closes) and closes[k] <= b:
            k += 1
        spans.append((b + 1, closes[k] if k < len(closes) else None))
    return spans


def rest_of_record(file, at: int, stop: int, state: int, depth: int) -> Iterator[bytes]:
    """The bytes from ``at`` to the comma or bracket that ends the element, read chunk by chunk."""
    while at < stop:
        data = read_at(file, at, min(at + CHUNK_BYTES, stop))
        if not data:
            return
        array = np.frombuffer(data, dtype=np.uint8)
        steps, outside, state = depth_steps(array, state)
        after = depth + np.cumsum(steps, dtype=np.int32)
        found = np.flatnonzero(outside & ((array == COMMA) & (after == 1) | (steps == -1) & (after == 0)))
        if len(found):
            yield data[:found[0]]
            return
        yield data
        at, depth = at + len(data), int(after[-1])


def block_effects(cut: DataFrame) -> DataFrame:
    """``ranges`` rows with the effect of their bytes."""

    def run(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                store, inner = store_of(row["path"])
                with store.open_input_file(inner) as file:
                    found.append(effect(read_at(file, row["start"], row["stop"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["path", "start", "stop", "effect"])

    return cut.mapInArrow(run, "path string, start bigint, stop bigint, effect array<bigint>")


def beginnings(effects: DataFrame) -> DataFrame:
    """State and depth at the beginning of every block, and its file's end; a file has one short row per block here."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        state, depth, states, depths, ends = OUTSIDE, 0, [], [], 0
        for e in pdf["effect"]:
            states.append(state)
            depths.append(depth)
            state, change, low, times = (int(x) for x in e[WIDTH * state:WIDTH * state + WIDTH])
            ends += times if depth + low == 0 else 2 if depth + low < 0 else 0
            depth += change
        # The whole is one array when it ends as it began and is closed once.
        whole = state == OUTSIDE and depth == 0 and ends == 1
        return pdf[["path", "start", "stop"]].assign(state=states, depth=depths, end=pdf["stop"].max(), whole=whole)

    return effects.groupBy("path").applyInPandas(compose, "path string, start bigint, stop bigint, state int, depth bigint, end bigint, whole boolean")


def elements(blocks: DataFrame, column: str = "value") -> DataFrame:
    """The elements of the arrays as texts, each from the task of the block in which it begins."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = store_of(row["path"])
                texts, size = [], 0
                with store.open_input_file(inner) as file:
                    data = read_at(file, row["start"], row["stop"])
                    spans = record_spans(data, row["state"], row["depth"])
                    for a, b in spans:
                        if b is None:
                            steps, _, state = depth_steps(np.frombuffer(data, dtype=np.uint8), row["state"])
                            rest = rest_of_record(file, row["stop"], row["end"], state, row["depth"] + int(steps.sum()))
                            text = data[a:] + b"".join(rest)
                        else:
                            text = data[a:b]
                        text = text.strip()
                        if text:
                            texts.append(text.decode("utf-8", "replace"))
                            size += len(text)
                        if size >= 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=[column])
                            texts, size = [], 0
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=[column])

    return blocks.mapInArrow(run, f"{column} string")


def array_blocks(files: DataFrame, length: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the files (path, size) that may hold one array each, with their beginnings; ``whole`` says whether a file does."""
    cut = ranges(files.select("path", F.lit(0).cast("bigint").alias("position"), "size"), length)
    return written(beginnings(block_effects(cut)))
