"""Byte ranges of files, read in tasks that seek.

Files are listed as ``binaryFile`` rows without their content, and ranges are read with ``pyarrow.fs``: local and mounted
folders, and the stores that pyarrow opens (HDFS, S3, GCS, Azure). Compressed files cannot be cut; the head of a gzip file is read.
"""

from __future__ import annotations

import fnmatch
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES, BLOCK_BYTES, CHUNK_BYTES, HEAD_BYTES = 64 << 20, 8 << 20, 1 << 20, 64 << 10


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def reachable(path) -> bool:
    """Whether tasks can open files of this path (or list of paths) by themselves."""
    try:
        for p in [path] if isinstance(path, str) else path:
            store_of(p)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def listing(spark: SparkSession, paths, pattern: str | None = None) -> DataFrame:
    """(path, size, name) of files and of the files in folders; Spark lists them, no content is read.

    ``name`` is what ``_metadata.file_path`` of other readers says of the file.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("size"),
                                     F.col("_metadata.file_path").alias("name"))


def read_at(file, start: int, stop: int) -> bytes:
    """Bytes ``start`` to ``stop`` of an open file; fewer when it ends."""
    file.seek(start)
    parts, at = [], start
    while at < stop:
        part = file.read(min(CHUNK_BYTES, stop - at))
        if not part:
            break
        parts.append(part)
        at += len(part)
    return b"".join(parts)


def line_before(file, at: int) -> bytes:
    """What a line that goes on at ``at`` has before it."""
    held, step = b"", 256
    while at > 0:
        back = max(0, at - step)
        part = read_at(file, back, at)
        cut = part.rfind(b"\n")
        held = part[cut + 1:] + held
        if cut >= 0:
            break
        at, step = back, CHUNK_BYTES
    return held


def lines_between(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(end, line) of the lines whose newline lies at ``start`` to ``stop``; ``end`` is the place behind the newline.

    The first of them is completed by looking back for its beginning; nothing else before ``start`` is read, and nothing
    behind ``stop``. So neighbouring ranges give every line once, and a line without its newline waits.
    """
    held, place, first = b"", start, True
    while place < stop:
        part = read_at(file, place, min(place + CHUNK_BYTES, stop))
        if not part:
            return
        begin = 0
        while (cut := part.find(b"\n", begin)) >= 0:
            line = held + part[begin:cut]
            yield place + cut + 1, line_before(file, start) + line if first else line
            held, begin, first = b"", cut + 1, False
        held += part[begin:]
        place += len(part)


def line_batches(path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches (source_file, message, end) of ``lines_between``."""
    store, inner = store_of(path)
    texts, ends, size = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(ends, pa.int64())],
                                          names=["source_file", "message", "end"])

    with store.open_input_file(inner) as file:
        for end, line in lines_between(file, start, stop):
            texts.append(line.decode("utf-8", "replace"))
            ends.append(end)
            size += len(line)
            if len(texts) >= 10_000 or size >= 4 * CHUNK_BYTES:
                yield batch()
                texts, ends, size = [], [], 0
    if texts:
        yield batch()


def ranges(files: DataFrame, length: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop) ranges of files (path, position, size), each a row, spread over the tasks."""
    starts = F.explode(F.sequence(F.col("position"), F.col("size") - 1, F.lit(length).cast("bigint"))).alias("start")
    cut = files.filter("size > position").select("path", "size", starts)
    return cut.select("path", "start", F.least("size", F.col("start") + length).alias("stop")).repartition("path", "start")


def read_lines(cut: DataFrame) -> DataFrame:
    """(source_file, message, end) of all lines that end inside the ranges."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from line_batches(row["path"], row["start"], row["stop"])

    return cut.mapInArrow(run, "source_file string, message string, end bigint")


def head_of(path: str, length: int) -> bytes:
    """The first bytes of a file, or of what a gzip file holds."""
    store, inner = store_of(path)
    with store.open_input_stream(inner, compression=None) as file:
        data = file.read(length)
    return zlib.decompressobj(31).decompress(data, length) if path.endswith(".gz") else data


def heads(spark: SparkSession, paths, length: int = HEAD_BYTES) -> DataFrame:
    """(path, size, name, head) of every file: its first ``length`` bytes, however large it is."""

    def run(batches):
        for batch in batches:
            found = [head_of(p, length) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["path", "size", "name", "head"])

    return listing(spark, paths).repartition("path").mapInArrow(run, "path string, size bigint, name string, head binary")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Folder:
    """The growing files of a folder; offsets are file sizes: {path: bytes}."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.length = int(options.get("rangeBytes", RANGE_BYTES))

    def sizes(self) -> dict:
        store, inner = store_of(self.path)
        scheme = "file:" if isinstance(store, fs.LocalFileSystem) else self.path.split("://")[0] + "://"
        infos = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return {scheme + i.path: i.size for i in infos
                if i.is_file and i.base_name[0] not in "._" and fnmatch.fnmatch(i.base_name, self.pattern)}

    def added(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of the bytes behind ``start``."""
        out = []
        for path, size in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if at > size else at  # a file that is shorter now was cut and is read anew
            out += [_Range(path, a, min(a + self.length, size)) for a in range(at, size, self.length)]
        return out or [_Range("", 0, 0)]

    def lines(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from line_batches(partition.path, partition.start, partition.stop)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.known = _Folder(options), json.loads(options.get("positions", "{}"))

    def partitions(self) -> list[InputPartition]:
        return self.folder.added(self.known, self.folder.sizes())

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.sizes()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.added(start, end)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Source ``log_tail``: lines of the growing files of a folder, by byte ranges.

    Options: ``path``, ``pattern`` (of file names), ``rangeBytes``, and for a batch read ``positions`` (JSON of {file: byte}).
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source_file string, message string, end bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
