"""Tables that are written in batches and published by a manifest (S16, S17, and the state of T02, T04, T05).

A table is a folder with data folders, each written once under a new name, and numbered manifests that name the data folders
in use. A batch first writes its data, then publishes the next manifest by one rename; a reader sees the old or the new
manifest, never a half-written batch. A writer that dies in between leaves a folder that no manifest names. A manifest
remembers the last batch of every writer, so a batch that is repeated after a failure changes nothing. One writer at a time:
of two that publish the same version the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logwarden.session import written

#: Manifests that stay readable behind the newest one.
KEPT_MANIFESTS = 10


class Commits:
    """Numbered manifests (JSON) of one table folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _names(self) -> list[str]:
        at = self._at(f"{self.path}/manifests")
        found = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if n.startswith("v") and n.endswith(".json"))

    def load(self) -> tuple[int, dict]:
        """Version and content of the newest manifest; 0 and {} where none is."""
        names = self._names()
        if not names:
            return 0, {}
        stream = self._fs.open(self._at(f"{self.path}/manifests/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1][1:-5]), json.loads(text)

    def publish(self, version: int, content: dict) -> None:
        """Make ``content`` manifest number ``version``, unless that number is taken."""
        draft, final = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/v{version:012}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        none[0] = getattr(self._hadoop.Options.Rename, "NONE")
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has published version {version} of {self.path}") from e
        for name in self._names()[:-KEPT_MANIFESTS]:
            self._fs.delete(self._at(f"{self.path}/manifests/{name}"), False)

    def folders(self, below: str = "data") -> list[str]:
        at = self._at(f"{self.path}/{below}")
        return [f.getPath().getName() for f in self._fs.listStatus(at) if f.isDirectory()] if self._fs.exists(at) else []

    def drop_except(self, used: set[str]) -> None:
        """Delete the data folders that ``used`` does not name."""
        for name in self.folders():
            if name not in used:
                self._fs.delete(self._at(f"{self.path}/data/{name}"), True)

    def done(self, content: dict, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch <= content.get("writers", {}).get(writer, -1)


def _marked(content: dict, writer: str | None, batch: int | None) -> dict:
    return {**content.get("writers", {}), **({} if writer is None else {writer: batch})}


class UpsertTable:
    """A table by key in hash buckets; a batch of changes rewrites the buckets it touches and no other.

    The number of buckets is fixed at creation. A bucket is read, merged and written by ``spread`` tasks.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, buckets: int = 32, spread: int = 1):
        self.spark, self.path, self.key, self.spread = spark, path.rstrip("/"), key, spread
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.commits = Commits(spark, path)
        self.buckets = self.commits.load()[1].get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, content: dict, chosen: list[int] | None) -> DataFrame:
        parts = [(int(b), d) for b, d in content.get("parts", {}).items() if chosen is None or int(b) in chosen]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{d}/_bucket={b}" for b, d in parts])

    def read(self) -> DataFrame:
        """The rows of the newest manifest."""
        return self._stored(self.commits.load()[1], None)

    def merge(self, changes: DataFrame, *, partial: bool = True, deleted: str | None = None, order: str | None = None,
              defaults: dict | None = None, writer: str | None = None, batch: int | None = None) -> bool:
        """Apply changes by key; whether they were applied (a repeated batch of a writer is not).

        ``partial``: null fields keep the stored value, else a change replaces the whole row. Several changes of one key
        count in ``order`` (a column, the order of rows if none). Where the boolean column ``deleted`` is true the
        row goes, and later changes of the same batch begin a new one. ``defaults`` fill nulls of the merged rows that the
        batch touched. Changes without a key are left out; columns that the table does not have are not read.
        """
        version, content = self.commits.load()
        if self.commits.done(content, writer, batch):
            return False
        last = written(self._last(changes, partial, deleted, order).withColumn("_bucket", self._bucket()))
        # At most ``buckets`` numbers.
        touched = [r[0] for r in last.select("_bucket").distinct().collect()]
        rest = [c for c in self.schema.names if c != self.key]
        old = self._stored(content, touched).select(self.key, *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(True).alias("_was"))
        both = last.join(old, self.key, "full_outer")
        kept = (lambda c: F.when(F.col("_fresh"), F.col(c)).otherwise(F.coalesce(c, f"_o_{c}"))) if partial else (
            lambda c: F.when(F.col("_bucket").isNotNull(), F.col(c)).otherwise(F.col(f"_o_{c}")))
        filled = lambda c: (F.when(F.col("_bucket").isNotNull() & kept(c).isNull(), F.lit(defaults[c])).otherwise(kept(c))
                            if defaults and c in defaults else kept(c))
        rows = both.filter(~F.coalesce("_gone", F.lit(False))).select(
            *[(F.col(c) if c == self.key else filled(c)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names])
        name = uuid.uuid4().hex
        share = F.pmod(F.hash(F.lit(1), self.key), F.lit(self.spread))
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket", share).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        there = {int(f.split("=")[1]) for f in self.commits.folders(f"data/{name}") if f.startswith("_bucket=")}
        parts = {b: d for b, d in content.get("parts", {}).items() if int(b) not in touched} | {str(b): name for b in sorted(there)}
        self.commits.publish(version + 1, {"buckets": self.buckets, "parts": parts, "writers": _marked(content, writer, batch)})
        return True

    def _last(self, changes: DataFrame, partial: bool, deleted: str | None, order: str | None) -> DataFrame:
        """One row per key: the fields after all its changes, ``_gone``, and ``_fresh`` where a deletion came before them."""
        rest = [c for c in self.schema.names if c != self.key]
        held = lambda c: F.col(c) if c in changes.columns else F.lit(None).cast(self.schema[c].dataType)
        rows = changes.filter(F.col(self.key).isNotNull()).select(
            F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key), *[held(c).alias(c) for c in rest],
            (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"),
            (F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).alias("_del"))
        if deleted:
            # Only what follows the last deletion of a key counts. Keys without one are not in the small side.
            rows = written(rows)
            ends = rows.filter("_del").groupBy(self.key).agg(F.max("_order").alias("_end"))
            rows = rows.join(ends, self.key, "left").filter("_end is null or _order >= _end").drop("_end")
        at = F.col("_order")
        value = lambda c: F.max_by(c, F.when(~F.col("_del") & (F.col(c).isNotNull() if partial else F.lit(True)), at))
        return rows.groupBy(self.key).agg(*[value(c).alias(c) for c in rest], F.max_by("_del", "_order").alias("_gone"),
                                          F.bool_or("_del").alias("_fresh"))

    def delete(self, ids: DataFrame, *, writer: str | None = None, batch: int | None = None) -> bool:
        """Remove the rows with these keys."""
        return self.merge(ids.select(self.key, F.lit(True).alias("_delete")), deleted="_delete", writer=writer, batch=batch)

    def vacuum(self) -> None:
        """Delete the data folders that the newest manifest does not name; no reader may still use them."""
        self.commits.drop_except(set(self.commits.load()[1].get("parts", {}).values()))


class BatchLog:
    """Batches of rows, each committed once, read together; optionally folded level by level.

    With ``fold`` (a function of the rows of several batches that gives an equivalent smaller frame), ``fanout`` parts of one
    level become one part of the next, so a reader opens at most ``fanout`` parts per level, a logarithm of the batches.
    Parts that were folded stay until the fold after the next, for readers that still hold them.
    """

    def __init__(self, spark: SparkSession, path: str, *, fold: Callable[[DataFrame], DataFrame] | None = None, fanout: int = 8,
                 partition_by: list[str] | None = None):
        self.spark, self.path, self.fold, self.fanout, self.partition_by = spark, path.rstrip("/"), fold, fanout, partition_by or []
        self.commits = Commits(spark, path)

    def _write(self, df: DataFrame) -> str:
        name = f"part={uuid.uuid4().hex}"
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/data/{name}")
        return name

    def _of(self, parts: list[dict], schema: str) -> DataFrame:
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{p['dir']}" for p in parts]).drop("part")

    def append(self, df: DataFrame, writer: str, batch: int) -> bool:
        """Commit one batch; whether it was new. A part that was written but not committed is never read."""
        version, content = self.commits.load()
        if self.commits.done(content, writer, batch):
            return False
        part = {"dir": self._write(df), "level": 0}
        content = {"schema": df.schema.json(), "parts": [*content.get("parts", []), part], "writers": _marked(content, writer, batch),
                   "retired": content.get("retired", [])}
        self.commits.publish(version + 1, content)
        if self.fold:
            self._compact(version + 1, content)
        return True

    def _compact(self, version: int, content: dict) -> None:
        level = 0
        while len(full := [p for p in content["parts"] if p["level"] == level]) >= self.fanout:
            part = {"dir": self._write(self.fold(self._of(full, content["schema"]))), "level": level + 1}
            old = content["retired"]
            content = {**content, "parts": [p for p in content["parts"] if p["level"] != level] + [part], "retired": [p["dir"] for p in full]}
            version += 1
            self.commits.publish(version, content)
            if old:
                self.commits.drop_except({p["dir"] for p in content["parts"]} | set(content["retired"]))
            level += 1

    def parts(self) -> list[dict]:
        return self.commits.load()[1].get("parts", [])

    def read(self) -> DataFrame | None:
        """All committed rows, in one scan; None before the first batch."""
        content = self.commits.load()[1]
        return self._of(content["parts"], content["schema"]) if content.get("parts") else None
