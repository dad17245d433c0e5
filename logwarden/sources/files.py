"""File sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from logwarden.session import written
from logwarden.sources import jsonarrays, ranges

CORRUPT = "_corrupt"


def read_json(spark: SparkSession, path, schema: T.StructType, *, array: bool = True, keep_bad: bool = False) -> DataFrame:
    """JSON lines, lines that each hold a JSON array, or one array over several lines, decided per file.

    Text that is no JSON is dropped, or kept in ``_corrupt``. A field of another type than the schema's becomes null and its
    record stays. A file whose first non-blank line opens an array and is no JSON by itself is read in blocks by many tasks
    (``jsonarrays``); if it is not one array, its lines count. Only the heads of files decide that. Gzip files with such an array, and
    files in stores that tasks cannot open by themselves, are read whole, by one task each. ``array=False`` spares the look.
    """
    lines = spark.read.text(path)
    if not array:
        return json_records(lines, schema, keep_bad)
    if not ranges.reachable(path):
        packed, blocks = spread_arrays(spark, path), None
    else:
        line = F.regexp_extract(F.col("head").cast("string"), r"^\s*([^\r\n]*)", 1)
        opens = line.startswith("[") & F.try_parse_json(line).isNull()
        found = written(ranges.heads(spark, path).filter(opens).drop("head"))
        zipped = F.col("path").endswith(".gz")
        packed = [r.name for r in found.filter(zipped).collect()]
        blocks = found.filter(~zipped)
    if not packed and (blocks is None or blocks.isEmpty()):
        return json_records(lines, schema, keep_bad)
    texts = lines.select("value", F.col("_metadata.file_path").alias("_name"))
    if packed:
        # Spark leaves out files by such a filter before it opens them.
        inside = F.col("_metadata.file_path").isin(packed)
        text = F.col("value")
        one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
        parts = F.when(one, F.array(text)).otherwise(F.split(text, r"\r\n|\r|\n"))
        whole = spark.read.text(path, wholetext=True).filter(inside).select(F.explode(parts).alias("value"))
        texts = texts.filter(~F.col("_name").isin(packed)).unionByName(whole.withColumn("_name", F.lit("")))
    if blocks is not None:
        cut = jsonarrays.array_blocks(blocks).filter("whole")
        texts = texts.join(blocks.join(cut.select("path").distinct(), "path").select(F.col("name").alias("_name")), "_name", "left_anti")
        # Elements that are no objects are no records.
        one = jsonarrays.elements(cut).filter(F.col("value").startswith("{"))
        texts = texts.select("value").unionByName(one)
    return json_records(texts.select("value"), schema, keep_bad)


def spread_arrays(spark: SparkSession, path) -> list[str]:
    """Paths of the files whose first non-blank line opens an array and is no JSON by itself."""
    text, at = F.col("value"), F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"),
                                         F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    opens = text.rlike(r"^\s*\[") & F.try_parse_json(text).isNull()
    blocks = lines.filter(text.rlike(r"\S")).groupBy("path", "block").agg(
        F.min("at").alias("first"), F.min(F.when(opens, F.col("at"))).alias("opened"))
    found = blocks.groupBy("path").agg(F.min_by(F.col("first").eqNullSafe(F.col("opened")), "block").alias("spread"))
    return [r.path for r in found.filter("spread").select("path").collect()]


# Fixed value: bytes that ``try_parse_json`` takes.
VARIANT_BYTES = 128 << 20


def json_records(lines: DataFrame, schema: T.StructType, keep_bad: bool = False, column: str = "value") -> DataFrame:
    """The records of JSON texts (objects or arrays of objects), one row each."""
    text = F.col(column)
    object_ = text.rlike(r"^\s*\{")
    # One array type for both shapes: an object is an array of one.
    listed = F.when(object_, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    parsed = F.when(F.octet_length(text) < VARIANT_BYTES, F.try_parse_json(text).isNotNull()).otherwise(
        F.json_array_length(listed).isNotNull())
    rows = F.when(parsed & text.rlike(r"^\s*[\[{]"), F.from_json(listed, T.ArrayType(schema)))
    cut = lines.filter(F.trim(text) != "").select(text.alias(CORRUPT), rows.alias("_rows"))
    good = cut.filter("_rows is not null").select(F.explode("_rows").alias("_r")).filter("_r is not null").select("_r.*")
    if not keep_bad:
        return good
    bad = cut.filter("_rows is null").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], CORRUPT)
    return good.withColumn(CORRUPT, F.lit(None).cast("string")).unionByName(bad)


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with a header; columns are found by their header names, whatever their order; absent ones are null.

    Files of one call share one header layout; ``read_many`` reads files one by one where layouts differ.
    """
    text = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    pick = lambda f: (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType))
    return text.select(*[pick(f).alias(f.name) for f in schema.fields])


def read_text(spark: SparkSession, path, column: str = "message_raw") -> DataFrame:
    """One row per line, gz read transparently."""
    return spark.read.text(path).withColumnRenamed("value", column)


EVENT_XML = ("System struct<Provider:struct<_Name:string>,EventID:string,Level:string,Computer:string,"
             "TimeCreated:struct<_SystemTime:string>,EventRecordID:string,Channel:string>,"
             "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>")


def windows_events(df: DataFrame, column: str) -> DataFrame:
    """One row per ``<Event>`` of a text; System children and the named EventData pairs as a map.

    The default namespace is stripped; broken events are skipped.
    """
    chunk = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(<Event[ >].*?</Event>)"), 1))
    plain = F.regexp_replace(F.col("_xml"), r'\sxmlns="[^"]*"|\sxmlns=\'[^\']*\'', "")
    e = F.col("_e")
    pairs = F.filter(F.coalesce(e["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                     lambda d: d["_Name"].isNotNull())
    s = e["System"]
    return (df.select(*[c for c in df.columns if c != column], chunk.alias("_xml"))
            .withColumn("_e", F.from_xml(plain, EVENT_XML, {"mode": "PERMISSIVE"}))
            .filter(s.isNotNull())
            .select(*[c for c in df.columns if c != column],
                    s["EventID"].alias("EventID"), s["Level"].alias("Level"), s["Computer"].alias("Computer"),
                    s["TimeCreated"]["_SystemTime"].alias("TimeCreated_SystemTime"),
                    s["EventRecordID"].alias("EventRecordID"), s["Channel"].alias("Channel"),
                    s["Provider"]["_Name"].alias("Provider_Name"),
                    F.map_from_arrays(pairs["_Name"], pairs["_VALUE"]).alias("EventData"), F.col("_xml").alias("raw")))


def read_windows_xml(spark: SparkSession, path) -> DataFrame:
    """Exported event logs; records end at ``</Event>``, so large files split and none is held whole."""
    df = spark.read.option("lineSep", "</Event>").text(path)
    return windows_events(df.select(F.concat("value", F.lit("</Event>")).alias("_blob")), "_blob")


# File endings and their formats.
ENDINGS = {"json": "json", "csv": "csv", "log": "syslog", "syslog": "syslog", "evt": "windows_event", "evtx": "windows_event"}


def format_of_ending(path: Column) -> Column:
    """Format by the file's ending (``.gz`` ignored), null when the ending says nothing."""
    end = F.lower(F.regexp_extract(F.regexp_replace(path, r"\.gz$", ""), r"\.([A-Za-z]+)$", 1))
    out = F
    for ending, fmt in ENDINGS.items():
        out = out.when(end == ending, F.lit(fmt))
    return out.when(~end.isin("", "txt", "dat"), F.lit("unknown"))


def classify_files(lines: DataFrame, path: str = "source_file", number: str = "line_no", text: str = "message") -> DataFrame:
    """Format per file from its ending, else from its first five lines: JSON, then CSV, else syslog.

    ``row_number() <= 5`` is limited inside each task before the shuffle, so a huge file sends five lines.
    """
    w = Window.partitionBy(path).orderBy(number)
    head = lines.withColumn("_n", F.row_number().over(w)).filter("_n <= 5")
    json = F.bool_or(F.ltrim(F.col(text)).startswith("{") | F.ltrim(F.col(text)).startswith("["))
    guess = F.when(json, "json").when(F.bool_or(F.col(text).contains(",")), "csv").otherwise("syslog")
    out = head.groupBy(path).agg(guess.alias("_guess"))
    return out.select(path, F.coalesce(format_of_ending(F.col(path)), F.col("_guess")).alias("format"))


def numbered_heads(spark: SparkSession, paths, lines: int = 5) -> DataFrame:
    """The first lines of every file with their number, for ``classify_files``; only the heads of files are read."""
    found = ranges.heads(spark, paths).select(F.col("name").alias("source_file"), F.posexplode(F.slice(
        F.split(F.col("head").cast("string"), r"\r\n|\r|\n"), 1, lines)).alias("line_no", "message"))
    return found.withColumn("line_no", F.col("line_no").cast("bigint"))


def read_log_dir(spark: SparkSession, path: str, pattern: str = "*.log", recursive: bool = False,
                 max_bytes: int | None = None) -> DataFrame:
    """Non-blank lines of a directory with source_file and compressed.

    All files are read; ``max_bytes`` leaves larger ones out for a caller who wants that. Plain files are split.
    """
    df = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path)
          .select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("source_file"),
                  F.col("_metadata.file_size").alias("_size")))
    if max_bytes is not None:
        df = df.filter(F.col("_size") <= max_bytes)
    return df.filter(F.trim("message") != "").select(
        "message", "source_file", F.col("source_file").endswith(".gz").alias("compressed"))


def stream_log_dir(spark: SparkSession, path: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """New files of a directory as a stream; the checkpoint remembers what was read.

    For files that are written once. Files that grow are followed by ``tail_log_dir``.
    """
    df = (spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).text(path)
          .select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("source_file")))
    return df.filter(F.trim("message") != "")


POSITIONS = "source_file string, position bigint"


def tail_log_dir(spark: SparkSession, path: str, positions: DataFrame | None, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Lines added since the stored positions, and the new positions (source_file, position in bytes).

    Only the bytes behind the positions are read, in ranges of bounded length. A file that is now shorter than its position was
    truncated and is read from its start. Only complete lines count: a last line without its newline waits for the next call.
    The caller stores the positions once the lines are safe (``written``), so a poll that fails is simply repeated. As a
    stream, the source ``log_tail`` does the same.
    """
    if positions is None:
        positions = spark.createDataFrame([], POSITIONS)
    sizes = ranges.listing(spark, path, pattern).select(F.col("path").alias("source_file"), "size")
    known = sizes.join(positions, "source_file", "left").select(
        "source_file", "size", F.when(F.col("position") <= F.col("size"), F.col("position")).otherwise(F.lit(0)).alias("position"))
    known = written(known.select("source_file", "size", F.coalesce("position", F.lit(0)).cast("bigint").alias("position")))
    fresh = written(ranges.read_lines(ranges.ranges(known.withColumnRenamed("source_file", "path"))))
    reached = fresh.groupBy("source_file").agg(F.max("end").alias("end"))
    moved = known.join(reached, "source_file", "left").select("source_file", F.coalesce("end", "position").alias("position"))
    return fresh.filter(F.trim("message") != "").select("source_file", "message"), moved


def tail_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """S07 as a stream: each batch reads the bytes that were added, a truncated file from its start."""
    spark.dataSource.register(ranges.LogTail)
    df = spark.readStream.format("log_tail").option("path", path).option("pattern", pattern).load()
    return df.filter(F.trim("message") != "").select("source_file", "message")


def union_files(parts: list[DataFrame]) -> DataFrame:
    """Frames of several formats under one schema; missing columns become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def there(spark: SparkSession, path: str) -> str | None:
    """Why a path cannot be read, or None; a look at the store, no job."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        return None if found is not None and len(found) else f"path does not exist: {path}"
    except Exception as e:
        return str(e).splitlines()[0]


def csv_layouts(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The CSV files of the paths, grouped by their header line."""
    if not ranges.reachable(paths):
        return [[p] for p in paths]
    head = F.regexp_extract(F.col("head").cast("string"), r"^([^\r\n]*)", 1)
    found = ranges.heads(spark, paths).filter("size > 0").groupBy(head.alias("header")).agg(F.collect_list("path").alias("paths"))
    # One name per file reaches the driver, as Spark's own listing does.
    return [r.paths for r in found.collect()]


def read_many(spark: SparkSession, by_format: dict[str, list[str]], schema: T.StructType, skipped: list | None = None) -> DataFrame:
    """Files of several formats under one schema, one scan per format or CSV header; missing columns become null.

    A path that does not exist is left out and, with the reason, added to ``skipped``; broken records inside a file are
    dropped by its reader. CSV files are grouped by their header, as their column order may differ.
    """
    readers = {"json": lambda p: read_json(spark, p, schema), "csv": lambda p: read_csv(spark, p, schema),
               "syslog": lambda p: read_text(spark, p), "windows_event": lambda p: read_windows_xml(spark, p)}
    parts = []
    for fmt, paths in by_format.items():
        if fmt not in readers:
            raise ValueError(f"unknown format {fmt}")
        reasons = {path: there(spark, path) for path in paths}
        if skipped is not None:
            skipped += [(path, why) for path, why in reasons.items() if why]
        good = [path for path, why in reasons.items() if not why]
        groups = [good] if fmt != "csv" else csv_layouts(spark, good) if good else []
        parts += [readers[fmt](group) for group in groups if group]
    return union_files(parts) if parts else spark.createDataFrame([], schema)
