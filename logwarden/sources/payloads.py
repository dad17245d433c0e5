"""Rows out of response payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def json_array(text: Column) -> Column:
    """Elements of a JSON array as JSON texts; null when the text is no array."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def text_lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")


# Keys that hold the rows of a page.
ROW_KEYS = ["data", "results", "events"]


def unwrap_payload(df: DataFrame, column: str) -> DataFrame:
    """One row per record of a page: a list, a known row key, else the object; other text gives one ``raw`` per line."""
    text = F.col(column)
    keys = F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    listed = F.coalesce(json_array(text), *[json_array(F.try_element_at(keys, F.lit(k))) for k in ROW_KEYS],
                        F.when(keys.isNotNull(), F.array(text)))
    kept = [c for c in df.columns if c != column]
    rows = F.coalesce(F.transform(listed, lambda x: F.struct(x.alias("record"), F.lit(None).cast("string").alias("raw"))),
                      F.transform(text_lines(text), lambda x: F.struct(F.lit(None).cast("string").alias("record"), x.alias("raw"))))
    return df.select(*kept, F.inline(rows))


def extract_path(df: DataFrame, column: str, path: str) -> DataFrame:
    """Elements of the list at a dotted path; anything else gives no row."""
    return df.select(*[c for c in df.columns if c != column],
                     F.explode(json_array(F.get_json_object(column, "$." + path))).alias("record"))


def extract_xml(df: DataFrame, column: str, fields: list[str], tag: str = "log") -> DataFrame:
    """Every ``tag`` element at any depth, its listed child elements as columns."""
    chunks = F.regexp_extract_all(column, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), 1)
    schema = ",".join(f"`{f}` string" for f in fields)
    out = df.select(*[c for c in df.columns if c != column], F.explode(chunks).alias("_xml"))
    return out.withColumn("_e", F.from_xml("_xml", schema)).drop("_xml").select("*", "_e.*").drop("_e")


def explode_lines(df: DataFrame, column: str) -> DataFrame:
    """Non-blank lines of a payload text as ``message``."""
    return df.select(*[c for c in df.columns if c != column], F.explode(text_lines(F.col(column))).alias("message"))


def rows_from_columnar(df: DataFrame, column: str) -> DataFrame:
    """``{columns:[{name}], rows:[[...]]}`` as one name -> value map per row."""
    doc = F.from_json(column, "columns array<struct<name:string>>, rows array<array<string>>")
    out = df.select(*[c for c in df.columns if c != column], doc.alias("_d"))
    out = out.select("*", F.explode(F.col("_d.rows")).alias("_row"))
    return out.select(*[c for c in df.columns if c != column],
                      F.map_from_arrays(F.col("_d.columns.name"), F.col("_row")).alias("record"))
