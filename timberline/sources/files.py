"""Reading log files, plain or compressed, and records of earlier runs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.text import META_TYPE, strip

RECORD = f"line_number bigint, timestamp string, severity string, hostname string, host string, process string, component string, pid string, message string, _format string, event string, metadata {META_TYPE}, raw_log string, masked_log string"


def valid_text(c: Column) -> Column:
    """The text without bytes that aren't UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, line_number, line) of text files; .gz and .bz2 by suffix, undecodable bytes dropped.

    Lines are numbered from 1, blank ones included, without sorting or gathering a file: each split
    numbers its own lines, and the splits' sizes, a small table, give their starts.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), valid_text(F.col("value")).alias("line"), F.monotonically_increasing_id().alias("_id"))
    return with_line_numbers(raw)


def with_line_numbers(raw: DataFrame) -> DataFrame:
    """(file_path, line_number, line) of lines with their split's start, ``_block``, and rising ``_id``."""
    blocks = raw.groupBy("file_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("file_path").alias("_f"), F.col("_block").alias("_b"), "_first", F.coalesce(ahead, F.lit(0)).alias("_start"))
    placed = raw.join(starts, (F.col("file_path") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.select("file_path", (F.col("_id") - F.col("_first") + F.col("_start") + 1).alias("line_number"), "line")


def _metadata(json: Column) -> Column:
    """An ordered array of the pairs of a JSON object, or the array as it is stored."""
    values, keys = F.from_json(json, "map<string,string>"), F.json_object_keys(json)
    as_object = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(values, k).alias("value"), F.lit("string").alias("vtype")))
    stored = F.from_json(json, META_TYPE)
    return F.coalesce(F.when(json.startswith("["), stored).otherwise(as_object), F.array().cast(META_TYPE))


def read_records(spark: SparkSession, path: str, need_message: bool = False) -> DataFrame:
    """Records from JSON lines, a JSON array, or an envelope {"logs": [...]}; each file's beginning says which.

    Blank and malformed lines and the ``_metadata`` line of a parser's output are dropped; with
    ``need_message`` rows without a message, too. Metadata comes as ordered pairs. Files that are one
    JSON document each are listed on the driver.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.substring(F.ltrim("value"), 1, 200).alias("v")).filter("v <> ''")
    first = text.groupBy("f").agg(F.min_by("v", "at").alias("v"), F.count("*").alias("n"))
    whole = [r["f"] for r in first.filter(F.col("v").startswith("[") | (F.rtrim("v") == "{") | (F.col("v").contains('"logs"') & (F.col("n") == 1))).select("f").collect()]
    lines = read_lines(spark, path).select("file_path", F.col("line_number").alias("at"), F.trim("line").alias("j"))
    rows = lines
    if whole:
        texts = spark.read.text([unquote(f) for f in whole], wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.trim("value").alias("v"))
        items = F.when(F.substring("v", 1, 1) == "[", F.from_json("v", "array<string>")).otherwise(F.from_json(F.get_json_object("v", "$.logs"), "array<string>"))
        listed = spark.createDataFrame([(f,) for f in whole], "_f string")
        rows = lines.join(listed, F.col("file_path") == F.col("_f"), "left_anti").unionByName(texts.select("file_path", F.posexplode(items).alias("at", "j")))
    rows = rows.filter(F.col("j").startswith("{") & F.try_parse_json("j").isNotNull())
    plain = RECORD.replace(f"metadata {META_TYPE}", "metadata string")
    got = rows.select("file_path", "at", F.get_json_object("j", "$._metadata").alias("_m"), F.from_json("j", plain).alias("r")).filter("_m is null")
    df = got.select("file_path", F.coalesce("r.line_number", F.col("at").cast("bigint")).alias("line_number"), *[f"r.{c.split()[0]}" for c in RECORD.split(", ")[1:] if not c.startswith("metadata")], _metadata(F.col("r.metadata")).alias("metadata"))
    return df.filter("message is not null") if need_message else df


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_number, line) of the non-blank lines of corpus files, stripped."""
    return read_lines(spark, path).withColumn("line", strip(F.col("line"))).filter("line <> ''")
