"""Writing records, counts, corpora and dictionaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.corpus import RENDERINGS, corpus_lines
from timberline.operators.records import flattened


def as_object(meta: Column) -> Column:
    """Metadata pairs as a JSON object text in their order; numbers and JSON values unquoted."""

    def quote(s: Column) -> Column:
        listed = F.to_json(F.array(s))
        return listed.substr(F.lit(2), F.length(listed) - 2)

    def item(m: Column) -> Column:
        bare = m["vtype"].isin("int", "float", "bool", "json") & (F.try_parse_json(m["value"]).isNotNull())
        return F.concat(quote(m["key"]), F.lit(":"), F.when(m["value"].isNull(), "null").when(bare, m["value"]).otherwise(quote(m["value"])))

    return F.concat(F.lit("{"), F.array_join(F.transform(meta, item), ","), F.lit("}"))


def json_text(records: DataFrame) -> Column:
    """One record as a JSON text, nulls included, metadata as an object."""
    plain = [c for c in records.columns if c not in ("metadata", "file_path")]
    body = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    if "metadata" not in records.columns:
        return body
    return F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(',"metadata":'), as_object(F.col("metadata")), F.lit("}"))


def write_ndjson(records: DataFrame, path: str) -> None:
    """JSON lines, a part for each partition."""
    records.select(json_text(records).alias("value")).write.mode("overwrite").text(path)


def write_ndjson_with_stats(records: DataFrame, stats: dict, path: str, first: bool = False) -> None:
    """JSON lines and the run's statistics under ``_metadata``, as the first or the last line of the parts."""
    lines = records.select(json_text(records).alias("value"))
    said = records.sparkSession.createDataFrame([(json.dumps({"_metadata": stats}),)], "value string").coalesce(1)
    (said.union(lines) if first else lines.union(said)).write.mode("overwrite").text(path)


def write_json(records: DataFrame, path: str, metadata: dict | None = None, order: tuple[str, ...] = ("file_path", "line_number")) -> None:
    """One indented JSON file for people: an array, or with ``metadata`` an object of both. Small results only."""
    rows = [json.loads(r[0]) for r in records.orderBy(*order).select(json_text(records)).toLocalIterator()]
    body = rows if metadata is None else {"metadata": metadata, "logs": rows}
    Path(path).write_text(json.dumps(body, indent=2, ensure_ascii=False), encoding="utf-8")


def write_counts_csv(counts: DataFrame, path: str) -> None:
    counts.select(F.col("key").alias("Key"), F.col("count").alias("Count")).write.mode("overwrite").csv(path, header=True)


def write_records_csv(records: DataFrame, path: str) -> None:
    flattened(records).write.mode("overwrite").csv(path, header=True)


def write_corpus(texts: DataFrame, folder: str) -> None:
    """A folder of text for each rendering but the masked line, in input order."""
    for r in RENDERINGS[:-1]:
        lines = corpus_lines(texts, r).repartitionByRange("file_path", "line_number").sortWithinPartitions("file_path", "line_number", "part")
        lines.select("line").write.mode("overwrite").text(f"{folder.rstrip('/')}/corpus_{r}")


def write_dictionary(tokens: DataFrame, path: str, json_path: str | None = None) -> None:
    """The pseudonyms as a table, and if asked for as a JSON object of categories. Keep both secret."""
    tokens.write.mode("overwrite").parquet(path)
    if json_path:
        out: dict[str, dict[str, str]] = {}
        for r in tokens.orderBy("category", "ordinal").toLocalIterator():
            out.setdefault(r["category"], {})[r["value"]] = r["token"]
        Path(json_path).write_text(json.dumps(out, indent=2, ensure_ascii=False), encoding="utf-8")


def write_stats(stats: DataFrame, path: str) -> None:
    """The one row of a statistics table as a JSON object."""
    row = stats.first()
    Path(path).write_text(json.dumps(row.asDict() if row else {}, indent=2), encoding="utf-8")


def console_lines(records: DataFrame) -> DataFrame:
    """(line) of each record as the query tool prints it."""
    pairs = F.array_join(F.transform("metadata", lambda m: F.concat(m["key"], F.lit("="), F.coalesce(m["value"], F.lit("")))), " ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return records.select(F.concat_ws(" | ", text("timestamp"), text("hostname"), text("process"), text("event"), F.nullif(pairs, F.lit("")), text("message")).alias("line"))
