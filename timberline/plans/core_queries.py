"""Queries of the general operators for training data: sessions, log entries, instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.entries import entries_of_lines, entries_of_texts
from timberline.operators.instants import resolve_instants
from timberline.operators.sessions import gap_tree, sessions_at

SESSION_GAP_US = 1_800 * 1_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve_instants(table(spark, d, "canonical").select("record_id", "file_path", "line_number", "timestamp"), table(spark, d, "log_files"))
    return rows.filter("utc_us is not null").select("record_id", "utc_us")


def login_events(spark: SparkSession, d: str) -> DataFrame:
    """(hostname, username, us, file_path, line_number) of the login records that belong to an actor."""
    files = table(spark, d, "log_files")
    rows = table(spark, d, "structured").filter(F.col("hostname").isNotNull()).select("file_path", F.col("line_number").cast("bigint").alias("line_number"), "timestamp", F.try_element_at(F.filter("metadata", lambda m: m["key"] == "user"), F.lit(-1))["value"].alias("username"))
    rows = resolve_instants(rows.filter("username <> ''"), files, "us")
    hosts = files.select(F.col("file_path").alias("_f"), F.col("hostname").alias("hostname"))
    return rows.join(hosts, F.col("file_path") == F.col("_f")).select("hostname", "username", "us", "file_path", "line_number")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The tree of :func:`p1_gap_tree`, cut at one gap."""
    return sessions_at(p1_gap_tree(spark, d), SESSION_GAP_US).select("hostname", "username", "start_us", "end_us", "n_events")


def p1_gap_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes for every gap setting between a minute and a day."""
    return gap_tree(login_events(spark, d), ["hostname", "username"], "us", ["file_path", "line_number"], 60_000_000, 86_400_000_000)


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with all its fields: of the raw lines, and of the records that were never parsed."""
    lines = entries_of_lines(table(spark, d, "raw_lines"))
    records = entries_of_texts(table(spark, d, "canonical").filter(F.col("_format") == "fallback"), "raw_log")
    return lines.unionByName(records)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_entries(spark, d).select("file_path", "line_number", "last_line", "level", "process")


QUERIES = {"p1_found": p1_found, "p1_gap_tree": p1_gap_tree, "p2_found": p2_found, "p2_entries": p2_entries, "p5_found": p5_found}
ORACLE: dict[str, str] = {}
