"""Syslog lines to structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.events import syslog_event
from timberline.functions.stage import staged
from timberline.functions.text import captures, fold, no_pairs, pair, set_pair, strip

SHORTEST = 10
# fixed values: the two line patterns, and the patterns of metadata
BSD = r"(?d)(?U)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.-]+)(?:\(([^)]+)\))?(?:\[(\d+)\])?(?:\s+[\d.]+)?\s*:\s*(.+)$"
ISO = r"(?d)(?U)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2}:\d{2})\s+(\S+)\s+([\w.()-]+)(?:\(([^)]+)\))?(?:\[(\d+)\])?\s*:\s*(.+)$"
PAIRS = r"(?U)\b(logname|uid|euid|tty|ruser|rhost|user|session|exit_code)=(\S*)"
FOR_USER = r"(?U)for user\s+(\S+)"
BY_UID = r"(?U)by\s+\(uid=(\d+)\)"
CONNECTION = r"(?U)connection from\s+(\d+\.\d+\.\d+\.\d+)\s+\(([^)]*)\)"
FROM_IP = r"(?U)from\s+(\d+\.\d+\.\d+\.\d+)"
NUMERIC_KEYS = ("uid", "euid")


def metadata(message: Column) -> Column:
    """Ordered metadata of a message: pairs, then the phrases that override or add to them."""
    keys, values = F.regexp_extract_all(message, F.lit(PAIRS), 1), F.regexp_extract_all(message, F.lit(PAIRS), 2)

    def item(k: Column, v: Column) -> Column:
        whole = k.isin(*NUMERIC_KEYS) & v.rlike(r"^\d+$")
        return pair(k, F.when(whole, v.try_cast("decimal(38,0)").cast("string")).otherwise(v), F.when(whole, "int").otherwise("string"))

    meta = F.when(message.contains("="), fold(F.zip_with(keys, values, item))).otherwise(no_pairs())
    user, uid = F.regexp_extract(message, FOR_USER, 1), F.regexp_extract(message, BY_UID, 1)
    meta = F.when(user != "", set_pair(meta, pair("user", user))).otherwise(meta)
    meta = F.when(uid != "", set_pair(meta, pair("uid", uid.try_cast("decimal(38,0)"), "int"))).otherwise(meta)
    connected, host = F.regexp_extract(message, CONNECTION, 1), strip(F.regexp_extract(message, CONNECTION, 2))
    ip = F.when(connected != "", connected).otherwise(F.regexp_extract(message, FROM_IP, 1))
    extra = F.concat(F.when(ip != "", F.array(pair("source_ip", ip))).otherwise(no_pairs()), F.when((connected != "") & (host != ""), F.array(pair("source_host", host))).otherwise(no_pairs()))
    return F.concat(meta, extra)


def _matched(lines: DataFrame) -> DataFrame:
    df = staged(lines, {"raw_log": strip(F.coalesce(F.col("line"), F.lit("")))})
    long_enough = F.length("raw_log") >= SHORTEST
    return staged(df, {"_m": F.when(long_enough, F.coalesce(captures(F.col("raw_log"), BSD, 6), captures(F.col("raw_log"), ISO, 6)))})


def parse_syslog(lines: DataFrame) -> DataFrame:
    """Structured records of (file_path, line_number, line); lines that aren't syslog are left out.

    component and pid are null where a line has none. Null and blank lines count as rejected.
    """
    m = F.col("_m")
    df = _matched(lines).filter(m.isNotNull())
    df = staged(df, {"message": strip(m[5])})
    none = lambda c: F.when(c != "", c)
    return df.select(
        "file_path", "line_number", m[0].alias("timestamp"), m[1].alias("hostname"), m[2].alias("process"), none(m[3]).alias("component"),
        none(m[4]).try_cast("bigint").alias("pid"), "message", syslog_event(F.col("message")).alias("event"), metadata(F.col("message")).alias("metadata"), "raw_log",
    )


def rejected_lines(lines: DataFrame, limit: int | None = 100) -> DataFrame:
    """The lines that aren't syslog, in order; the first ``limit`` of them, or all with None."""
    df = _matched(lines).filter(F.col("_m").isNull()).select("file_path", "line_number", "line")
    return df if limit is None else df.orderBy("file_path", "line_number").limit(limit)


def parse_summary(lines: DataFrame) -> DataFrame:
    """One row: lines, parsed and rejected ones, the rate, and distinct processes, events and hosts."""
    m = _matched(lines).select(F.col("_m")[2].alias("process"), F.col("_m")[1].alias("hostname"), F.when(F.col("_m").isNotNull(), syslog_event(strip(F.col("_m")[5]))).alias("event"), F.col("_m").isNotNull().alias("ok"))
    return m.agg(
        F.count("*").alias("total_lines"), F.count_if("ok").alias("parsed_lines"), F.count_if(~F.col("ok")).alias("rejected_lines"),
        F.round(F.coalesce(F.try_divide(100 * F.count_if("ok"), F.count("*")), F.lit(0.0)), 2).alias("parse_rate"),
        F.array_join(F.array_sort(F.collect_set("process")), ",").alias("processes"), F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events"),
        F.array_join(F.array_sort(F.collect_set("hostname")), ",").alias("hosts"),
    )
