"""Lines rendered from the events table and parsed again; the SQL says what was rendered, without parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import formats, syslog
from timberline.plans.lines import spread
from timberline.plans.reference_queries import table

_SAID = "case event_id % 3 when 0 then concat('step ', cast(event_id as string), ' done') when 1 then concat('worker ', cast(event_id as string), ' started') else concat('job ', cast(event_id as string), ' failed') end"
_EVENT = "case event_id % 3 when 0 then 'unknown' when 1 then 'service_started' else 'service_failed' end"
_HOST, _PID = "concat('host', cast(user_id % 7 as string))", "cast(1 + event_id % 900 as string)"
_ISO = ("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00')", "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '+02:00')")
_BSD = ("date_format(ts, 'MMM dd HH:mm:ss')", "strftime(ts, '%b %d %H:%M:%S')")
_US = ("date_format(ts, 'MM/dd/yyyy')", "strftime(ts, '%m/%d/%Y')")
_CLOCK = ("date_format(ts, 'hh:mm:ss a')", "strftime(ts, '%I:%M:%S %p')")
_SEVERITY = "case event_id % 3 when 0 then 'INFO' when 1 then 'WARN' else 'ERROR' end"
_LEVEL = "case event_id % 3 when 0 then 'Information' when 1 then 'Warning' else 'Error' end"


def _rendered(spark: SparkSession, d: str, line: str) -> DataFrame:
    return spread(table(spark, d, "events")).selectExpr("'events' as file_path", "event_id + 1 as line_number", f"{line} as line")


def _pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("metadata", F.array_join(F.transform("metadata", lambda m: F.concat_ws("|", m["key"], m["value"], m["vtype"])), ";"))


def syslog_two_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Syslog lines whose time stamps are in turn of both layouts, with and without component and pid."""
    stamp = f"case when event_id % 2 = 0 then {_ISO[0]} else {_BSD[0]} end"
    line = f"concat({stamp}, ' ', {_HOST}, ' app', case when event_id % 5 = 0 then '' else concat('[', {_PID}, ']') end, ': ', {_SAID}, ' user=u', cast(user_id as string), ' uid=', cast(user_id % 9 as string))"
    return _pairs(syslog.parse_syslog(_rendered(spark, d, line))).select("line_number", "timestamp", "hostname", "process", "component", "pid", "message", "metadata")


def _canonical(spark: SparkSession, d: str, name: str, line: str) -> DataFrame:
    out = formats.canonical(_rendered(spark, d, line).filter(formats.fits(F.col("line"), next(f for f in formats.FORMATS if f.name == name))).withColumn("_format", F.lit(name)))
    return _pairs(out).select("line_number", "timestamp", "severity", "hostname", "process", "component", "pid", "message", "event", "metadata")


def lines_windows_event(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d, "windows_event", f"concat({_US[0]}, ' ', {_CLOCK[0]}, ' Disk', cast(user_id % 4 as string), ' ', {_PID}, ' ', {_LEVEL}, ' ', {_SAID}, ' n=', cast(user_id as string))")


def lines_key_value(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d, "key_value", f"concat('level=warn service=app', cast(user_id % 4 as string), ' msg=\"', {_SAID}, '\" n=', cast(user_id as string))")


def lines_bsd_syslog(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d, "bsd_syslog", f"concat({_BSD[0]}, ' ', {_HOST}, ' app(core)[', {_PID}, ']: ', {_SAID}, ' who=u', cast(user_id as string), ', n=', cast(user_id as string))")


QUERIES = {"syslog_two_layouts": syslog_two_layouts, "lines_windows_event": lines_windows_event, "lines_key_value": lines_key_value, "lines_bsd_syslog": lines_bsd_syslog}
_U = "cast(user_id as string)"
_NULL = "cast(null as string)"
ORACLE = {
    "syslog_two_layouts": f"""select event_id + 1 as line_number, case when event_id % 2 = 0 then {_ISO[1]} else {_BSD[1]} end as timestamp, {_HOST} as hostname, 'app' as process, {_NULL} as component,
        case when event_id % 5 = 0 then null else 1 + event_id % 900 end as pid, {_SAID} || ' user=u' || {_U} || ' uid=' || (user_id % 9) as message, 'user|u' || {_U} || '|string;uid|' || (user_id % 9) || '|int' as metadata from events""",
    "lines_windows_event": f"""select event_id + 1 as line_number, {_NULL} as timestamp, {_SEVERITY} as severity, {_NULL} as hostname, 'Disk' || (user_id % 4) as process, {_NULL} as component, {_NULL} as pid, {_SAID} as message, {_EVENT} as event,
        'date|' || {_US[1]} || '|string;time|' || {_CLOCK[1]} || '|string;event_id|' || {_PID} || '|string;level|' || {_LEVEL} || '|string;n|' || {_U} || '|int' as metadata from events""",
    "lines_key_value": f"""select event_id + 1 as line_number, {_NULL} as timestamp, {_NULL} as severity, {_NULL} as hostname, {_NULL} as process, {_NULL} as component, {_NULL} as pid, '' as message, 'unknown' as event,
        'full_line|level=warn|string;service|app' || (user_id % 4) || '|string;msg|' || {_SAID} || '|string;n|' || {_U} || '|int' as metadata from events""",
    "lines_bsd_syslog": f"""select event_id + 1 as line_number, {_BSD[1]} as timestamp, {_NULL} as severity, {_HOST} as hostname, 'app' as process, 'core' as component, {_PID} as pid, {_SAID} as message, {_EVENT} as event,
        'who|u' || {_U} || ',|string;n|' || {_U} || '|int' as metadata from events""",
}
