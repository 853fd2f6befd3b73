"""One query for each log operator, with SQL for another engine where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import events
from timberline.functions.text import strip, value_of
from timberline.functions.vocab import ALIASES, PRIORITY, SEVERITY, priority_severity, severity
from timberline.operators import anomaly, corpus, detect, formats, pseudonyms, quality, records, syslog, windows
from timberline.plans.lines import DUCK_LINES, mixed_lines, syslog_lines
from timberline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return syslog.parse_syslog(syslog_lines(spark, d))


def parsed_once(spark: SparkSession, d: str) -> DataFrame:
    """The same, parsed once for all that reads it."""
    shared_folder(spark, "records")
    return parsed(spark, d).checkpoint()


def structured(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structured")


# --- syslog lines to records

_BSD = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.-]+)(?:\(([^)]+)\))?(?:\[(\d+)\])?(?:\s+[\d.]+)?\s*:\s*(.+)$"
_EVENT = "case " + " ".join(f"when contains(message, '{t}') then '{e}'" for t, e in events.SYSLOG_RULES) + " else 'unknown' end"


def _group(i: int) -> str:
    return f"nullif(regexp_extract(line, '{_BSD}', {i}), '')"


PARSED = f"""{DUCK_LINES}, fields as (select file_path, line_number, line, {_group(1)} as timestamp, {_group(2)} as hostname, {_group(3)} as process, {_group(4)} as component, cast({_group(5)} as bigint) as pid, trim(regexp_extract(line, '{_BSD}', 6)) as message
  from lines where length(trim(line)) >= 10 and regexp_matches(line, '{_BSD}')), parsed as (select *, {_EVENT} as event from fields)"""
_USER = r"coalesce(nullif(regexp_extract(message, 'for user\s+(\S+)', 1), ''), case when regexp_matches(message, '\buser=') then regexp_extract(message, '\buser=(\S*)', 1) end)"
_RHOST = r"case when regexp_matches(message, '\brhost=') then regexp_extract(message, '\brhost=(\S*)', 1) end"
_IP = r"nullif(regexp_extract(message, 'from\s+(\d+\.\d+\.\d+\.\d+)', 1), '')"


@query(f"with {PARSED} select line_number, timestamp, hostname, process, component, pid, message, event from parsed")
def syslog_parse(spark, d):
    return parsed(spark, d).select("line_number", "timestamp", "hostname", "process", "component", "pid", "message", "event")


@query(rf"with {PARSED} select line_number, {_USER} as username, {_RHOST} as rhost, {_IP} as source_ip, case when contains(message, 'connection from') then nullif(trim(regexp_extract(message, '\(([^)]*)\)', 1)), '') end as source_host, case when contains(message, 'uid=') then regexp_extract(message, '\buid=(\d+)', 1) end as uid from parsed")
def syslog_metadata(spark, d):
    m = F.col("metadata")
    return parsed(spark, d).select("line_number", value_of(m, "user").alias("username"), value_of(m, "rhost").alias("rhost"), value_of(m, "source_ip").alias("source_ip"), value_of(m, "source_host").alias("source_host"), value_of(m, "uid").alias("uid"))


@query(f"with {DUCK_LINES} select line_number, line from lines where length(trim(line)) < 10 or not regexp_matches(line, '{_BSD}') order by line_number limit 100")
def syslog_dead_letter(spark, d):
    return syslog.rejected_lines(syslog_lines(spark, d)).select("line_number", "line")


@query(f"""with {PARSED} select (select count(*) from lines) as total_lines, count(*) as parsed_lines, (select count(*) from lines) - count(*) as rejected_lines, round(100.0 * count(*) / (select count(*) from lines), 2) as parse_rate,
  string_agg(distinct process, ',' order by process) as processes, string_agg(distinct event, ',' order by event) as events, string_agg(distinct hostname, ',' order by hostname) as hosts from parsed""")
def syslog_summary(spark, d):
    return syslog.parse_summary(syslog_lines(spark, d))


@query(f"with {PARSED} select {_RHOST} as rhost, count(*) as failures from parsed where event = 'authentication_failure' group by 1 order by failures desc, rhost limit 10")
def failed_logins_by_rhost(spark, d):
    rows = parsed(spark, d).filter("event = 'authentication_failure'").groupBy(value_of(F.col("metadata"), "rhost").alias("rhost")).agg(F.count("*").alias("failures"))
    return rows.orderBy(F.desc("failures"), "rhost").limit(10)


@query(f"select record_id, {_EVENT} as event from structured")
def event_classify(spark, d):
    return structured(spark, d).select("record_id", events.syslog_event(F.coalesce("message", F.lit(""))).alias("event"))


def _derived(first_exit: bool, sudo: str) -> str:
    low = "lower(message)"
    has = lambda *w: "(" + " or ".join(f"contains({low}, '{x}')" for x in w) + ")"
    check, left = f"when {has('password check failed')} then 'authentication_failure'", f"when {has('exited abnormally')} then 'abnormal_exit'"
    return f"""case when {has('session opened')} then 'session_opened' when {has('session closed')} then 'session_closed' when {has('authentication failure', 'failure; logname=')} then 'authentication_failure'
      {left if first_exit else ''} {check} when {has('accepted password', 'accepted publickey')} then 'authentication_success' {'' if first_exit else left} when {has('disconnected from')} then 'session_closed'
      when contains({sudo}, 'sudo') and (contains(message, 'COMMAND=') or {has('command')}) then 'sudo_command' when {has('started', 'starting')} then 'service_started'
      when {has('failed')} and not {has('authentication')} then 'service_failed' when {has('stopped', 'stopping')} then 'service_stopped' when {has('new session')} then 'new_session'
      when {has('removed session', 'session removed')} then 'removed_session' else 'unknown' end"""


@query(f"select record_id, {_derived(False, 'lower(message)')} as event from canonical")
def event_derive(spark, d):
    return table(spark, d, "canonical").select("record_id", events.derived_event(F.col("message")).alias("event"))


@query(f"select record_id, {_derived(True, 'message')} as event from canonical")
def event_derive_masked(spark, d):
    return table(spark, d, "canonical").select("record_id", events.masked_event(F.col("message")).alias("event"))


# --- filters, counts, top-k over structured records

_META = "(list_filter(metadata, lambda m: m.key = '{0}')[-1]).value"


def _filter(where: str) -> str:
    return f"select record_id from structured where {where}"


@query(_filter("process = 'sshd'"))
def filter_process(spark, d):
    return structured(spark, d).filter(records.matches(process="sshd")).select("record_id")


@query(_filter("event = 'session_opened'"))
def filter_event(spark, d):
    return structured(spark, d).filter(records.matches(event="session_opened")).select("record_id")


@query(_filter("hostname = 'bastion-01'"))
def filter_host(spark, d):
    return structured(spark, d).filter(records.matches(hostname="bastion-01")).select("record_id")


@query("select record_id from structured where pid in (select min(pid) from structured union all select max(pid) from structured)")
def filter_pid(spark, d):
    s = structured(spark, d)
    ends = s.agg(F.min("pid").alias("a"), F.max("pid").alias("b")).first()
    return s.filter(records.matches(pid=str(ends["a"])) | records.matches(pid=ends["b"])).select("record_id")


@query(_filter(f"coalesce({_META.format('user')}, 'None') = 'root' and contains(lower(message), 'session')"))
def filter_user_message(spark, d):
    return structured(spark, d).filter(records.matches(user="root", message_contains="SESSION")).select("record_id")


@query(_filter(f"coalesce({_META.format('rhost')}, 'None') = 'None' and coalesce({_META.format('uid')}, 'None') = '0'"))
def filter_meta(spark, d):
    return structured(spark, d).filter(records.matches(rhost="None", meta=records.meta_args(["uid=0", "noise"]))).select("record_id")


def _top(key: str, limit: int = 100) -> str:
    return f"with k as (select {key} as key, file_path, line_number from structured) select key, count(*) as count from k group by key order by count(*) desc, min((file_path, line_number)) limit {limit}"


@query(_top("coalesce(process, 'unknown')"))
def agg_process(spark, d):
    return records.count_by(structured(spark, d), "process")


@query(_top("coalesce(event, 'unknown')"))
def agg_event(spark, d):
    return records.count_by(structured(spark, d), "event")


@query(_top(f"coalesce({_META.format('user')}, 'unknown')"))
def agg_user(spark, d):
    return records.count_by(structured(spark, d), "user")


@query(_top("coalesce(hostname, 'unknown')"))
def agg_host(spark, d):
    return records.count_by(structured(spark, d), "hostname")


@query(_top(r"coalesce(case when contains(timestamp, 'T') then split_part(split_part(timestamp, 'T', 2), ':', 1) when length(regexp_replace(trim(timestamp), '\s+', ' ', 'g')) - length(replace(regexp_replace(trim(timestamp), '\s+', ' ', 'g'), ' ', '')) >= 2 then split_part(split_part(regexp_replace(trim(timestamp), '\s+', ' ', 'g'), ' ', 3), ':', 1) else 'unknown' end, 'unknown')"))
def agg_hour(spark, d):
    return records.count_by(structured(spark, d), "hour")


@query("select record_id from structured order by file_path, line_number, record_id limit 100")
def first_n_rows(spark, d):
    return records.first_rows(structured(spark, d), 100, ("file_path", "line_number", "record_id")).select("record_id")


@query("select " + ", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in ("record_id", "hostname", "process", "component", "pid", "message", "event")) + f", coalesce({_META.format('user')}, '') as \"meta.user\", coalesce({_META.format('rhost')}, '') as \"meta.rhost\" from structured")
def export_flat(spark, d):
    s = structured(spark, d).select("record_id", "hostname", "process", "component", "pid", "message", "event", "metadata")
    return records.flattened(s, ["user", "rhost"])


@query("select 'process' as kind, process as value from structured where process is not null group by all union all select 'event', event from structured where event is not null group by all union all select 'hostname', hostname from structured where hostname is not null group by all")
def distinct_values(spark, d):
    s = structured(spark, d)
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("process", "event", "hostname")])).alias("x")).select("x.*").filter("value is not null").distinct()


@query("with f as (select unnest(['timestamp', 'hostname', 'process', 'component', 'pid', 'message', 'event']) as field), n as (select count(*) as total, " + ", ".join(f"count(*) filter (coalesce(cast({c} as varchar), '') <> '') as {c}" for c in ("timestamp", "hostname", "process", "message", "event")) + " from structured) select field, " + "case field " + " ".join(f"when '{c}' then {c}" for c in ("timestamp", "hostname", "process", "message", "event")) + " else total end as filled, total, round(100.0 * (case field " + " ".join(f"when '{c}' then {c}" for c in ("timestamp", "hostname", "process", "message", "event")) + " else total end) / total, 2) as rate from f, n")
def fill_rates(spark, d):
    return quality.fill_rates(structured(spark, d))


# --- severities, time stamps, formats

_LEVEL = "case when {0} is null then null " + " ".join(f"when trim(lower({{0}}), '[]() ') = '{w}' then '{s}'" for w, s in SEVERITY.items()) + " else 'UNKNOWN' end"


@query(f"select l_orderkey, l_linenumber, {_LEVEL.format('w')} as severity from (select l_orderkey, l_linenumber, case l_orderkey % 7 when 0 then '[Error]' when 1 then 'notice' when 2 then 'FATAL ' when 3 then 'odd' when 4 then null when 5 then 'verbose' else l_returnflag end as w from lineitem)")
def severity_normalize(spark, d):
    w = F.expr("case l_orderkey % 7 when 0 then '[Error]' when 1 then 'notice' when 2 then 'FATAL ' when 3 then 'odd' when 4 then null when 5 then 'verbose' else l_returnflag end")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", severity(w).alias("severity"))


@query("select record_id, case cast(p as int) % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(PRIORITY)) + f" end as severity from (select record_id, {_META.format('priority')} as p from canonical) where p is not null")
def priority_normalize(spark, d):
    p = value_of(F.col("metadata"), "priority")
    return table(spark, d, "canonical").filter(p.isNotNull()).select("record_id", priority_severity(p).alias("severity"))


def _sniffed(i: int) -> str:
    return f"nullif(regexp_extract(left(raw_log, 60), '{formats.SNIFF[i][1]}', 0), '')"


@query("select record_id, coalesce(" + ", ".join(_sniffed(i) for i in range(len(formats.SNIFF))) + ") as stamp, case " + " ".join(f"when {_sniffed(i)} is not null then '{n}'" for i, (n, _) in enumerate(formats.SNIFF)) + " end as stamp_format from canonical")
def timestamp_sniff(spark, d):
    stamp, name = formats.sniff(F.col("raw_log"))
    return table(spark, d, "canonical").select("record_id", stamp.alias("stamp"), name.alias("stamp_format"))


_PLAIN = {f.name: re.sub(r"\(\?=\\s.*?\\S\)", "", f.pattern.replace("(?d)(?U)", "")).replace("*+", "*").replace("++", "+") for f in formats.FORMATS}


def _hit(name: str) -> str:
    return f"regexp_matches(trim(line), '{_PLAIN[name].replace(chr(39), chr(39) * 2)}')"


_SAMPLED = "sampled as (select * from (select *, row_number() over (partition by file_path order by line_number) as rank from (select distinct file_path, line_number, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from raw_lines) where line <> '') where rank <= 20)"


@query("with " + _SAMPLED + " " + " union all ".join(f"select file_path, '{f.name}' as format, round(avg(case when {_hit(f.name)} then 1.0 else 0.0 end), 6) as score from sampled group by file_path" for f in formats.FORMATS))
def format_scores(spark, d):
    return detect.format_scores(table(spark, d, "raw_lines").dropDuplicates(["file_path", "line_number"]))


@query("with " + _SAMPLED + ", hits as (select file_path, avg(case when line like '{%' and json_valid(line) then 1.0 else 0.0 end) as js, " + ", ".join(f"avg(case when {_hit(f.name)} then 1.0 else 0.0 end) as {f.name}" for f in formats.FORMATS) + " from sampled group by file_path), " + "long as (" + " union all ".join(f"select file_path, js, '{f.name}' as format, {f.name} as score, {f.priority} as priority, {-i} as pos, greatest({', '.join(g.name for g in formats.FORMATS if g.name != 'key_value')}) as others from hits" for i, f in enumerate(formats.FORMATS)) + """)
  select file_path, case when max(js) >= 0.7 then 'json' else arg_max(format, (score, priority, pos)) filter ((format <> 'key_value' or others < 0.2) and score >= 0.5) end as format from long group by file_path""")
def format_detect(spark, d):
    return detect.detected_formats(table(spark, d, "raw_lines").dropDuplicates(["file_path", "line_number"]))


# The mixed lines change at known places. Lines that nothing fits fill the buffer of ten over and over; the
# last such buffer takes in the first line of what follows, which is then lost to it.
_TURN, _AT = "cast(floor(event_id / 500) as bigint) % 5", "event_id % 2500"
_HEALED = f"""healed as (select event_id, event_id + 1 as line_number, ts, user_id,
  case when {_TURN} = 4 then case when {_AT} = 2000 then 'cont' else 'fallback' end when {_AT} = 0 and event_id > 0 then 'fallback'
  else ['bsd_syslog', 'iso_syslog', 'json', 'hdfs_log'][({_TURN}) + 1] end as resolved,
  case when {_TURN} in (1, 2, 3) then event_id % 500 < 10 when {_TURN} = 0 and event_id >= 2500 then {_AT} between 1 and 10 else false end as replayed from events)"""


@query(f"with {_HEALED} select line_number, resolved, case when resolved = 'cont' then event_id end as parent, replayed from healed")
def heal_resolve(spark, d):
    return detect.resolve_lines(mixed_lines(spark, d)).select("line_number", "resolved", "parent", "replayed")


@query(f"""with {_HEALED} select count(*) as total_lines, count(*) filter (resolved <> 'cont') as parsed_lines, count(*) filter (resolved = 'fallback') as failed_lines, count(*) filter (resolved = 'cont') as multiline_continuations,
  count(*) filter (replayed) as replayed_lines, string_agg(distinct resolved, ',' order by resolved) filter (resolved not in ('cont', 'fallback')) as formats_detected from healed""")
def heal_stats(spark, d):
    return detect.parse_stats(mixed_lines(spark, d)).select("total_lines", "parsed_lines", "failed_lines", "multiline_continuations", "replayed_lines", "formats_detected")


@query()
def raw_lines_stats(spark, d):
    return detect.parse_stats(table(spark, d, "raw_lines"))


_STEP = "'step ' || event_id || ' done'"
_WORDS = f"case when {_TURN} = 4 then case when event_id % 10 = 0 then 'at frame ' || event_id else 'words only ' || event_id end else strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 7) || ' app[' || (event_id % 900) || ']: ' || {_STEP} end"


@query(f"""with {_HEALED} select line_number, resolved as _format, case resolved when 'fallback' then {_WORDS} else {_STEP} || case when lead(resolved) over (order by event_id) = 'cont' then chr(10) || 'at frame ' || (event_id + 1) else '' end end as message,
  case resolved when 'fallback' then null when 'hdfs_log' then 'app.Step' else 'app' end as process, case when resolved in ('bsd_syslog', 'iso_syslog') then 'host' || (user_id % 7) end as hostname,
  case resolved when 'json' then 'WARN' when 'hdfs_log' then 'INFO' end as severity from healed qualify resolved <> 'cont'""")
def parse_mixed(spark, d):
    return detect.parse_lines(mixed_lines(spark, d)).select("line_number", "_format", "message", "process", "hostname", "severity")


@query()
def parse_raw_lines(spark, d):
    return detect.parse_lines(table(spark, d, "raw_lines"))


def _canonical_of(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "canonical").filter(F.col("_format") == name).select("record_id", "file_path", "line_number", "_format", F.col("raw_log").alias("line"))
        out = formats.canonical(rows)
        return out.select("record_id", "timestamp", "severity", "hostname", "host", "process", "component", "pid")

    return run


for _name in (*[f.name for f in formats.FORMATS if f.name != "key_value"], "json", "fallback"):
    QUERIES[f"parse_{_name}"] = _canonical_of(_name)


def _re(name: str, group: str) -> str:
    f = next(x for x in formats.FORMATS if x.name == name)
    i = f.groups.index(group) + 1
    return f"nullif(regexp_extract(line, '{_PLAIN[name]}', {i}), '')"


def _format_sql(name: str) -> str:
    f = next(x for x in formats.FORMATS if x.name == name)
    col: dict[str, str] = dict.fromkeys(("timestamp", "severity", "hostname", "host", "process", "component", "pid"), "cast(null as varchar)")
    for g in f.groups:
        t = f.field_map.get(g, g)
        if t in col and g != "severity" and (g in f.field_map or g in formats.CANONICAL):
            col[t] = _re(name, g)
    if f.severity_from == "priority":
        col["severity"] = f"case cast({_re(name, 'priority')} as int) % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(PRIORITY)) + " end"
    elif f.severity_from:
        col["severity"] = _LEVEL.format(_re(name, f.severity_from))
    return f"with rows as (select record_id, trim(raw_log, ' ' || chr(9) || chr(10) || chr(13)) as line from canonical where _format = '{name}') select record_id, " + ", ".join(f"{v} as {k}" for k, v in col.items()) + " from rows"


for _name in ("bsd_syslog", "rfc5424_syslog", "iso_syslog", "windows_event", "hdfs_log", "apache_error", "apache_combined", "bgl_log", "generic_iso"):
    ORACLE[f"parse_{_name}"] = _format_sql(_name)


def _alias_sql(field: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(raw_log, '$.\"{a}\"')" for a in ALIASES[field]) + ")"


ORACLE["parse_json"] = f"select record_id, {_alias_sql('timestamp')} as timestamp, {_LEVEL.format(_alias_sql('severity'))} as severity, {_alias_sql('hostname')} as hostname, cast(null as varchar) as host, {_alias_sql('process')} as process, {_alias_sql('component')} as component, cast(null as varchar) as pid from canonical where _format = 'json'"
ORACLE["parse_fallback"] = f"""with rows as (select record_id, raw_log as line, coalesce({", ".join(_sniffed(i) for i in range(len(formats.SNIFF)))}) as stamp from canonical where _format = 'fallback'),
  fields as (select *, regexp_matches(line, '(^|[\\s;])[A-Za-z_][\\w.-]*=[^\\n]*[\\s;][A-Za-z_][\\w.-]*=') as many from rows)
  select record_id, stamp as timestamp, case when many then {_LEVEL.format("nullif(regexp_extract(line, 'level=([^ )]*)', 1), '')")} end as severity, cast(null as varchar) as hostname, cast(null as varchar) as host, case when many then nullif(regexp_extract(line, '(?:service|app)=([^ )]*)', 1), '') end as process, cast(null as varchar) as component, cast(null as varchar) as pid from fields"""


# --- pseudonyms

_TOKENS = {
    "hosts": ("HOST", "select hostname as value, line_number, 0 as step from parsed where hostname is not null"),
    "pids": ("PID", "select cast(pid as varchar) as value, line_number, 0 as step from parsed where pid is not null"),
    "users": ("USER", rf"select value, line_number, 0 as step from (select {_USER} as value, line_number from parsed) where value is not null"),
    "remote_hosts": ("REMOTE_HOST", rf"select value, line_number, 0 as step from (select coalesce(case when not regexp_matches(coalesce({_RHOST}, ''), '^\d+\.\d+\.\d+\.\d+$') then nullif({_RHOST}, '') end, case when contains(message, 'connection from') then nullif(trim(regexp_extract(message, '\(([^)]*)\)', 1)), '') end) as value, line_number from parsed) where value is not null"),
    "ips": ("IP", r"select nullif(regexp_extract(message, '(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', 1), '') as value, line_number, 0 as step from parsed where regexp_matches(message, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')"),
}


def _dictionary_sql(category: str) -> str:
    prefix, found = _TOKENS[category]
    return f"with {PARSED}, first as (select value, min(line_number) as line_number from ({found}) group by value), numbered as (select value, row_number() over (order by line_number) as ordinal from first) select value, ordinal, '{prefix}_' || case when ordinal < 1000 then lpad(cast(ordinal as varchar), 3, '0') else cast(ordinal as varchar) end as token from numbered"


def _dictionary_of(category: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pseudonyms.dictionary(parsed_once(spark, d)).filter(F.col("category") == category).select("value", F.col("ordinal").cast("bigint").alias("ordinal"), "token")

    return run


for _name in _TOKENS:
    QUERIES[f"pseudonym_{_name}"] = _dictionary_of(_name)
    ORACLE[f"pseudonym_{_name}"] = _dictionary_sql(_name)


_TOKENS_SQL = ", ".join(
    f"tok_{c} as (select value, '{prefix}_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as token from (select value, row_number() over (order by min(line_number)) as n from ({found}) group by value))"
    for c, (prefix, found) in (_TOKENS | {"commands": ("CMD", "select regexp_extract(message, 'COMMAND=(.+)$', 1) as value, line_number, 0 as step from parsed where contains(message, 'COMMAND=')")}).items()
)
_MASKED = f"""{_TOKENS_SQL}, found as (select *, {_USER} as u, {_RHOST} as r, {_IP} as ip, case when contains(message, 'connection from') then nullif(trim(regexp_extract(message, '\\(([^)]*)\\)', 1)), '') end as h, nullif(regexp_extract(message, 'COMMAND=(.+)$', 1), '') as c from parsed),
  named as (select f.*, th.token as th, tp.token as tp, tu.token as tu, coalesce(ti.token, tr.token) as tr, tip.token as tip, trh.token as trh, tc.token as tc from found f left join tok_hosts th on f.hostname = th.value left join tok_pids tp on cast(f.pid as varchar) = tp.value
    left join tok_users tu on f.u = tu.value left join tok_remote_hosts tr on f.r = tr.value left join tok_ips ti on f.r = ti.value left join tok_ips tip on f.ip = tip.value left join tok_remote_hosts trh on f.h = trh.value left join tok_commands tc on f.c = tc.value),
  masked as (select line_number, th as hostname, tp as pid, case when contains(message, 'authentication failure') then 'authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=' || tr || coalesce('  user=' || tu, '')
    when contains(message, 'session opened') then 'session opened for user ' || tu || ' by (uid=0)' when contains(message, 'session closed') then 'session closed for user ' || tu when contains(message, 'connection from') then 'connection from ' || tip || ' (' || coalesce(trh, '') || ') at noon'
    when contains(message, 'SNMP') then 'Received SNMP packet(s) from ' || tip when c is not null then replace(message, 'COMMAND=' || c, 'COMMAND=' || tc) else message end as message, timestamp, process, component from named)"""


@query(f"with {PARSED}, {_MASKED} select line_number, hostname, pid, message, timestamp || ' ' || hostname || ' ' || process || coalesce('(' || component || ')', '') || coalesce('[' || pid || ']', '') || ': ' || message as masked_log from masked")
def pseudonym_records(spark, d):
    return pseudonyms.pseudonymised(parsed_once(spark, d)).select("line_number", "hostname", "pid", "message", "masked_log")


_KINDS = ", ".join(f"(select count(*) from tok_{c}) as {c}" if c in (*_TOKENS, "commands") else f"0 as {c}" for c in pseudonyms.SYSLOG_PREFIX)
_SUM = " + ".join(f"(select count(*) from tok_{c})" for c in (*_TOKENS, "commands"))


@query(f"with {PARSED}, {_MASKED} select count(*) as records, 100.0::double as event_kept, 100.0::double as process_kept, round(100.0 * count(*) filter (m.message <> p.message) / count(*), 2) as message_changed, {_KINDS}, {_SUM} as values from masked m join parsed p using (line_number)")
def pseudonym_quality(spark, d):
    rows = parsed_once(spark, d)
    tokens = pseudonyms.dictionary(rows)
    return pseudonyms.masking_quality(rows, pseudonyms.pseudonymised(rows, tokens), tokens)


@query()
def pseudonym_kept_words(spark, d):
    rows = parsed_once(spark, d)
    return quality.kept_words(rows, pseudonyms.pseudonymised(rows))


def _canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """All records, each line once."""
    rows = table(spark, d, "canonical").dropDuplicates(["file_path", "line_number"])
    return rows.drop("received_at")


@query()
def pseudonym_canonical(spark, d):
    return pseudonyms.pseudonymised(_canonical_records(spark, d), canonical=True).select("record_id", "hostname", "pid", "event", "message", "masked_log")


@query()
def pseudonym_canonical_dictionary(spark, d):
    return pseudonyms.dictionary(_canonical_records(spark, d), canonical=True)


# --- corpus

_STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_KNOWN = "case when coalesce({0}, '') <> '' then {0} else 'unknown' end"
_PAIRS = "nullif(array_to_string(list_transform(list_filter(metadata, lambda m: coalesce(m.value, '') <> ''), lambda m: m.key || '=' || m.value), ' '), '')"
_TEXTS = {
    "message_only": _STRIP.format("message"),
    "process_message": f"{_KNOWN.format('process')} || ' : ' || {_STRIP.format('message')}",
    "event_message": f"{_KNOWN.format('event')} || ' : ' || {_STRIP.format('message')}",
    "full": f"concat_ws(' | ', {_KNOWN.format('process')}, {_KNOWN.format('event')}, {_PAIRS}, {_STRIP.format('message')})",
}
_ONCE = "once as (select file_path, line_number, any_value(process) as process, any_value(event) as event, any_value(message) as message, any_value(metadata) as metadata from structured group by all)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return structured(spark, d).dropDuplicates(["file_path", "line_number"])


@query(f"with {_ONCE} select file_path, line_number, " + ", ".join(f"{v} as {k}" for k, v in _TEXTS.items()) + " from once")
def corpus_renderings(spark, d):
    return corpus.renderings(_once(spark, d)).drop("raw_masked")


_STATS = rf"with {_ONCE}, t as (select {_TEXTS['full']} as x from once), w as (select unnest(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) as token from t where x <> ''), c as (select token, count(*) as n from w group by token)"


@query(_STATS + " select 'full' as rendering, (select count(*) from t where x <> '') as total_lines, cast(sum(n) as bigint) as total_tokens, count(*) as unique_tokens, count(*) filter (n < 5) as rare_tokens, round(sum(n) / (select count(*) from t where x <> ''), 2) as avg_tokens_per_line from c")
def vocab_stats(spark, d):
    return corpus.token_stats(corpus.renderings(_once(spark, d)), "full")


@query()
def vocab_reduction(spark, d):
    rows = parsed_once(spark, d)
    return corpus.vocabulary_reduction(rows, pseudonyms.pseudonymised(rows))


# --- windows, attacks, scores


def _corpus_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.renderings(parsed(spark, d)).select("file_path", "line_number", F.col("full").alias("line"))
    shared_folder(spark, "windows")
    # read several times by what follows: written once, where every executor can read it
    return windows.split_windows(windows.count_windows(lines).checkpoint())


_FULL = rf"""text_lines as (select line_number, process || ' | ' || event || coalesce(' | ' || nullif(concat_ws(' ', case when contains(message, 'authentication failure') then concat_ws(' ', 'uid=0', 'euid=0', 'tty=NODEVssh', 'rhost=' || {_RHOST}, 'user=' || nullif({_USER}, '')) end,
  case when contains(message, 'session opened') then 'uid=0 user=' || {_USER} end, case when contains(message, 'session closed') then 'user=' || {_USER} end, 'source_ip=' || {_IP}, case when contains(message, 'connection from') then 'source_host=' || nullif(trim(regexp_extract(message, '\(([^)]*)\)', 1)), '') end), ''), '') || ' | ' || message as line from parsed)"""
_WINDOWS = f"with {PARSED}, {_FULL}, ordered as (select line, line_number, row_number() over (order by line_number) - 1 as rank from text_lines), wins as (select rank // 10 as window_id, string_agg(line, chr(10) order by rank) as text, list(line order by rank) as lines from ordered group by 1 having count(*) = 10), parts as (select *, case when window_id < floor((select max(window_id) + 1 from wins) * (1 - 0.2::double)) then 'train' else 'test' end as part from wins)"


@query(_WINDOWS + " select window_id, part, text from parts")
def windows10(spark, d):
    return _corpus_windows(spark, d).select("window_id", "part", "text")


def _injected(name: str, f) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        w = _corpus_windows(spark, d)
        return w.select("window_id", F.array_join(f(F.col("lines"), F.size("lines")), "\n").alias("text"))

    QUERIES[name] = run


def _inject_sql(added: tuple[str, ...], before: int, after: int) -> str:
    extra = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in added) + "]"
    return _WINDOWS + f" select window_id, array_to_string(list_concat(list_concat(lines[1:{5 - before}], {extra}), lines[{5 + after + 1}:10]), chr(10)) as text from wins"


for _name, _f, _a in (("inject_brute_force", windows.inject_brute_force, (windows.BRUTE_FORCE, 2, 2)), ("inject_sudo_abuse", windows.inject_sudo_abuse, (windows.SUDO_ABUSE, 0, 1)), ("inject_abnormal_close", windows.inject_abnormal_close, (windows.ABNORMAL_CLOSE, 0, 1)), ("inject_remote_login", windows.inject_remote_login, (windows.REMOTE_LOGIN, 0, 1))):
    _injected(_name, _f)
    ORACLE[_name] = _inject_sql(*_a)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    parts = _corpus_windows(spark, d)
    scorer = anomaly.BigramScorer().fit(parts.filter("part = 'train'"))
    return scorer.score(windows.with_attacks(parts.filter("part = 'test'"))).checkpoint()


@query()
def window_scores(spark, d):
    return _scored(spark, d).select("window_id", "label", F.round("ppl", 6).alias("ppl"))


@query()
def anomaly_metrics(spark, d):
    scored = _scored(spark, d)
    return anomaly.metrics(anomaly.predicted(scored, anomaly.threshold(scored).select("threshold").scalar()))


#: a table with the columns of scored windows, to check thresholds and metrics against SQL
_AS_SCORES = "scores as (select l_orderkey * 10 + l_linenumber as window_id, l_extendedprice as ppl, case when l_discount > 0.08 then 1 else 0 end as label from lineitem), mid as (select median(ppl) as m from scores where label = 0), lim as (select m as median, (select median(abs(ppl - m)) from scores, mid where label = 0) as mad, m + 3.0 * (select median(abs(ppl - m)) from scores, mid where label = 0) as threshold from mid), said as (select s.*, case when ppl > threshold then 1 else 0 end as prediction, threshold from scores s, lim)"


def _as_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("window_id"), F.col("l_extendedprice").alias("ppl"), F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("label"))


@query(f"with {_AS_SCORES} select round(median, 6) as median, round(mad, 6) as mad, round(threshold, 6) as threshold from lim")
def mad_threshold(spark, d):
    t = anomaly.threshold(_as_scores(spark, d))
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query(f"with {_AS_SCORES}, n as (select count(*) filter (prediction = 1 and label = 1) as tp, count(*) filter (prediction = 1 and label = 0) as fp, count(*) filter (prediction = 0 and label = 1) as fn, count(*) filter (prediction = 0 and label = 0) as tn from said), r as (select *, case when tp + fp = 0 then 0.0::double else tp / (tp + fp)::double end as precision, case when tp + fn = 0 then 0.0::double else tp / (tp + fn)::double end as recall from n) select tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from r")
def confusion(spark, d):
    s = _as_scores(spark, d)
    m = anomaly.metrics(anomaly.predicted(s, anomaly.threshold(s).select("threshold").scalar()))
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _audit(kind: str, order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = _as_scores(spark, d)
        return anomaly.ranked_audit(s, kind, anomaly.threshold(s).select("threshold").scalar()).select("window_id", F.col("place").cast("bigint").alias("place"))

    QUERIES[f"audit_{kind}"] = run
    ORACLE[f"audit_{kind}"] = f"with {_AS_SCORES} select window_id, row_number() over (order by {order}, window_id) as place from said order by place limit 10"


for _kind, _order in (("top", "ppl desc"), ("bottom", "ppl"), ("boundary", "abs(ppl - threshold)")):
    _audit(_kind, _order)


@query(r"with m as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from documents) select doc_id, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) as n_words from m")
def document_words(spark, d):
    t = strip(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(corpus.tokens(t)).cast("bigint").alias("n_words"))

