"""Line formats, and the canonical record that each of them becomes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.events import derived_event
from timberline.functions.stage import staged
from timberline.functions.text import META_TYPE, captures, fold, no_pairs, pair, strip
from timberline.functions.vocab import FIELD_OF, priority_severity, severity

CANONICAL = ("timestamp", "hostname", "process", "component", "pid", "message")


@dataclass(frozen=True)
class LineFormat:
    """``groups`` name the pattern's groups in order; '' is a group that only shows its neighbour took part."""

    name: str
    pattern: str
    groups: tuple[str, ...]
    priority: int
    field_map: dict[str, str] = field(default_factory=dict)
    severity_from: str | None = None
    can_be_empty: tuple[str, ...] = ()
    needs: str | None = None


_TAG = r"([A-Za-z0-9_\-.]+)(?:\(([^)]+)\))?(?:\[(\d+)\])?:\s*(.+)$"
_ISO = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?)\s+"
_SYSLOG = ("timestamp", "hostname", "process", "component", "pid", "message")
_HEAD = "(?d)(?U)^"
KEY = r"[a-zA-Z_][a-zA-Z0-9_\-.]*"
_VALUE = r"(?:\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^\s)\]]*+)"

# fixed values: the line formats, in the order of detection; a lookahead or a possessive quantifier only saves retries
FORMATS: list[LineFormat] = [
    LineFormat("bsd_syslog", _HEAD + r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+" + _TAG, _SYSLOG, 10),
    LineFormat(
        "rfc5424_syslog", _HEAD + r"<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*((?:\[[^\]]*+\])*+|-)\s*(.*)$",
        ("priority", "version", "timestamp", "host", "app", "procid", "msgid", "structured_data", "message"), 15, {"app": "process"}, "priority", ("structured_data", "message"),
    ),
    LineFormat(
        "apache_combined", _HEAD + r"(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+\"(\S+)\s+(\S+)(?=\s[^\"]*+\"\s++\d{3}\s++\S)\s+([^\"]+)\"\s+(\d{3})\s+(\S+)(\s+\"([^\"]*)\")?\s*(\"([^\"]*)\")?.*$",
        ("remote_host", "ident", "user", "timestamp", "method", "path", "protocol", "status", "bytes", "", "referrer", "", "user_agent"), 12, {"remote_host": "host"}, None, ("referrer", "user_agent"),
    ),
    LineFormat(
        "apache_error", _HEAD + r"\[([^\]]+)\]\s+\[(?:([^:\]]+):)?([^\]]*)\]\s*(?:\[pid\s+(\d+)[^\]]*\]\s*)?(?:\[client\s+([^\]]+)\]\s*)?(.+)$",
        ("timestamp", "module", "level", "pid", "client", "message"), 11, {}, "level", ("level",),
    ),
    LineFormat(
        "windows_event", _HEAD + r"(\d{2}/\d{2}/\d{4})\s+(\d{1,2}:\d{2}:\d{2}\s+[AP]M)\s+(\S+)\s+(\d+)\s+(\S+)\s+(.+)$",
        ("date", "time", "source", "event_id", "level", "message"), 8, {"source": "process"}, "level",
    ),
    LineFormat("hdfs_log", _HEAD + r"(\d{6}\s+\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s*(.+)$", ("timestamp", "pid", "level", "component", "message"), 9, {"component": "process"}, "level"),
    LineFormat(
        "bgl_log", _HEAD + r"(\S+)\s+(\d{10}(?:\.\d+)?)\s+(\d{4}\.\d{2}\.\d{2})\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$",
        ("label", "timestamp", "date", "node", "time", "node_rep", "type", "component", "level", "message"), 7, {"node": "host", "component": "process"}, "level", ("message",),
    ),
    LineFormat("iso_syslog", _HEAD + _ISO + r"(\S+)\s+" + _TAG, _SYSLOG, 8),
    LineFormat(
        "generic_iso", _HEAD + _ISO + r"(?:\[?([A-Z]{2,8})\]?\s+)?(?:([A-Za-z0-9_.\-]+)(?:\[(\d+)\])?[:\s]+)?(.+)$",
        ("timestamp", "level", "component", "pid", "message"), 5, {"component": "process"}, "level",
    ),
    # two leading pairs decide: anything may follow
    LineFormat("key_value", rf"{_HEAD}({KEY}=(?:\"[^\"]*+\"|\S+)\s*{KEY}=(?:\"[^\"]*+\"|\S+).*)$", ("full_line",), 1, needs="="),
]

# fixed values: patterns of time stamps looked for in unparsed lines, in order
SNIFF = (
    ("iso8601_tz", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)"),
    ("iso8601", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?"),
    ("bsd_syslog", r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"),
    ("clf", r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]"),
    ("windows", r"\d{2}/\d{2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}(?:\s+[AP]M)?"),
    ("epoch", r"^\d{10}(?:\.\d+)?"),
    ("generic_datetime", r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}"),
)
CONTINUATION = r"^(?:\s|at\s+|Caused by:|\.\.\.|File\s+\"|Traceback|\||#\d+|---)"
PAIRS = rf"(?U)(?<![^\s;])({KEY})=({_VALUE})"


def register_format(fmt: LineFormat) -> None:
    """Adds a format, or replaces the one of the same name."""
    FORMATS[:] = [f for f in FORMATS if f.name != fmt.name] + [fmt]


def fits(line: Column, fmt: LineFormat) -> Column:
    """Whether a stripped line has the format."""
    test = line.rlike(fmt.pattern)
    if fmt.needs:
        test = (F.length(line) - F.length(F.replace(line, F.lit(fmt.needs), F.lit(""))) >= 2) & test
    return test


def sniff(line: Column) -> tuple[Column, Column]:
    """The first time stamp in the first 60 characters, and the name of its pattern; null without one."""
    head = F.substring(line, 1, 60)
    found = [F.nullif(F.regexp_extract(head, p, 0), F.lit("")) for _, p in SNIFF]
    name = F.coalesce(*[F.when(f.isNotNull(), F.lit(n)) for f, (n, _) in zip(found, SNIFF, strict=True)])
    return F.coalesce(*found), name


def continues(line: Column) -> Column:
    """Whether an unstripped line looks like the continuation of an entry."""
    return line.rlike(CONTINUATION) & sniff(line)[0].isNull()


def json_object(line: Column) -> Column:
    """The keys of a line that is a JSON object, in order; null for any other line."""
    return F.when(line.startswith("{") & F.try_parse_json(line).isNotNull(), F.json_object_keys(line))


def _unquoted(v: Column) -> Column:
    quoted = (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
    return F.when(quoted, F.when(F.length(v) >= 2, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise("")).otherwise(v)


def found_pairs(text: Column, numbers: bool) -> Column:
    """key=value pairs of a text in order, unquoted; all-digit values as numbers if asked for."""

    def item(k: Column, v: Column) -> Column:
        bare = _unquoted(v)
        whole = bare.rlike(r"^\d+$") if numbers else F.lit(False)
        return pair(k, F.when(whole, F.coalesce(bare.try_cast("decimal(38,0)").cast("string"), bare)).otherwise(bare), F.when(whole, "int").otherwise("string"))

    return F.zip_with(F.regexp_extract_all(text, F.lit(PAIRS), 1), F.regexp_extract_all(text, F.lit(PAIRS), 2), item)


def _by_format(values: dict[str, Column], default: Column) -> Column:
    out = None
    for name, v in values.items():
        out = F.when(F.col("_format") == name, v) if out is None else out.when(F.col("_format") == name, v)
    return default if out is None else out.otherwise(default)


def canonical(lines: DataFrame) -> DataFrame:
    """Canonical records of (file_path, line_number, line, _format).

    ``_format`` names a registered format that the line has, ``json`` or ``fallback``. Columns: those of
    the line, timestamp, severity, hostname, host, process, component, pid, message, event, metadata and
    raw_log. Null lines count as empty ones.
    """
    null = F.lit(None).cast("string")
    df = staged(lines, {"raw_log": strip(F.coalesce(F.col("line"), F.lit("")))})
    df = staged(df, {"_m": _by_format({f.name: captures(F.col("raw_log"), f.pattern, len(f.groups)) for f in FORMATS}, F.lit(None).cast("array<string>"))})
    m = F.col("_m")
    fields: dict[str, dict[str, Column]] = {c: {} for c in (*CANONICAL, "host", "severity")}
    metas: dict[str, Column] = {}
    for f in FORMATS:
        items = []
        for i, g in enumerate(f.groups):
            if not g:
                continue
            value = m[i]
            if g in f.can_be_empty:
                value = F.when(m[i - 1] != "", m[i]) if f.groups[i - 1] == "" else m[i]
            else:
                value = F.when(m[i] != "", m[i])
            target = f.field_map.get(g, g)
            if target in fields and g not in ("severity",) and (g in f.field_map or g in CANONICAL):
                fields[target][f.name] = value
            else:
                items.append(F.when(value.isNotNull(), pair(g, value)))
            if g == f.severity_from:
                fields["severity"][f.name] = priority_severity(m[i]) if g == "priority" else severity(value)
        metas[f.name] = F.array_compact(F.array(*items)) if items else no_pairs()
    cols = {c: _by_format(v, null) for c, v in fields.items()} | {"metadata": _by_format(metas, no_pairs()).cast(META_TYPE)}
    df = staged(df, cols)
    digits = F.col("pid").try_cast("decimal(38,0)").cast("string")
    df = staged(df, {"pid": F.coalesce(digits, F.col("pid")), "_text": F.when(F.coalesce(F.col("message"), F.lit("")) != "", F.col("message")).otherwise(F.array_join(F.transform("metadata", lambda x: F.concat(x["key"], F.lit("="), x["value"])), " "))})
    known = F.col("_format").isin([f.name for f in FORMATS])
    df = staged(df, {"_kv": F.when(known & F.col("_text").contains("="), found_pairs(F.col("_text"), True)).otherwise(no_pairs())})
    lifted = F.regexp_replace(F.trim(F.regexp_replace(F.col("_text"), PAIRS, ""), F.lit(" ;:,")), r"(?U)\s+", " ")
    text = F.when(F.size("_kv") > 0, strip(lifted)).otherwise(F.col("_text"))
    df = staged(df, {"message": F.when(known, text).otherwise(F.col("message")), "metadata": F.when(F.size("_kv") > 0, fold(F.col("_kv"), F.col("metadata"))).otherwise(F.col("metadata"))})
    df = _json_rows(df)
    df = _fallback_rows(df)
    df = df.withColumn("message", F.coalesce("message", F.lit(""))).withColumn("event", derived_event(F.col("message")))
    keep = [c for c in lines.columns if c not in ("line", "_format")]
    return df.select(*keep, "timestamp", "severity", "hostname", "host", "process", "component", "pid", "message", "_format", "event", "metadata", "raw_log")


def _json_rows(df: DataFrame) -> DataFrame:
    """Fields of JSON lines: keys through the aliases, later ones over earlier ones; the rest is metadata."""
    is_json = F.col("_format") == "json"
    values = F.from_json(F.col("raw_log"), "map<string,string>")
    keys = F.json_object_keys(F.col("raw_log"))
    items = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.lower(k).alias("low"), F.try_element_at(values, k).alias("value")))
    df = staged(df, {"_json": F.when(is_json, items)})
    cols: dict[str, Column] = {}
    for target in ("timestamp", "severity", "hostname", "process", "component", "message"):
        names = [a for a, t in FIELD_OF.items() if t == target]
        last = F.try_element_at(F.filter("_json", _aliased(names)), F.lit(-1))["value"]
        cols[target] = F.when(is_json, severity(last) if target == "severity" else last).otherwise(F.col(target))
    rest = F.transform(F.filter("_json", lambda x: ~x["low"].isin(list(FIELD_OF))), lambda x: pair(x["key"], x["value"], "json"))
    return staged(df, cols | {"metadata": F.when(is_json, rest).otherwise(F.col("metadata"))})


def _aliased(names: list[str]):
    return lambda x: x["low"].isin(names)


def _fallback_rows(df: DataFrame) -> DataFrame:
    """Unparsed lines: the whole line as message, a time stamp if one is near the start, and pairs."""
    plain = ~F.coalesce(F.col("_format").isin([*(f.name for f in FORMATS), "json"]), F.lit(False))
    stamp, name = sniff(F.col("raw_log"))
    df = staged(df, {"_ts": F.when(plain, stamp), "_tn": F.when(plain, name), "_kv": F.when(plain & F.col("raw_log").contains("="), fold(found_pairs(F.col("raw_log"), False))).otherwise(no_pairs())})
    many = F.size("_kv") >= 2
    nested = F.to_json(F.map_from_entries(F.transform("_kv", lambda x: F.struct(x["key"], x["value"]))))
    meta = F.array_compact(F.array(F.when(F.col("_ts").isNotNull(), pair("timestamp_format", F.col("_tn"))), F.when(many, pair("fields", nested, "json"))))
    cols: dict[str, Column] = {"message": F.when(plain, F.col("raw_log")).otherwise(F.col("message")), "metadata": F.when(plain, meta).otherwise(F.col("metadata"))}
    for target in ("timestamp", "severity", "hostname", "process", "component"):
        first = F.try_element_at(F.filter("_kv", _first_alias([a for a, t in FIELD_OF.items() if t == target])), F.lit(1))["value"]
        mine = F.when(many, severity(first) if target == "severity" else first)
        cols[target] = F.when(plain, F.coalesce(F.col("_ts"), mine) if target == "timestamp" else mine).otherwise(F.col(target))
    return staged(df, cols)


def _first_alias(names: list[str]):
    return lambda x: F.lower(x["key"]).isin(names)
