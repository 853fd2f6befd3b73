"""Word lists and rules of severities and events, and the columns made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: severity words
SEVERITY = {
    "fatal": "CRITICAL", "emerg": "CRITICAL", "emergency": "CRITICAL", "alert": "CRITICAL", "crit": "CRITICAL", "critical": "CRITICAL", "severe": "CRITICAL", "panic": "CRITICAL",
    "error": "ERROR", "err": "ERROR", "fail": "ERROR", "failure": "ERROR",
    "warning": "WARN", "warn": "WARN",
    "notice": "INFO", "info": "INFO", "information": "INFO",
    "debug": "DEBUG", "trace": "DEBUG", "verbose": "DEBUG",
}
# fixed values: severity of a syslog priority modulo 8
PRIORITY = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
# fixed values: JSON keys by canonical field
ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp", "datetime", "date"),
    "severity": ("level", "severity", "loglevel", "log_level", "lvl", "priority"),
    "hostname": ("host", "hostname", "server", "node", "machine"),
    "process": ("process", "service", "app", "application", "logger", "source", "class"),
    "component": ("component", "module"),
    "message": ("message", "msg", "text", "body", "log", "description"),
}
FIELD_OF = {alias: field for field, names in ALIASES.items() for alias in names}


def severity(text: Column) -> Column:
    """Canonical severity of a word; unknown words give UNKNOWN, null gives null."""
    bare = F.regexp_replace(F.lower(text), r"^[\[\]() ]+|[\[\]() ]+$", "")
    pairs = [F.lit(x) for kv in SEVERITY.items() for x in kv]
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), bare), F.lit("UNKNOWN")))


def priority_severity(priority: Column) -> Column:
    """Canonical severity of a numeric syslog priority; anything else gives null."""
    number = priority.try_cast("int")
    rest = F.pmod(number, F.lit(8))
    return F.when(number.isNotNull(), F.get(F.array(*[F.lit(x) for x in PRIORITY]), rest.cast("int")))


def first_rule(rules: list[tuple[Column, str]], default: str = "unknown") -> Column:
    if not rules:
        return F.lit(default)
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise(default)
