"""Normalised event names of messages: three ordered rule lists, the first match counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.vocab import first_rule

# fixed values: case-sensitive texts of syslog messages and their events
SYSLOG_RULES = (
    ("authentication failure", "authentication_failure"),
    ("Failed password", "authentication_failure"),
    ("check pass", "check_pass"),
    ("session opened", "session_opened"),
    ("session closed", "session_closed"),
    ("ALERT exited abnormally", "abnormal_exit"),
    ("connection from", "connection"),
    ("startup succeeded", "service_started"),
    ("shutdown succeeded", "service_stopped"),
    ("restart", "service_restart"),
    ("Received SNMP", "snmp_received"),
    ("timed out", "timeout"),
    ("Accepted", "authentication_success"),
    ("user NOT in sudoers", "sudo_denied"),
    ("COMMAND=", "sudo_command"),
)


def syslog_event(message: Column) -> Column:
    return first_rule([(F.contains(message, F.lit(text)), event) for text, event in SYSLOG_RULES])


def _has(text: Column, *words: str) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _rules(message: Column, exit_first: bool, sudo_in: Column) -> list[tuple[Column, str]]:
    low = F.lower(message)
    check, left = (_has(low, "password check failed"), "authentication_failure"), (_has(low, "exited abnormally"), "abnormal_exit")
    return [
        (_has(low, "session opened"), "session_opened"),
        (_has(low, "session closed"), "session_closed"),
        (_has(low, "authentication failure", "failure; logname="), "authentication_failure"),
        *([left, check] if exit_first else [check]),
        (_has(low, "accepted password", "accepted publickey"), "authentication_success"),
        *([] if exit_first else [left]),
        (_has(low, "disconnected from"), "session_closed"),
        (_has(sudo_in, "sudo") & (_has(message, "COMMAND=") | _has(low, "command")), "sudo_command"),
        (_has(low, "started", "starting"), "service_started"),
        (_has(low, "failed") & ~_has(low, "authentication"), "service_failed"),
        (_has(low, "stopped", "stopping"), "service_stopped"),
        (_has(low, "new session"), "new_session"),
        (_has(low, "removed session", "session removed"), "removed_session"),
    ]


def derived_event(message: Column) -> Column:
    """Event of a canonical record."""
    return first_rule(_rules(message, False, F.lower(message)))


def masked_event(message: Column) -> Column:
    """Event that pseudonymisation derives again, by slightly other rules."""
    return first_rule(_rules(message, True, message))
