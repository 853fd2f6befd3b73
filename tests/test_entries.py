import random

import pytest

from timberline.operators.entries import entries_of_lines, entries_of_texts, json_fields, pairs, scan

from .conftest import rows

LINES = "file_path string, line_number bigint, line string, chunk string"


@pytest.mark.parametrize(
    ("line", "level", "process", "component"),
    [
        ("Jun  4 01:11:28 box sshd(pam)[77]: hello", "", "sshd", "pam"),
        ("Jun 14 01:11:28 box syslogd 1.4.1: restart.", "", "syslogd", None),
        ("<13>Jun 14 01:11:28 box su: x", "INFO", "su", None),
        ('<11>1 2023-01-01T00:00:00Z box app 12 - [a b="]"] text', "ERROR", "app", None),
        ("2023-01-01T00:00:00Z box cron[3]: run", "", "cron", None),
        ("2023-01-01 00:00:00,123 WARN  [pool 1] net.a.B$C - text - more", "WARN", "net.a.B$C", None),
        ("2023-01-01 00:00:00 - a.b - CRITICAL - text", "CRITICAL", "a.b", None),
        ("2023-01-01T00:00:00.1 [NOTICE] api[3]: text", "INFO", "api", None),
        ("2023-01-01T00:00:00.1 FATAL api: text", "CRITICAL", "api", None),
        ("[2023/01/01 00:00:00] [Error] poller: x", "ERROR", "poller", None),
        ("[Sun Jan 01 00:00:00.5 2023] [core:warn] [pid 3:tid 4] [client 1.2.3.4:5] x", "WARN", "core", None),
        ("01/02/2023 1:02:03 AM Disk 12 Information x", "INFO", "Disk", None),
        ("230101 000000 12 DEBUG a.B: x", "DEBUG", "a.B", None),
        ("- 1672531200 2023.01.01 R0 2023-01-01-00.00.00.1 R0 RAS KERN FATAL x y", "CRITICAL", "KERN", None),
        ('time=2023-01-01T00:00:00Z level=err service="a b" msg="x = y"', "ERROR", "a b", None),
        ('{"ts": 1672531200, "lvl": "warn", "app": "a/b", "msg": "x"}', "WARN", "a/b", None),
    ],
)
def test_headers(line, level, process, component):
    e = scan(line + "\r")
    assert (e.level, e.process, e.component) == (level, process, component)


@pytest.mark.parametrize("line", ["", "   ", "  at a.b(C.java:1)", "> 2023-01-01 00:00:00 x: quoted", " 2023-01-01 00:00:00 x", "Caused by: x", "00000010  61 62", "level=info is the default", "}", '"level": "warn",', "| a | b |", "2023-01-01", "1672531200", "words only", "<x>1 2023", "x" * 200_000])
def test_lines_without_a_header(line):
    assert scan(line) is None


def test_damaged_json_gives_what_can_be_read():
    assert json_fields('{"level": "warn", "n": {"level": "x"}, "app": "a\\"b", "msg": "cut of') == {"level": "warn", "app": 'a"b', "msg": "cut of"}


def test_pairs():
    assert pairs("a=1 b=\"x \\\" y\" c='z'; d=") == [("a", "1"), ("b", 'x " y'), ("c", "z"), ("d", "")]
    assert pairs("no pair") is None


FILE = [
    "  tail of an older entry",
    "Jun  4 01:11:28 box su: one",
    "\tat a.b",
    "",
    "Caused by: c",
    "   ",
    "{",
    ' "level": "warn",',
    "",
    ' "app": "x",',
    ' "msg": "m"',
    "}",
    "after it",
    "Jun  4 01:11:29 box su: two\r",
    "",
]


def brute(lines):
    """(first, last) of each entry, reading one file in order."""
    out = []
    for n, line in enumerate(lines, 1):
        if scan(line) is not None:
            out.append([n, n])
        elif out and line.strip():
            out[-1][1] = n
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 100])
def test_entries(spark, chunk):
    data = [("f", n, x, "c") for n, x in enumerate(FILE, 1)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([*data, *data[:5], ("g", 1, None, None), (None, 1, FILE[1], None), ("g", None, FILE[1], None)], LINES)
    got = entries_of_lines(df, chunk).orderBy("line_number").collect()
    assert [(r["line_number"], r["last_line"]) for r in got] == brute(FILE)
    assert [(r["level"], r["process"]) for r in got] == [("", "su"), ("WARN", "x"), ("", "su")]
    assert got[0]["message"] == "one\n\tat a.b\n\nCaused by: c"


def test_texts_and_empty(spark):
    df = spark.createDataFrame([("f", 4, "2023-01-01 00:00:00 - a - INFO - x\n  more\n", "k"), ("f", 4, "2023-01-01 00:00:00 - a - INFO - x\n  more\n", "k"), ("f", 9, None, "k")], "file_path string, line_number int, raw_log string, text string")
    assert rows(entries_of_texts(df, "raw_log").select("line_number", "last_line", "level", "process")) == [(4, 5, "INFO", "a"), (9, 9, "", None)]
    assert entries_of_lines(spark.createDataFrame([], LINES)).count() == 0
