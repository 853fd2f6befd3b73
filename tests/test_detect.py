import random
import time

import pytest

from timberline.operators import detect
from timberline.operators.formats import FORMATS, LineFormat, canonical, register_format

NAMES = [f.name for f in FORMATS]
LINES = "file_path string, line_number bigint, line string, _s string"


def frame(spark, lines, path="f"):
    return spark.createDataFrame([(path, n, x, "c") for n, x in enumerate(lines, 1)], LINES)


SAMPLES = {
    "bsd_syslog": "Jun  4 01:02:03 box app(x)[3]: went user=\"a b\" n=12 on",
    "rfc5424_syslog": '<165>1 2024-01-01T00:00:00Z box app 12 ID [a b="c"] text here',
    "apache_combined": '1.2.3.4 - bob [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 12 "" "agent"',
    "apache_error": "[Mon Jan 01 00:00:00 2024] [core:warn] [pid 5:tid 6] [client 1.2.3.4:5] text",
    "windows_event": "01/02/2024 1:02:03 AM Disk 12 Warning text",
    "hdfs_log": "240101 000000 12 INFO a.B: text",
    "bgl_log": "- 1704067200 2024.01.01 R0 x R0 RAS KERN FATAL text",
    "iso_syslog": "2024-01-01T00:00:00Z box app[3]: text",
    "generic_iso": "2024-01-01 00:00:00 [WARN] app[3] text",
    "key_value": "a=1 b=\"x y\" c",
}


@pytest.mark.parametrize("name", list(SAMPLES))
def test_each_format_is_detected(spark, name):
    got = detect.detected_formats(frame(spark, [SAMPLES[name]] * 5)).first()["format"]
    assert got == name
    scores = {r["format"]: r["score"] for r in detect.format_scores(frame(spark, [SAMPLES[name], "", "other"])).collect()}
    assert scores[name] == 0.5


def test_canonical_fields(spark):
    rows = [("f", i, SAMPLES[n], n) for i, n in enumerate(SAMPLES)]
    rows += [("f", 50, '{"Level": "error", "msg": null, "zeta": {"b": 1}, "host": "h", "app": "one", "logger": "two", "pid": 7}', "json")]
    rows += [("f", 51, "at 2024-01-01T00:00:00Z level=warn host=h x='y z'", "fallback"), ("f", 52, None, "fallback")]
    got = {r["line_number"]: r for r in canonical(spark.createDataFrame(rows, "file_path string, line_number bigint, line string, _format string")).collect()}
    by = {n: got[i] for i, n in enumerate(SAMPLES)}
    meta = lambda r: [(m["key"], m["value"], m["vtype"]) for m in r["metadata"]]
    s, i = "string", "int"
    r = by["bsd_syslog"]
    assert (r["hostname"], r["process"], r["component"], r["pid"], r["message"]) == ("box", "app", "x", "3", "went on")
    assert meta(r) == [("user", "a b", s), ("n", "12", i)]
    r = by["rfc5424_syslog"]
    assert (r["severity"], r["process"], r["hostname"], r["pid"], r["message"]) == ("INFO", "app", None, None, "text here")
    assert meta(r) == [("priority", "165", s), ("version", "1", s), ("host", "box", s), ("procid", "12", s), ("msgid", "ID", s), ("structured_data", '[a b="c"]', s)]
    r = by["apache_combined"]
    assert (r["host"], r["timestamp"], r["severity"]) == ("1.2.3.4", "01/Jan/2024:00:00:00 +0000", None)
    assert ("referrer", "", s) in meta(r) and ("status", "200", i) in meta(r) and ("user_agent", "agent", s) in meta(r)
    r = by["apache_error"]
    assert (r["severity"], r["pid"], r["message"], r["process"]) == ("WARN", "5", "text", None)
    assert (by["windows_event"]["process"], by["windows_event"]["timestamp"]) == ("Disk", None)
    assert (by["bgl_log"]["host"], by["bgl_log"]["process"], by["bgl_log"]["severity"]) == ("R0", "KERN", "CRITICAL")
    assert (by["generic_iso"]["process"], by["generic_iso"]["severity"], by["generic_iso"]["pid"]) == ("app", "WARN", "3")
    assert meta(by["key_value"])[0][0] == "full_line"
    r = got[50]
    assert (r["severity"], r["hostname"], r["process"], r["message"]) == ("ERROR", "h", "two", "")
    assert [m[:2] for m in meta(r)] == [("zeta", '{"b":1}'), ("pid", "7")]
    r = got[51]
    assert (r["timestamp"], r["severity"], r["hostname"]) == ("2024-01-01T00:00:00Z", "WARN", "h")
    assert meta(r)[0] == ("timestamp_format", "iso8601_tz", s) and meta(r)[1][2] == "json"
    assert got[52]["message"] == ""


def brute(masks, sample, limit):
    """Reads one file's lines in order: (line, what, parent) of each."""
    def choose(rows):
        return detect.choose([r[2] for r in rows], [r[3] for r in rows])

    fmt, json = None, False
    first = choose([r for r in masks if not r[0]][:sample])
    json, fmt = first == detect.JSON, first if first not in (None, detect.JSON) else None
    out, fails, last = {}, [], None

    def read(r):
        return "json" if json and r[4] else NAMES[fmt] if fmt is not None and r[2] >> fmt & 1 else None

    for n, r in enumerate(masks, 1):
        if r[0]:
            out[n] = ("blank", None)
        elif not fails and last is not None and r[1]:
            out[n] = ("cont", last)
        elif read(r):
            out |= {k: ("fallback", None) for k, _ in fails}
            fails, last = [], n
            out[n] = (read(r), None)
        else:
            fails.append((n, r))
            if len(fails) == limit:
                c = choose([x for _, x in fails])
                json = c == detect.JSON
                if c not in (None, detect.JSON):
                    fmt = c
                out |= {k: ((read(x) if c is not None else None) or "fallback", None) for k, x in fails}
                fails = []
    return out | {k: ("fallback", None) for k, _ in fails}


@pytest.mark.parametrize("seed", range(4))
def test_walk_against_a_plain_reader(spark, seed):
    r = random.Random(seed)
    pool = [SAMPLES["bsd_syslog"], SAMPLES["hdfs_log"], SAMPLES["iso_syslog"], '{"a": 1}', "{}", "junk", "  indented", "\tat x", "", "Jun  4 bad"]
    lines = [x for _ in range(40) for x in [r.choice(pool)] * r.choice((1, 2, 7, 12))]
    df = frame(spark, lines)
    masks = [tuple(x) for x in detect.line_masks(df).orderBy("line_number").drop("file_path", "line_number").collect()]
    want = brute(masks, 20, 10)
    got = {x["line_number"]: (x["resolved"], x["parent"]) for x in detect.resolve_lines(df.repartition(5)).collect()}
    assert got == want


def test_drift_and_continuations(spark):
    lines = [SAMPLES["bsd_syslog"]] * 30 + ["Traceback x", "  File y"] + ["junk words"] * 9 + [SAMPLES["bsd_syslog"]] * 2 + [SAMPLES["hdfs_log"]] * 12
    stats = detect.parse_stats(frame(spark, lines)).first()
    assert (stats["total_lines"], stats["multiline_continuations"], stats["failed_lines"], stats["format_redetections"], stats["replayed_lines"]) == (55, 2, 9, 1, 10)
    assert stats["formats_detected"] == "bsd_syslog,hdfs_log"
    got = {x["line_number"]: x for x in detect.parse_lines(frame(spark, lines)).collect()}
    assert got[30]["message"] == "went on\nTraceback x\nFile y" and 31 not in got
    assert got[33]["_format"] == "fallback" and got[55]["process"] == "a.B"


def test_odd_lines(spark):
    long = 'a="' + "x" * 100_000 + '" b=1'
    df = frame(spark, [None, "", long, "k=" * 20_000, "a=1 " * 20_000, " ", "[" * 50_000])
    assert detect.parse_lines(df).count() == 4
    assert detect.detected_formats(frame(spark, [])).count() == 0
    assert detect.parse_lines(frame(spark, [])).count() == 0


def test_json_vote_and_key_value_rule():
    kv, other = 1 << NAMES.index("key_value"), 1 << NAMES.index("generic_iso")
    assert detect.choose([0] * 10, [True] * 7 + [False] * 3) == detect.JSON
    assert detect.choose([kv] * 7 + [kv | other] * 3, [False] * 10) is None
    assert detect.name_of(detect.choose([kv] * 10, [False] * 10)) == "key_value"
    assert detect.choose([], []) is None


def test_provided_and_registered_formats(spark):
    fmt = detect.provided_format(["x|a|b", "y|c|d"], lambda lines: "```\n^(?P<service>\\w+)\\|(?P<rest>\\w+)\\|\\w+$\n```")
    assert (fmt.groups, fmt.field_map, fmt.priority) == (("service", "rest"), {"service": "process"}, 20)
    assert detect.provided_format(["x"], lambda lines: "(") is None
    assert detect.provided_format(["x"], lambda lines: None) is None
    before = list(FORMATS)
    try:
        register_format(LineFormat("pipes", r"^(\w+)\|(\w+)\|(.*)$", ("app", "kind", "message"), 20, {"app": "process"}))
        assert detect.detected_formats(frame(spark, ["x|a|b"] * 3)).first()["format"] == "pipes"
        assert detect.parse_lines(frame(spark, ["x|a|b c"])).first()["process"] == "x"
    finally:
        FORMATS[:] = before


def test_long_lines_keep_their_format(spark):
    long = "Jun  4 01:02:03 box app[3]: went " + "x" * 70_000 + " n=12 end"
    r = canonical(frame(spark, [long]).withColumn("_format", detect.F.lit("bsd_syslog"))).first()
    assert detect.detected_formats(frame(spark, [long] * 3)).first()["format"] == "bsd_syslog"
    assert (r["process"], r["pid"], r["message"]) == ("app", "3", "went " + "x" * 70_000 + " end")
    assert [tuple(m) for m in r["metadata"]] == [("n", "12", "int")]


def test_hostile_lines_end_in_time(spark):
    heads = ["a b c [t] \"G x", "[t] [", "Jun  4 01:02:03 box app", "2024-01-01T00:00:00Z ", "<1>1 a b c d e [", "a=b c=", ""]
    lines = [h + fill * (70_000 // len(fill)) + tail for h in heads for fill in (" ", "a", "[", "a ", '"', "=", "; ", "1") for tail in ("x", '" 200 x', '" 20 x', ": x", '"')]
    started = time.time()
    df = frame(spark, lines).repartition(4)
    detect.format_scores(df).collect()
    rows = df.withColumn("_format", detect.F.expr("array('bsd_syslog', 'apache_combined', 'generic_iso', 'key_value')[line_number % 4]"))
    canonical(rows).agg(detect.F.sum(detect.F.length("message"))).collect()
    assert time.time() - started < 90


def test_proposed_formats_are_registered_for_files_that_none_fits(spark):
    odd = frame(spark, [f"@@ {i} >> text {i}" for i in range(30)], "odd")
    asked = []

    def provider(sample):
        asked.append(len(sample))
        return r"@@ (?P<pid>\d+) >> (?P<message>.+)"

    before = list(FORMATS)
    try:
        names = detect.register_provided(odd.unionByName(frame(spark, [SAMPLES["hdfs_log"]] * 5, "known")), provider)
        assert (names, asked) == (["provided_0"], [10])
        assert {r["format"] for r in detect.detected_formats(odd).collect()} == {"provided_0"}
    finally:
        FORMATS[:] = before
    assert detect.register_provided(odd, lambda sample: None) == []
