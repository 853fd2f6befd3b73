import pytest
from pyspark.sql import functions as F

from timberline.functions import events
from timberline.functions.text import strip
from timberline.functions.vocab import priority_severity, severity
from timberline.operators import pseudonyms, quality, syslog

LINES = [
    "Jun  4 01:02:03 box sshd(pam_unix)[19]: authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=10.0.0.5  user=root",
    "Jun  4 01:02:04 box su(pam_unix)[20]: session opened for user eve by (uid=0)",
    "Jun  4 01:02:05 box su(pam_unix)[20]: session opened for user  by (uid=0)",
    "Jun  4 01:02:06 box ftpd[21]: connection from 10.0.0.6 (far.example.net) at noon",
    "Jun  4 01:02:07 box ftpd[22]: connection from 10.0.0.5 () at noon",
    "Jun  4 01:02:08 box syslogd 1.4.1: restart.",
    "Jun 99 99:99:99 other logrotate: ALERT exited abnormally with [1]",
    "2024-06-04T01:02:03.5+02:00 other (sd-pam)[7]: x Accepted",
    "2024-06-04T01:02:03Z other cron[7]: no such zone",
    "",
    "   ",
    None,
    "no structure at all",
    "Jun  4 01:02:09 box exim4/smtp[3]: slash",
    "Jun  4 01:02:10 box sudo: eve : TTY=pts/0 ; USER=root ; COMMAND=/bin/cat 10.0.0.6",
    "Jun  4 01:02:11 other snmpd[00123]: Received SNMP packet(s) from 10.0.0.5",
    "Jun  4 01:02:12 box sshd[9]: rhost= user= x",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("f", n, x, "c") for n, x in enumerate(LINES, 1)], "file_path string, line_number bigint, line string, _m string").cache()


def test_records(lines):
    got = {r["line_number"]: r for r in syslog.parse_syslog(lines).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 17]
    meta = lambda n: [(m["key"], m["value"], m["vtype"]) for m in got[n]["metadata"]]
    s = "string"
    assert meta(1) == [("logname", "", s), ("uid", "0", "int"), ("euid", "0", "int"), ("tty", "ssh", s), ("ruser", "", s), ("rhost", "10.0.0.5", s), ("user", "root", s)]
    assert meta(2) == [("uid", "0", "int"), ("user", "eve", s)]
    assert meta(3) == [("uid", "0", "int"), ("user", "by", s)]
    assert meta(4) == [("source_ip", "10.0.0.6", s), ("source_host", "far.example.net", s)]
    assert meta(5) == [("source_ip", "10.0.0.5", s)]
    assert (got[6]["process"], got[6]["message"], got[6]["event"]) == ("syslogd", "restart.", "service_restart")
    assert (got[7]["component"], got[7]["pid"], got[7]["event"]) == (None, None, "abnormal_exit")
    assert (got[8]["process"], got[8]["component"], got[8]["pid"]) == ("(sd-pam)", None, 7)
    assert got[16]["pid"] == 123
    assert meta(17) == [("rhost", "", s), ("user", "", s)]


def test_summary_and_rejected(lines):
    r = syslog.parse_summary(lines).first()
    assert (r["total_lines"], r["parsed_lines"], r["rejected_lines"], r["parse_rate"]) == (17, 11, 6, 64.71)
    assert r["hosts"] == "box,other"
    assert [x["line_number"] for x in syslog.rejected_lines(lines, 2).collect()] == [9, 10]
    assert syslog.rejected_lines(lines, None).count() == 6
    assert syslog.parse_summary(lines.limit(0)).first()["parse_rate"] == 0.0


def test_pseudonyms_in_order_of_appearance(spark, lines):
    records = syslog.parse_syslog(lines)
    tokens = pseudonyms.dictionary(records).cache()
    names = {(r["category"], r["value"]): r["token"] for r in tokens.collect()}
    assert names["hosts", "box"] == "HOST_001" and names["hosts", "other"] == "HOST_002"
    assert names["users", "root"] == "USER_001" and names["users", "eve"] == "USER_002" and names["users", "by"] == "USER_003"
    assert names["users", ""] == "USER_004"
    assert names["ips", "10.0.0.5"] == "IP_001" and names["ips", "10.0.0.6"] == "IP_002"
    assert names["remote_hosts", "far.example.net"] == "REMOTE_HOST_001"
    assert names["commands", "/bin/cat 10.0.0.6"] == "CMD_001"
    masked = {r["line_number"]: r for r in pseudonyms.pseudonymised(records, tokens).collect()}
    assert masked[1]["masked_log"] == "Jun  4 01:02:03 HOST_001 sshd(pam_unix)[PID_001]: authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=IP_001  user=USER_001"
    assert masked[3]["message"] == "session opened for user  USER_003 (uid=0)"
    assert masked[5]["message"] == "connection from IP_001 () at noon"
    assert masked[15]["message"] == "eve : TTY=pts/0 ; USER=root ; COMMAND=CMD_001"
    assert masked[15]["pid"] is None
    again = pseudonyms.dictionary(syslog.parse_syslog(lines.repartition(7)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tokens.collect()))
    assert "raw_log" not in pseudonyms.pseudonymised(records, tokens, keep_raw=False).columns
    q = pseudonyms.masking_quality(records, pseudonyms.pseudonymised(records, tokens), tokens).first()
    assert (q["records"], q["event_kept"], q["process_kept"], q["hosts"], q["commands"]) == (11, 100.0, 100.0, 2, 1)
    kept = {r["word"]: r["rate"] for r in quality.kept_words(records, pseudonyms.pseudonymised(records, tokens)).collect()}
    assert set(kept.values()) == {100.0}


def test_numbers_widen(spark):
    df = spark.createDataFrame([("f", n, f"Jun  4 01:02:03 h{n} cron: text") for n in range(1, 1002)], "file_path string, line_number bigint, line string")
    tokens = {r["value"]: r["token"] for r in pseudonyms.dictionary(syslog.parse_syslog(df)).collect()}
    assert (tokens["h9"], tokens["h1000"], tokens["h1001"]) == ("HOST_009", "HOST_1000", "HOST_1001")


def test_canonical_pseudonyms(spark):
    meta = lambda **kw: [(k, v, "string") for k, v in kw.items()]
    rows = [
        ("f", 1, "box", "22", "session opened for user bob", meta(user="x"), "22 box session opened for user bob", "e"),
        ("f", 2, None, None, "failed from 1.2.3.4 port 22, 22 tries by bob", meta(user="bob", rhost="1.2.3.4"), "raw 22", "e"),
        ("f", 3, "box", None, None, [], None, None),
    ]
    df = spark.createDataFrame(rows, "file_path string, line_number bigint, hostname string, pid string, message string, metadata array<struct<key:string,value:string,vtype:string>>, raw_log string, event string")
    got = {r["line_number"]: r for r in pseudonyms.pseudonymised(df, canonical=True).collect()}
    assert got[1]["message"] == "session opened for user USER_001" and got[1]["masked_log"] == "PID_001 HOST_001 session opened for user USER_001"
    assert got[1]["event"] == "session_opened" and got[1]["metadata"][0]["value"] == "USER_001"
    assert got[2]["message"] == "failed from REMOTE_HOST_001 port PORT_001, PORT_001 tries by USER_001" and got[2]["masked_log"] == "raw PORT_001"
    assert (got[3]["message"], got[3]["hostname"]) == ("", "HOST_001")


def test_vocabularies(spark):
    df = spark.createDataFrame([("[WARN] ", "9"), ("odd", "191"), (None, "x"), ("emerg", "0")], "s string, p string")
    got = [tuple(r) for r in df.select(severity(F.col("s")), priority_severity(F.col("p"))).collect()]
    assert got == [("WARN", "CRITICAL"), ("UNKNOWN", "DEBUG"), (None, None), ("CRITICAL", "CRITICAL")]
    texts = ["SUDO ran COMMAND=/x", "password check failed; exited abnormally", "authentication failed", "Removed session 3", "Disconnected from x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert [r[0] for r in df.select(events.derived_event(F.col("m"))).collect()] == ["sudo_command", "authentication_failure", "unknown", "removed_session", "session_closed", "unknown"]
    assert [r[0] for r in df.select(events.masked_event(F.col("m"))).collect()] == ["unknown", "abnormal_exit", "unknown", "removed_session", "session_closed", "unknown"]
    assert spark.range(1).select(strip(F.lit(" \t x 　\n"))).first()[0] == "x"
