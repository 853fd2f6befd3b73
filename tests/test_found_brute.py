"""The queries on instants and sessions against a plain reader of whole small tables."""

import os
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

import __spark_entry__ as e

SMALL = os.environ.get("BRUTE_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FORMS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%a %b %d %H:%M:%S %Y", "%m/%d/%Y %I:%M:%S %p", "%y%m%d %H%M%S", "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S")


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def reading(text, opened, zone):
    """(naive wall clock, stated UTC offset or abbreviation or None, microseconds of fraction, has fraction) or None."""
    t = re.sub(r"\s+", " ", (text or "").strip(" \t[]"))
    if re.fullmatch(r"\d{10}(\.\d+)?|\d{13}|\d{16}", t):
        whole, _, frac = t.partition(".")
        us = int(whole) * {10: 10**6, 13: 10**3, 16: 1}[len(whole)] + int((frac + "000000")[:6])
        return EPOCH + timedelta(microseconds=us)
    m = re.fullmatch(r"(.*?\d{1,2}:?\d\d:?\d\d(?: [AP]M)?)(?:[.,](\d+))?((?: \d{4})?) ?(Z|[+-]\d\d:?\d\d|[A-Z]{3,4})?", t, re.I)
    if not m:
        return None
    body, frac, year, zoned = m[1] + m[3], m[2] or "", m[3], m[4]
    wall = None
    for f in FORMS:
        try:
            wall = datetime.strptime(body, f)
            break
        except ValueError:
            pass
    if wall is None and re.fullmatch(r"[A-Za-z]{3} \d{1,2} \d\d:\d\d:\d\d", body):
        first = opened.replace(tzinfo=UTC).astimezone(zone).date()
        for y in range(first.year, first.year + 9):
            try:
                wall = datetime.strptime(f"{y} {body}", "%Y %b %d %H:%M:%S")
            except ValueError:
                continue
            if wall.date() >= first:
                break
            wall = None
    if wall is None:
        return None
    del year
    return wall + timedelta(microseconds=int((frac + "000000")[:6])), zoned, bool(frac)


def instants(lines, opened, zone):
    """Of one file's (line number, text) in order: {line number: instant}."""
    out, second, before = {}, False, None
    for n, text in lines:
        r = reading(text, opened, zone)
        if r is None:
            continue
        if isinstance(r, datetime):
            t = r
        else:
            wall, stated, fine = r
            if stated and stated.upper() in ("Z", "UTC"):
                t = wall.replace(tzinfo=UTC)
            elif stated and stated[0] in "+-":
                sign = -1 if stated[0] == "-" else 1
                t = (wall - sign * timedelta(hours=int(stated[1:3]), minutes=int(stated[-2:]))).replace(tzinfo=UTC)
            else:
                a, b = (wall.replace(tzinfo=zone, fold=k) for k in (0, 1))
                ua, ub = a.astimezone(UTC), b.astimezone(UTC)
                if ua.astimezone(zone).replace(tzinfo=None) != wall:
                    continue
                if ua != ub:
                    coarse = (lambda x: x) if fine else (lambda x: x.replace(microsecond=0))
                    if before is None or coarse(before) > coarse(wall):
                        second = before is not None and abs(before - wall) < timedelta(hours=1)
                    if stated:
                        second = b.tzname() == stated.upper()
                    t = ub if second else ua
                else:
                    t, second = ua, False
        before = t.astimezone(zone).replace(tzinfo=None)
        out[n] = micros(t)
    return out


def by_file(table, files, spark):
    info = {r["file_path"]: r for r in files.collect()}
    lines = {}
    for r in table.select("file_path", "line_number", "timestamp").collect():
        lines.setdefault(r["file_path"], {})[r["line_number"]] = r["timestamp"]
    return {p: instants(sorted(x.items()), info[p]["opened_at"], ZoneInfo(info[p]["time_zone"] or "UTC")) for p, x in lines.items()}


def test_instants_of_a_whole_table(spark):
    c, files = spark.read.parquet(f"{SMALL}/canonical.parquet"), spark.read.parquet(f"{SMALL}/log_files.parquet")
    want = by_file(c, files, spark)
    got = {r["record_id"]: r["utc_us"] for r in e.queries()["p5_found"](spark, SMALL).collect()}
    bad = [(r["file_path"], r["line_number"], r["timestamp"], got.get(r["record_id"]), want[r["file_path"]].get(r["line_number"])) for r in c.collect() if got.get(r["record_id"]) != want[r["file_path"]].get(r["line_number"])]
    assert not bad, (len(bad), bad[:5])


def test_sessions_of_a_whole_table(spark):
    s, files = spark.read.parquet(f"{SMALL}/structured.parquet"), spark.read.parquet(f"{SMALL}/log_files.parquet")
    at, host = by_file(s, files, spark), {r["file_path"]: r["hostname"] for r in files.collect()}
    actors = {}
    for r in s.collect():
        users = [m["value"] for m in r["metadata"] if m["key"] == "user"]
        t = at[r["file_path"]].get(r["line_number"])
        if r["hostname"] is not None and users and users[-1] and t is not None:
            actors.setdefault((host[r["file_path"]], users[-1]), {})[r["file_path"], r["line_number"]] = t
    want = []
    for key, events in actors.items():
        run = []
        for t in sorted(events.values()):
            if run and t - run[-1] > 1_800_000_000:
                want.append((*key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((*key, run[0], run[-1], len(run)))
    assert sorted(tuple(r) for r in e.queries()["p1_found"](spark, SMALL).collect()) == sorted(want)
