import itertools
import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from timberline.operators.instants import best_path, border_readings, cost_matrix, entry_cost, resolve_instants, step_cost

FILES = "file_path string, hostname string, time_zone string, opened_at timestamp_ntz"


def us(*parts):
    return int((datetime(*parts, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def resolve(spark, texts, zone="America/New_York", opened=datetime(2023, 11, 5)):
    files = spark.createDataFrame([("f", "h", zone, opened)], FILES)
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_path string, line_number bigint, timestamp string")
    return [r["utc_us"] for r in resolve_instants(df, files).orderBy("line_number").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2023-06-01T12:00:00Z", us(2023, 6, 1, 12)),
        (" [2023-06-01 12:00:00,250 utc] ", us(2023, 6, 1, 12) + 250_000),
        ("2023/06/01 08:00:00", us(2023, 6, 1, 12)),
        ("2023-06-01T08:00:00.123456-0400", us(2023, 6, 1, 12) + 123_456),
        ("01/Jun/2023:14:00:00 +0200", us(2023, 6, 1, 12)),
        ("Thu Jun 01 08:00:00.5 2023", us(2023, 6, 1, 12) + 500_000),
        ("06/01/2023 8:00:00 AM", us(2023, 6, 1, 12)),
        ("06/01/2023 12:00:00 am", us(2023, 6, 1, 4)),
        ("230601 080000", us(2023, 6, 1, 12)),
        ("20230601T120000Z", us(2023, 6, 1, 12)),
        ("Thu, 01 Jun 2023 12:00:00 +0000", us(2023, 6, 1, 12)),
        ("2023-06-01 08:00:00 EDT", us(2023, 6, 1, 12)),
        ("1685620800", us(2023, 6, 1, 12)),
        ("1685620800123", us(2023, 6, 1, 12) + 123_000),
        ("1685620800123456", us(2023, 6, 1, 12) + 123_456),
        ("1685620800.5", us(2023, 6, 1, 12) + 500_000),
        ("Nov  6 00:00:00", us(2023, 11, 6, 5)),
        ("Jan  2 00:00:00", us(2024, 1, 2, 5)),
        ("Feb 29 00:00:00", us(2024, 2, 29, 5)),
        ("2023-03-12 02:30:00", None),  # skipped by the clock
        ("2023-02-30T05:30:00Z", None),
        ("2023-13-01 00:00:00", None),
        ("2023-06-01 24:00:00", None),
        ("06/01/2023 13:00:00 PM", None),
        ("2023-06-", None),
        ("Foo  1 10:00:00", None),
        ("12345", None),
        ("", None),
        ("n/a", None),
        (None, None),
        ("2023-06-01" + " " * 250 + "12:00:00 UTC", us(2023, 6, 1, 12)),
        ("9" * 100_000, None),
        ("x" + " " * 100_000 + "y", None),
    ],
)
def test_single_texts(spark, text, want):
    assert resolve(spark, [text]) == [want]


def test_repeated_hour(spark):
    first, second = us(2023, 11, 5, 5, 30), us(2023, 11, 5, 6, 30)
    assert resolve(spark, ["2023-11-05 01:30:00"]) == [first]
    assert resolve(spark, ["2023-11-05 01:30:00 EST"]) == [second]
    got = resolve(spark, ["2023-11-05 01:30:00", "2023-11-05 01:50:00", "2023-11-05 01:30:00", "2023-11-05 01:40:00", "2023-11-05 02:10:00"])
    assert got == [first, us(2023, 11, 5, 5, 50), second, us(2023, 11, 5, 6, 40), us(2023, 11, 5, 7, 10)]


def test_coarser_precision_does_not_run_back(spark):
    got = resolve(spark, ["2023-11-05 01:30:00.900", "Nov  5 01:30:00"])
    assert got[1] == us(2023, 11, 5, 5, 30)


def test_a_stated_offset_anchors_the_pass(spark):
    got = resolve(spark, ["2023-11-05T01:10:00-05:00", "2023-11-05 01:20:00"])
    assert got[1] == us(2023, 11, 5, 6, 20)


def test_against_zoneinfo(spark):
    zone = ZoneInfo("Australia/Sydney")
    start = datetime(2023, 3, 1, 0, 7, tzinfo=UTC)
    instants = [start + timedelta(hours=7 * i) for i in range(400)]
    texts = [t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S") for t in instants]
    assert resolve(spark, texts, "Australia/Sydney") == [int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) for t in instants]


def test_chunks_of_lines_agree_with_one(spark, monkeypatch):
    from timberline.operators import instants

    texts = [f"2023-11-05 01:{m:02}:00" for m in (*range(0, 60, 4), *range(0, 60, 3))]
    whole = resolve(spark, texts)
    monkeypatch.setattr(instants, "CHUNK_LINES", 4)
    assert resolve(spark, texts) == whole
    assert sum(b < a for a, b in zip(whole, whole[1:], strict=False)) == 0


def test_path_against_all_paths():
    r = random.Random(3)
    for _ in range(60):
        rows = [[(r.randrange(2), 0, 100 * i + r.randrange(150))] if r.random() < 0.3 else [(0, 1, t := 100 * i + r.randrange(150)), (0, 2, t + 300)] if r.random() < 0.5 else [(0, 0, 100 * i), (1, 0, r.randrange(900))] for i in range(7)]
        units = [r.choice((1, 10)) for _ in rows]

        def cost(path, rows=rows, units=units):
            got = [rows[i][j] for i, j in enumerate(path)]
            return entry_cost(got[0]) + sum(step_cost(a, b, max(units[i], units[i + 1])) for i, (a, b) in enumerate(zip(got, got[1:], strict=False)))

        best = min(cost(p) for p in itertools.product(*[range(len(x)) for x in rows]))
        assert cost(best_path(rows, units)) == best
        ends = []
        for a, b in ((0, 2), (2, 3), (3, 7)):
            ends.append(([units[a], [x for t in rows[a] for x in t], units[b - 1], [x for t in rows[b - 1] for x in t], cost_matrix(rows[a:b], units[a:b]).ravel().tolist()]))
        borders = border_readings(pd.DataFrame(ends, columns=["unit0", "reads0", "unit1", "reads1", "costs"]))
        joined = [j for (a, b), (f, l) in zip(((0, 2), (2, 3), (3, 7)), borders, strict=True) for j in best_path(rows[a:b], units[a:b], f, l)]
        assert cost(joined) == best


def test_neighbours_decide_the_order_of_day_and_month(spark, monkeypatch):
    from timberline.operators import instants

    files = spark.createDataFrame([("a", "h", None, None), ("b", "h", None, None)], FILES)
    # 3 April in one file, 4 March in the other; only the last line says which, or the neighbours in ISO
    data = [("a", 1, "03/04/2023 10:00:00"), ("a", 2, "03/04/2023 10:05:00"), ("a", 3, "13/04/2023 09:00:00"), ("b", 1, "2023-03-04 09:00:00"), ("b", 2, "03/04/2023 10:00:00"), ("b", 3, "2023-03-05 09:00:00"), ("b", 3, "2023-03-05 09:00:00")]
    df = spark.createDataFrame(data, "file_path string, line_number bigint, timestamp string")
    want = {("a", 1): us(2023, 4, 3, 10), ("a", 2): us(2023, 4, 3, 10, 5), ("a", 3): us(2023, 4, 13, 9), ("b", 1): us(2023, 3, 4, 9), ("b", 2): us(2023, 3, 4, 10), ("b", 3): us(2023, 3, 5, 9)}
    for lines in (1 << 17, 1):
        monkeypatch.setattr(instants, "CHUNK_LINES", lines)
        got = resolve_instants(df, files, orders=("mdy", "dmy"))
        assert got.count() == len(data)
        assert {(r["file_path"], r["line_number"]): r["utc_us"] for r in got.collect()} == want
    only = {(r["file_path"], r["line_number"]): r["utc_us"] for r in resolve_instants(df, files).collect()}
    assert only[("a", 1)] == us(2023, 3, 4, 10)
    assert only[("a", 3)] is None


def test_empty_null_and_clashing(spark):
    files = spark.createDataFrame([("f", "h", None, None)], FILES)
    df = spark.createDataFrame([], "file_path string, line_number bigint, timestamp string, `_wall` int, source string, utc_us string")
    out = resolve_instants(df, files)
    assert out.count() == 0
    df = spark.createDataFrame([(None, None, "2023-06-01 12:00:00", 1, "s", "old"), ("gone", 1, "Jun  1 12:00:00", 2, "s", "old")], df.schema)
    got = {r["_wall"]: r["utc_us"] for r in resolve_instants(df, files).collect()}
    assert got == {1: us(2023, 6, 1, 12), 2: None}


def test_redelivered_lines_keep_their_pass(spark):
    files = spark.createDataFrame([("f", "h", "America/New_York", datetime(2023, 11, 5))], FILES)
    data = [("f", n, f"2023-11-05 01:{m}:00") for n, m in ((1, 50), (2, 10), (1, 50), (2, 10))]
    df = spark.createDataFrame(data, "file_path string, line_number bigint, timestamp string")
    got = sorted((r["line_number"], r["utc_us"]) for r in resolve_instants(df, files).collect())
    assert got == [(1, us(2023, 11, 5, 5, 50))] * 2 + [(2, us(2023, 11, 5, 6, 10))] * 2
