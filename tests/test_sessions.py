import random

import numpy as np
import pandas as pd

from timberline.operators import sessions
from timberline.operators.sessions import cartesian, gap_tree, sessionize, sessions_at
from timberline.plans import core_queries

from .conftest import rows

SCHEMA = "host string, who string, us bigint, f string, n bigint, chunk string"


def brute(events, gap):
    out, by = [], {}
    for h, w, t, f, n, _ in events:
        if None not in (h, w, t):
            by.setdefault((h, w), {})[(f, n, t)] = t
    for key, ts in by.items():
        run = []
        for t in sorted(ts.values()):
            if run and t - run[-1] > gap:
                out.append((*key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((*key, run[0], run[-1], len(run)))
    return sorted(out, key=repr)


def events(seed, n=600):
    r = random.Random(seed)
    out = [(r.choice("AB"), r.choice("xyz"), r.randrange(400) * r.choice((1, 1, 40)), "f", i, "c") for i in range(n)]
    return out + out[:50] + [(None, "x", 1, "f", 1, "c"), ("A", None, 1, "f", 2, "c"), ("A", "x", None, "f", 3, "c"), ("A", "x", 5, None, None, None), ("A", "x", 5, None, None, "other")]


def test_sessions_against_brute_force(spark):
    data = events(1)
    df = spark.createDataFrame(data, SCHEMA)
    for gap in (0, 3, 50):
        got = rows(sessionize(df, ["host", "who"], "us", gap, ["f", "n"]).drop("duration_us"))
        assert got == brute(data, gap)


def test_one_tree_serves_every_gap(spark):
    data = events(2)
    df = spark.createDataFrame(data, SCHEMA)
    for chunk in (7, 64, 10**9):
        tree = gap_tree(df, ["host", "who"], "us", ["f", "n"], 2, 500, chunk).cache()
        for gap in (2, 5, 17, 40, 120, 500):
            assert rows(sessions_at(tree, gap).drop("duration_us")) == brute(data, gap), (chunk, gap)


def test_pieces_of_few_rows(spark, monkeypatch):
    data = events(5, 300)
    ids = [(*e[:2], None if e[2] is None else 7, *e[3:]) for e in events(6, 40)]
    monkeypatch.setattr(sessions, "PIECE_ROWS", 3)
    spark.sparkContext.setLogLevel("ERROR")
    frames = [pd.DataFrame({"k": list("aab"), "us": [1, 1, 1]}), pd.DataFrame({"k": list("bbb"), "us": [1, 2, 2]}), pd.DataFrame({"k": [], "us": []}), pd.DataFrame({"k": ["b"], "us": [2]})]
    assert [x["k"].tolist() for x in sessions._pieces(iter(frames), ["k", "us"])] == [["a", "b", "b"]]
    for rows_in in (data, ids):
        df = spark.createDataFrame(rows_in, SCHEMA)
        tree = gap_tree(df, ["host", "who"], "us", ["f", "n"], 2, 500, 64).cache()
        for gap in (2, 17, 120):
            assert rows(sessions_at(tree, gap).drop("duration_us")) == brute(rows_in, gap)


def test_duration_and_empty(spark):
    assert sessionize(spark.createDataFrame([], SCHEMA), ["host"], "us", 5).count() == 0
    df = spark.createDataFrame([("A", "x", 3, "f", 1, ""), ("A", "x", 9, "f", 2, "")], SCHEMA)
    assert rows(sessionize(df, ["host"], "us", 6)) == [("A", 3, 9, 2, 6)]


def test_cartesian_nodes():
    first, last, gap = cartesian(np.array([2, 9, 1, 1, 4]))
    assert sorted(zip(first.tolist(), last.tolist(), gap.tolist(), strict=True)) == [(0, 1, 2), (0, 5, 9), (2, 4, 1), (2, 5, 4)]


def test_query_cuts_the_tree_of_all_gaps(spark, monkeypatch):
    asked, small = [], "/root/testdata/sf0.001"

    def spy(*args):
        asked.append(args[4:6])
        return gap_tree(*args)

    monkeypatch.setattr(core_queries, "gap_tree", spy)
    found = core_queries.p1_found(spark, small)
    assert asked == [(60_000_000, 86_400_000_000)]
    plain = sessionize(core_queries.login_events(spark, small), ["hostname", "username"], "us", core_queries.SESSION_GAP_US, ["file_path", "line_number"])
    assert rows(found) == rows(plain.select(*found.columns))
