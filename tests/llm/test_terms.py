import re
from collections import Counter

from pyspark.sql import functions as F

from timberline.llm import queries
from timberline.llm.terms import TermCounts, delivery_changes, letter_runs, record_changes, term_deltas
from timberline.session import shared_folder

from ..conftest import rows

SCHEMA = "id bigint, message string, process string, term string, sign string"


def deltas(df, sign=1):
    return term_deltas(df, {"message": letter_runs(F.col("message"))}, {"process": F.col("process")}, sign)


def brute(data):
    occ, rec = Counter(), Counter()
    for _, m, p, *_ in data:
        terms = [("message", t) for t in re.findall("[a-z]+", (m or "").lower())] + ([("process", p)] if p is not None else [])
        occ.update(terms)
        rec.update(set(terms))
    return sorted(((f, t, occ[f, t], rec[f, t]) for f, t in occ), key=repr)


DATA = [(1, "Aa b2b aa", "p", "x", "y"), (2, None, "p", "x", "y"), (3, "", None, None, None), (4, "été B", "", "x", "y"), (5, "z " * 50_000, "q", "x", "y")]


def test_counts_and_marks(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    c = TermCounts(spark, shared_folder(spark, "t")).update(deltas(df))
    assert rows(c.marked().select("field_name", "term", "occurrences", "records")) == brute(DATA)
    assert c.total() == 5
    marks = {(r[0], r[1]): r[2] for r in c.marked(3, 0.3).select("field_name", "term", "mark").collect()}
    assert marks["message", "z"] is None
    assert marks["message", "aa"] == "rare"
    assert {k[1]: v for k, v in marks.items() if k[0] == "process"} == {"p": "rare", "": "rare", "q": "rare"}
    assert {(r[0], r[1]): r[2] for r in c.marked(1, 0.3).select("field_name", "term", "mark").collect()}["message", "b"] == "common"


def test_changes_add_up_to_a_recount(spark):
    before, after = spark.createDataFrame(DATA, SCHEMA), [*DATA[1:4], (5, "new words", "q", "x", "y"), (6, "aa", "p", "x", "y")]
    now = spark.createDataFrame(after, SCHEMA)
    removed, added = record_changes(before, now, ["id"], ["message", "process"])
    assert sorted(r["id"] for r in removed.collect()) == [1, 5]
    assert sorted(r["id"] for r in added.collect()) == [5, 6]
    c = TermCounts(spark, shared_folder(spark, "t")).update(deltas(before)).update(deltas(removed, -1).unionByName(deltas(added)))
    assert rows(c.marked().select("field_name", "term", "occurrences", "records")) == brute(after)
    assert c.total() == len(after)


def test_deliveries_change_what_they_change(spark):
    told = [(1, 1, "aa bb", "p", False), (1, 2, "aa bb", "p", False), (1, 3, "cc", "p", False), (2, 1, "aa", None, False), (2, 2, None, None, True), (2, 3, "dd", None, False), (3, 2, "ee", "p", False), (3, 3, "ee", "p", True), (None, 1, "ff", "", False), (None, 2, "ff", "", None), (4, 1, None, None, True)]
    df = spark.createDataFrame(told, "id bigint, at int, message string, process string, gone boolean")
    changes = delivery_changes(df, ["id"], ["message", "process"], ["at"], "gone")
    got = sorted(((r["at"], r["id"], r["sign"], r["message"]) for r in changes.collect()), key=repr)
    assert got == sorted([(1, 1, 1, "aa bb"), (3, 1, 1, "cc"), (3, 1, -1, "aa bb"), (1, 2, 1, "aa"), (2, 2, -1, "aa"), (3, 2, 1, "dd"), (2, 3, 1, "ee"), (3, 3, -1, "ee"), (1, None, 1, "ff")], key=repr)
    c = TermCounts(spark, shared_folder(spark, "t"))
    by = term_deltas(changes, {"message": letter_runs(F.col("message"))}, {"process": F.col("process")}, F.col("sign"), ("at",)).cache()
    for at in (1, 2, 3):
        c = c.update(by.filter(F.col("at") == at).drop("at"))
    assert rows(c.marked().select("field_name", "term", "occurrences", "records")) == brute([(1, "cc", "p"), (2, "dd", None), (None, "ff", "")])
    assert c.total() == 3
    c.expire()
    assert c.total() == 3
    assert TermCounts(spark, c.path, 3).read().count() == c.read().count()


def test_empty(spark):
    c = TermCounts(spark, shared_folder(spark, "t")).update(deltas(spark.createDataFrame([], SCHEMA)))
    assert (c.marked().count(), c.total()) == (0, 0)


def test_updates_rewrite_only_touched_partitions(spark):
    before = spark.createDataFrame([(i, " ".join(chr(97 + i % 26) * k for k in range(1, 20)), "p", "x", "y") for i in range(52)], SCHEMA)
    first = TermCounts(spark, shared_folder(spark, "t")).update(deltas(before))
    second = first.update(deltas(spark.createDataFrame([(99, "aa", None, "x", "y")], SCHEMA)))
    assert len(first.parts()) > 32
    assert {v for v in first.parts().values()} == {1}
    assert sum(v == 2 for v in second.parts().values()) == 2  # of "aa", and of the number of records
    assert second.total() == 53
    empty = second.update(second.read().selectExpr("field_name", "term", "-occurrences as occurrences", "-records as records"))
    assert (empty.parts(), empty.read().count()) == ({}, 0)


def test_updated_query_is_a_recount(spark):
    small = "/root/testdata/sf0.001"
    assert rows(queries.p4_updated(spark, small)) == rows(queries.p4_counts(spark, small))
