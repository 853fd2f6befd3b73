import os

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_entry_and_found(spark):
    assert e.entry(spark).count() == 10
    q = e.queries()
    assert q["p5_found"](spark, SMALL).columns == ["record_id", "utc_us"]
    assert q["p1_found"](spark, SMALL).columns == ["hostname", "username", "start_us", "end_us", "n_events"]
    assert q["p2_found"](spark, SMALL).columns == ["file_path", "line_number", "last_line", "level", "process"]
