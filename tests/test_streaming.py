from timberline.operators import pseudonyms, syslog
from timberline.session import shared_folder
from timberline.sources import files
from timberline.streaming import logs

from .conftest import rows


def lines(lo, hi):
    return [f"Jun  4 01:02:{n % 60:02} box{n % 5} su[{n}]: session opened for user u{n % 7} by (uid=0)" for n in range(lo, hi)]


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(lines(0, 30)) + "\nnot syslog\n")
    (tmp_path / "in/b.log").write_text("\n".join(lines(30, 50)) + "\n")
    run(logs.stream_syslog(spark, str(tmp_path / "in")), "parsed")
    batch = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines(0, 50), 1)], "file_path string, line_number bigint, line string")
    cols = ["timestamp", "hostname", "process", "pid", "message", "event"]
    assert rows(spark.table("parsed").select(*cols)) == rows(syslog.parse_syslog(batch).select(*cols))


def test_event_windows_and_sessions(spark, tmp_path):
    data = [("u", "e", f"2024-01-01 00:{m:02}:00") for m in (0, 1, 9, 50, 51)]
    spark.createDataFrame(data, "who string, event string, t string").selectExpr("who", "event", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("who string, event string, t timestamp").parquet(str(tmp_path / "ev"))
    run(logs.event_counts(stream, "t"), "counts", "complete")
    assert sorted(r["count"] for r in spark.table("counts").collect()) == [1, 2, 2]
    table = spark.read.parquet(str(tmp_path / "ev"))
    got = logs.stream_sessions(table, ["who"], "t", "10 minutes").collect()
    assert sorted(r["n_events"] for r in got) == [2, 3]


def test_numbered_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_bytes("\n".join(lines(0, 30)).encode() + b"\n\nbad \xff byte\n")
    seen = []
    q = logs.stream_lines(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, i: seen.extend(logs.numbered(df).collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.createDataFrame(seen)) == rows(files.read_lines(spark, str(tmp_path / "in")))


def test_growing_dictionary(spark):
    said = [*lines(0, 40), *(f"Jun  4 01:03:00 box sudo[1]: USER=root ; COMMAND=/bin/x for user {u} at 10.0.0.{i}" for i, u in enumerate(("u3", "carol", "dave", "carol")))]
    every = spark.createDataFrame([("f", n, x) for n, x in enumerate(said, 1)], "file_path string, line_number bigint, line string")
    records = syslog.parse_syslog(every)
    path = shared_folder(spark, "dict")
    parts = []
    for i, cut in enumerate(("line_number <= 15", "line_number between 16 and 41", "line_number > 41")):
        d = logs.StreamingDictionary(spark, path)  # as after a restart
        parts.append(d.batch(records.filter(cut), i))
    d.batch(records.filter("line_number > 41"), 2)
    assert d.version() == 2
    assert rows(d.tokens()) == rows(pseudonyms.dictionary(records))
    got = sorted(r["masked_log"] for p in parts for r in p.collect())
    assert got == sorted(r["masked_log"] for r in pseudonyms.pseudonymised(records).collect())
    assert not any(u in g for g in got for u in ("carol", "dave", "10.0.0."))


def test_values_beyond_the_dictionary_stay_hidden(spark):
    records = syslog.parse_syslog(spark.createDataFrame([("f", 1, lines(0, 1)[0])], "file_path string, line_number bigint, line string"))
    tokens = pseudonyms.dictionary(records).filter("category <> 'users'")
    row = pseudonyms.pseudonymised(records, tokens).first()
    assert "USER_UNKNOWN" in row["masked_log"] and "u0" not in row["message"]
