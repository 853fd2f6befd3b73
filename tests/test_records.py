import json
import math
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline import cli
from timberline.operators import anomaly, corpus, records, windows
from timberline.sources import files, sinks

from .conftest import rows

META = "array<struct<key:string,value:string,vtype:string>>"
SCHEMA = f"file_path string, line_number bigint, timestamp string, hostname string, process string, event string, pid bigint, message string, metadata {META}, key string"


def meta(**kw):
    return [(k, v, "string") for k, v in kw.items()]


@pytest.fixture(scope="module")
def recs(spark):
    data = [
        ("f", 1, "Jun  4 01:02:03", "box", "sshd", "e1", 5, " Hello World ", meta(user="root", rhost="h"), "x"),
        ("f", 2, "2024-01-01T07:02:03Z", "box", None, "e1", None, "100% hello_x", meta(rhost=""), "x"),
        ("f", 3, None, None, "su", None, 7, None, [], "x"),
        ("g", 1, "Tue Jun 4 05:00:00", "den", "su", "e2", 7, "a\nb", [("uid", "0", "int"), ("user", "root", "string")], "x"),
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


def hit(recs, **kw):
    return [r["line_number"] for r in recs.filter(records.matches(**kw)).orderBy("file_path", "line_number").collect()]


def test_filters(recs):
    assert hit(recs) == [1, 2, 3, 1]
    assert hit(recs, process="su", event="") == [3, 1]
    assert hit(recs, pid=7) == [3, 1] and hit(recs, pid="5") == [1]
    assert hit(recs, user="root") == [1, 1] and hit(recs, user="None") == [2, 3]
    assert hit(recs, meta=records.meta_args(["uid=0", "x", "a=b=c"][:2])) == [1]
    assert records.meta_args(["a=b=c"]) == {"a": "b=c"}
    assert hit(recs, message_contains="HELLO") == [1, 2] and hit(recs, message_contains="0%") == [2]
    with pytest.raises(ValueError):
        records.matches(color="red")


def test_counts_and_ties(recs):
    assert [tuple(r) for r in records.count_by(recs, "process").collect()] == [("su", 2), ("sshd", 1), ("unknown", 1)]
    assert [tuple(r) for r in records.count_by(recs, "event", 1).collect()] == [("e1", 2)]
    assert rows(records.count_by(recs, "hour", 0)) == sorted([("01", 1), ("07", 1), ("unknown", 1), ("ue Jun 4 05", 1)], key=repr)
    assert rows(records.count_by(recs, "user", 0)) == sorted([("root", 2), ("unknown", 2)], key=repr)
    assert [r["line_number"] for r in records.first_rows(recs, 2).collect()] == [1, 2]
    assert records.count_by(recs.limit(0), "process").count() == 0


def test_flattened(recs):
    flat = records.flattened(recs)
    assert flat.columns == sorted(flat.columns) and "meta.rhost" in flat.columns
    assert flat.filter("line_number = '3'").first()["meta.user"] == ""


def test_renderings(recs):
    got = {(r["file_path"], r["line_number"]): r for r in corpus.renderings(recs).collect()}
    assert got["f", 1]["full"] == "sshd | e1 | user=root rhost=h | Hello World"
    assert got["f", 2]["full"] == "unknown | e1 | 100% hello_x"
    assert got["f", 3]["message_only"] == "" and got["f", 3]["event_message"] == "unknown : "
    assert got["g", 1]["full"] == "su | e2 | uid=0 user=root | a\nb"
    lines = corpus.corpus_lines(corpus.renderings(recs), "message_only").collect()
    assert sorted(r["line"] for r in lines) == ["100% hello_x", "Hello World", "a", "b"]


def test_token_stats(recs):
    texts = corpus.renderings(recs)
    r = corpus.token_stats(texts, "message_only", rare_below=2).first()
    words = [w for t in ("Hello World", "100% hello_x", "a\nb") for w in t.split()]
    assert (r["total_lines"], r["total_tokens"], r["unique_tokens"], r["rare_tokens"]) == (3, len(words), len(set(words)), 6)
    assert corpus.token_stats(texts.limit(0), "full").first()["avg_tokens_per_line"] == 0.0
    v = corpus.vocabulary_reduction(recs, recs.withColumn("message", F.lit("x y"))).first()
    assert (v["tokens_before"], v["tokens_after"], v["reduction"]) == (6, 2, 66.67)


def test_windows_ranks_and_split(spark):
    lines = spark.createDataFrame([(f, n, f"{f}{n}") for f in "ab" for n in range(1, 28)], "file_path string, line_number bigint, line string")
    want = [f"{f}{n}" for f in "ab" for n in range(1, 28)]
    for block in (4, 1000):
        got = [r["line"] for r in windows.ranked(lines.repartition(5), ["line_number"], block).orderBy("rank").collect()]
        assert got == want
    w = windows.split_windows(windows.count_windows(lines, 10)).orderBy("window_id").collect()
    assert [r["text"] for r in w] == ["\n".join(want[i : i + 10]) for i in range(0, 50, 10)]
    assert [r["part"] for r in w] == ["train"] * 4 + ["test"]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 10, 11])
def test_injected_lines(spark, n):
    lines = [str(i) for i in range(n)]
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    mid = n // 2
    for f, added, least, before, after in ((windows.inject_brute_force, windows.BRUTE_FORCE, 5, 2, 2), (windows.inject_sudo_abuse, windows.SUDO_ABUSE, 3, 0, 1), (windows.inject_abnormal_close, windows.ABNORMAL_CLOSE, 3, 0, 1), (windows.inject_remote_login, windows.REMOTE_LOGIN, 3, 0, 1)):
        want = lines if n < least else lines[: mid - before] + list(added) + lines[mid + after :]
        assert list(df.select(f(F.col("lines"), F.size("lines"))).first()[0]) == want


def test_attacks_are_drawn_by_seed(spark):
    w = spark.createDataFrame([(i, [str(i)] * 10, "t") for i in range(50)], "window_id bigint, lines array<string>, text string")
    a, b = (sorted(r["window_id"] for r in windows.with_attacks(x, 0.2, 3).filter("label = 1").collect()) for x in (w, w.repartition(7)))
    assert a == b and len(a) == 10
    assert windows.with_attacks(w.limit(0)).count() == 0


def test_thresholds_and_metrics(spark):
    for scores in ([1.0, 2.0, 3.0, 10.0], [5.0, 5.0, 5.0], [1.0, 2.0, math.inf]):
        df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(scores)] + [(90, None, 0), (91, math.nan, 0), (92, 1e9, 1)], "window_id int, ppl double, label int")
        r = anomaly.threshold(df).first()
        mid = statistics.median(scores)
        mad = statistics.median(abs(s - mid) for s in scores)
        assert (r["median"], r["mad"], r["threshold"]) == (mid, mad, mid + 3 * mad)
    rows_ = anomaly.predicted(df, F.lit(1.5))
    assert {r["window_id"]: r["prediction"] for r in rows_.collect()} == {0: 0, 1: 1, 2: 1, 90: 0, 91: 0, 92: 1}
    m = anomaly.metrics(rows_).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 2, 0, 3) and m["recall"] == 1.0
    assert anomaly.metrics(rows_.limit(0)).first()["f1"] == 0.0
    assert [r["window_id"] for r in anomaly.audit(df, "top", n=2).collect()] == [2, 92]
    assert [r["window_id"] for r in anomaly.audit(df, "boundary", F.lit(1.9), 1).collect()] == [1]
    assert anomaly.FixedThreshold.accuracy(rows_).first()[0] == round(2 / 6, 6)


def test_bigram_scores(spark):
    train = [(0, "a b a b"), (1, "a c 12")]
    test = [(2, "a b"), (3, "zz 7"), (4, " ")]
    schema = "window_id bigint, text string"
    got = {r["window_id"]: r["ppl"] for r in anomaly.BigramScorer().fit(spark.createDataFrame(train, schema)).score(spark.createDataFrame(test, schema)).collect()}
    seqs = [["<s>", *t.replace("12", "0").split()] for _, t in train]
    bi, uni = Counter(p for s in seqs for p in zip(s, s[1:], strict=False)), Counter(w for s in seqs for w in s[1:])
    prev = Counter()
    for (p, _), n in bi.items():
        prev[p] += n
    total, size = sum(uni.values()), len(uni) + 1

    def ppl(words):
        s = ["<s>", *words]
        lp = [math.log(0.5 * (bi[p, w] + 0.1) / (prev[p] + 0.1 * size) + 0.5 * (uni[w] + 0.1) / (total + 0.1 * size)) for p, w in zip(s, s[1:], strict=False)]
        return math.exp(-sum(lp) / len(lp))

    assert got[2] == pytest.approx(ppl(["a", "b"])) and got[3] == pytest.approx(ppl(["zz", "0"])) and got[4] is None


def test_sources_and_sinks(spark, tmp_path, recs):
    text = "one\r\n\ntwo\n" + "x" * 50 + "\n" + "three"
    (tmp_path / "a.log").write_bytes(text.encode() + b"\xff\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = files.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_number"], r["line"]) for r in got] == [(1, "one"), (2, ""), (3, "two"), (4, "x" * 50), (5, "three")]
    assert [r["line"] for r in files.read_corpus(spark, str(tmp_path / "a.log")).orderBy("line_number").collect()] == ["one", "two", "x" * 50, "three"]
    import bz2
    import gzip

    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"g1\ng2\n"))
    (tmp_path / "c.log.bz2").write_bytes(bz2.compress(b"b1\n"))
    got = files.read_lines(spark, [str(tmp_path / "b.log.gz"), str(tmp_path / "c.log.bz2")]).collect()
    assert sorted((r["line_number"], r["line"]) for r in got) == [(1, "b1"), (1, "g1"), (2, "g2")]
    out = str(tmp_path / "nd")
    sinks.write_ndjson_with_stats(recs.drop("key"), {"n": 4}, out)
    back = files.read_records(spark, out)
    key = lambda df: sorted((r["line_number"], r["message"] or "", [tuple(m)[:2] for m in r["metadata"]]) for r in df.collect())
    assert key(back) == key(recs)
    assert files.read_records(spark, out, need_message=True).count() == 3
    sinks.write_json(recs.drop("key"), str(tmp_path / "e.json"), {"v": 1})
    envelope = json.loads((tmp_path / "e.json").read_text())
    assert envelope["metadata"] == {"v": 1} and envelope["logs"][3]["metadata"] == {"uid": 0, "user": "root"}
    assert key(files.read_records(spark, str(tmp_path / "e.json"))) == key(recs)
    sinks.write_json(recs.drop("key"), str(tmp_path / "arr.json"))
    assert key(files.read_records(spark, str(tmp_path / "arr.json"))) == key(recs)
    sinks.write_counts_csv(records.count_by(recs, "process"), str(tmp_path / "csv"))
    assert "Key,Count" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    sinks.write_records_csv(recs, str(tmp_path / "flat"))
    sinks.write_corpus(corpus.renderings(recs), str(tmp_path / "corpus"))
    assert spark.read.text(str(tmp_path / "corpus/corpus_full")).count() == 5
    assert sinks.console_lines(recs).count() == 4


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "in.log"
    log.write_text("\n".join(f"Jun  4 01:02:{i:02} box su[{i}]: session opened for user u{i % 3} by (uid=0)" for i in range(40)) + "\n")
    cli.main(["syslog", str(log), "-o", str(tmp_path / "s"), "--anonymize"])
    cli.main(["parse", str(log), "-o", str(tmp_path / "p")])
    (tmp_path / "q").mkdir()
    cli.main(["parse", str(log), "-o", str(tmp_path / "q/out.json"), "--format", "pretty", "--anonymize"])
    assert "hosts" in json.loads((tmp_path / "q/anonymization_map.json").read_text())
    assert json.loads((tmp_path / "q/out.json").read_text())["logs"]
    cli.main(["query", "-i", str(tmp_path / "p"), "--process", "su", "--aggregate", "event"])
    assert "session_opened" in capsys.readouterr().out
    cli.main(["corpus", str(tmp_path / "s"), "-o", str(tmp_path / "c")])
    cli.main(["score", "--corpus", str(tmp_path / "c/corpus_full"), "--window_size", "2"])
    assert "threshold" in capsys.readouterr().out


def test_values_at_ranks(spark, monkeypatch):
    from timberline.operators import ranks

    monkeypatch.setattr(ranks, "FEW", 5)
    values = [math.exp(i % 97 / 7) for i in range(2000)] + [3.5] * 700 + [-1e9]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").cache()
    want = sorted(values)
    odd = spark.createDataFrame([(float(v),) for v in [*range(9), *["inf"] * 9, *["-inf"] * 9, *[1e308] * 9, *[-1e308] * 9]], "x double")
    assert ranks.at_ranks(odd, F.col("x"), [0, 9, 20, 30, 44]) == [float("-inf"), -1e308, 2.0, 1e308, float("inf")]
    assert ranks.at_ranks(df, F.col("x"), [0, 5, 1350, 1351, 2700]) == [want[k] for k in (0, 5, 1350, 1351, 2700)]
    assert ranks.median(df, F.col("x")) == statistics.median(values)
    assert ranks.median(df.limit(0), F.col("x")) is None
