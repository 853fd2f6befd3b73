import random

from pyspark.sql import functions as F

from timberline.llm.runs import collapse_runs, masked_words, word_agreement

from ..conftest import rows

SCHEMA = "file string, proc string, n bigint, us bigint, event string, message string, chunk string"


def key(message):
    return None if message is None else " ".join("0" if any(c.isdigit() for c in w) else w for w in message.lower().split())


def alike(a, b, similarity):
    if a is None or b is None or similarity == 1:
        return a == b
    x, y = a.split(), b.split()
    return sum(p == q for p, q in zip(x, y, strict=False)) >= similarity * max(len(x), len(y))


def brute(data, gap=None, similarity=1, least=1):
    by = {}
    for f, p, n, us, e, m, _ in data:
        if None not in (f, p, n):
            by.setdefault((f, p), {}).setdefault(n, (us, e, key(m)))
    out = []
    for k, seq in by.items():
        run = None
        for n in sorted(seq):
            us, e, m = seq[n]
            late = gap is not None and run and us is not None and run["us"] and us - run["us"][-1] > gap
            if not run or run["event"] != e or not alike(run["anchor"], m, similarity) or late:
                run = {"event": e, "anchor": m, "n": [], "us": []}
                out.append((k, run))
            run["n"].append(n)
            run["us"] += [] if us is None else [us]
    return sorted(((*k, r["n"][0], r["n"][-1], len(r["n"]), min(r["us"], default=None), max(r["us"], default=None)) for k, r in out if len(r["n"]) >= least), key=repr)


def data(seed, n=300, nulls=0.0):
    r = random.Random(seed)
    texts = ["Took 12 ms", "took  13\tms", "took x ms", "took x s", "took y s", None, "", "a b c d e", "a b c d x", "a b c y x"]
    out = [(r.choice("fg"), r.choice(["p", "q", None]), i, None if r.random() < nulls else i * 10 + r.randrange(30), "a" if r.random() < 0.9 else None, r.choice(texts[i // 30 % 3 * 3 :][:4]), "c") for i in range(n)]
    return out + out[:40]


def collapse(df, similarity=1.0, **more):
    got = collapse_runs(df, ["file", "proc"], "n", [F.col("event")], masked_words(F.col("message")), similarity, "us", **more)
    return rows(got.drop("duration_us"))


def test_runs_against_brute_force(spark):
    for nulls in (0.0, 0.3):
        d = data(1, nulls=nulls)
        df = spark.createDataFrame(d, SCHEMA)
        for chunk in (1, 17, 1 << 17):
            for similarity in (1.0, 0.6):
                assert collapse(df, similarity, chunk=chunk) == brute(d, similarity=similarity), (chunk, similarity)
                assert collapse(df, similarity, chunk=chunk, max_gap_us=60, least=2) == brute(d, 60, similarity, 2), (chunk, similarity)


def test_no_sure_cut(spark):
    d = [("f", "p", i, i, "e", ("a b c d " + "xyz"[i % 7 % 3]) if i % 11 else "other", "c") for i in range(400)]
    df = spark.createDataFrame(d, SCHEMA)
    for chunk in (5, 64):
        assert collapse(df, 0.8, chunk=chunk) == brute(d, similarity=0.8)


def test_word_agreement():
    assert [word_agreement(*x) for x in (("a b", "a b"), ("a b", "a c"), ("a b", "a b c d"), ("", ""), ("", "a"), (None, None), (None, ""))] == [1, 0.5, 0.5, 1, 0, 1, 0]


def test_masked_words(spark):
    texts = ["  Took 12ms  a1b  x ", "", "no digits", "1" * 100_000, "a" * 100_000, None, "# 0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(masked_words(F.col("t"))).collect()]
    assert got == ["took 0 0 x", "", "no digits", "0", "a" * 100_000, None, "# 0"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collapse(df) == []
    assert collapse(df, 0.8, max_gap_us=5) == []


def test_similar_events_join_the_anchor(spark):
    d = [("f", "p", i, i * 1_000_000, "e", m, "c") for i, m in enumerate(["a b c d e", "a b c d e", "a b c d x", "a b c y x", "", None, "a"])]
    df = spark.createDataFrame(d, SCHEMA)
    assert [g[2:5] for g in collapse(df, 0.8)] == [(0, 2, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
    assert len(collapse(df, 0.8, max_gap_us=10)) == 7
