import random
import re

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import truncation as m

SCHEMA = "doc_id bigint, text string, source string, lang string, n_cells int, tail string, copy int"


def book(r, n):
    """A notebook in fences, and its number of cells."""
    out, cells = ["# Title"], 1
    for _ in range(n):
        kind = r.randrange(3)
        words = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(r.randrange(6, 14)))
        if kind == 0:
            out.append(f"The {words} holds.")
        elif kind == 1:
            out.append(f"## Part\n\nSome {words} ends.")
        else:
            out.append(f"```python\nx = {r.randrange(99)}\n\nprint(x)\n```")
        cells += 1
    return "\n\n".join(out), cells


def test_cells_of_layouts(spark):
    r = random.Random(1)
    data = [(i, *book(r, r.randrange(1, 12))) for i in range(50)]
    df = spark.createDataFrame([(i, t.replace("\n", "\r\n") if i % 2 else t, c) for i, t, c in data], "i int, t string, c int")
    t = m.plain(F.col("t"))
    assert df.filter(m.cells(t, m.layout(t)) != F.col("c")).count() == 0
    others = [
        ('{"cells": [{"cell_type": "code", "outputs": [{"output_type": "x"}]}, {"cell_type": "y"}]}', "json", 3),
        ("# %% [markdown]\n# a\n\n# %% In[1]\nx\n\n#> 1\n#> 2\n", "percent", 3),
        ('<notebook>\n<cell type="md">\na\n</cell>\n</notebook>', "tag", 1),
        ("# T\n\nIn [1]: x\n   ...: y\n\nOut[1]: a b\n\n[3 rows x 2 columns]\n\nIn [2]: z", "log", 4),
    ]
    df = spark.createDataFrame(others, "t string, k string, c int")
    assert [tuple(x) for x in df.select(m.layout(t), m.cells(t, m.layout(t))).collect()] == [(k, c) for _, k, c in others]


def test_found_on_planted_cuts(spark):
    r = random.Random(2)
    data, cut = [], set()
    for i in range(600):
        text, cells = book(r, r.randrange(4, 14))
        if i % 5 == 0:
            at = r.randrange(20, len(text) - 2)
            if text[at].isalpha() and text[at - 1].isalpha():
                text = text[:at]
                cut.add(i)
        data.append((i, text, "ab"[i % 2], None if i % 3 == 0 else "en", None if i % 4 == 0 else cells, "t", 1))
    data += [(1000, None, "a", "en", 1, "t", 1), (1001, "", "a", None, None, "t", 1), (1002, " \n ", None, None, None, "t", 1), (1003, "short.", None, None, 3, "t", 1), (None, "x", "a", "en", 1, "t", 1), (1004, "z" * 300_000 + " end.", "a", "en", None, "t", 1)]
    out = {x["doc"]: x["cut"] for x in m.find_truncated(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(out) == {*range(600), 1003, 1004}
    found = {i for i, c in out.items() if c and i < 600}
    assert len(found & cut) >= 0.97 * len(cut), sorted(cut - found)
    assert len(found - cut) <= 0.02 * len(cut), sorted(found - cut)


def test_field_limit_and_closing(spark):
    r = random.Random(3)
    texts = []
    for _ in range(40):
        text, cells = book(r, 30)
        texts.append((text[:500], None))
    for _ in range(60):
        text, cells = book(r, 3)
        texts.append((text, cells))
    data = [(i, t, "lim", "en", c, "t", 1) for i, (t, c) in enumerate(texts)]
    data += [(200, '{"cells": [], "nbformat": 4}', "j", "en", 0, "t", 1), (201, '{"cells": [], "nbfor', "j", "en", 0, "t", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    out = {x["doc"]: x["cut"] for x in m.find_truncated(df).collect()}
    stops = {i for i, (t, _) in enumerate(texts[:40]) if t.rstrip()[-1] in ".!?"}
    assert all(out[i] for i in range(40) if i not in stops)
    assert not any(out[i] for i in range(40, 100))
    assert (out[200], out[201]) == (False, True)
    rates = {x["source"]: x["n_cut"] for x in m.truncation_rates(m.find_truncated(df)).collect()}
    assert rates["j"] == 1


def test_empty(spark):
    assert m.find_truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def folded(text):
    return re.sub(rb"[0-9]", b"0", text.encode())


def test_contexts_are_counted_exactly(spark):
    """As many different contexts as base64 has: each has its own counts."""
    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/\n"
    texts = ["".join(r.choices(letters, k=20_000)).strip() for _ in range(100)]
    df = spark.createDataFrame([(i, t, "a", "en", None, "t", 1) for i, t in enumerate(texts)], SCHEMA)
    every = b"\0".join(folded(t) for t in texts)
    checked = 0
    for x in m.end_scores(df).collect():
        for order, e, t, stops in ((m.ORDERS[o["k"]], o["e"], o["t"], o["stops"]) for o in x["orders"]):
            end = folded(texts[x["doc"]])[-order:]
            after = [a for a in re.findall(b"(?=" + re.escape(end) + b"(.))", every, re.S) if a != b"\0"]
            assert (e, t, stops) == (sum(folded(y).endswith(end) for y in texts), len(after), after.count(b"\n")), end
            checked += 1
    assert checked >= 400


def test_contexts_across_pieces_and_of_all_orders(spark):
    """A long text has its contexts counted wherever it is read in pieces; one of 16 and of 1 character, too."""
    r = random.Random(5)
    long = "".join(r.choices("abcdefgh \n", k=4 * m.PART))
    cuts = range(m.PART, len(long) - m.PART + 1, m.PART)  # the end of the others lies across each, and elsewhere
    for at in [*cuts, *range(1000, 31_000, 1500)]:
        long = long[: at - 9] + "the very last end here"[-20:] + long[at + 11 :]
    texts = [long + "q", *(f"{i}. {'wxyz'[i % 4]} the very last end here" for i in range(14)), "€", "Xb", "a" * 40]
    df = spark.createDataFrame([(i, t, "a", "en", None, "t", 1) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    every = b"\0".join(folded(t) for t in texts)
    rows = m.end_scores(df).collect()
    assert {1, 16} <= {m.ORDERS[o["k"]] for x in rows for o in x["orders"]}
    for x in rows:
        for o in x["orders"]:
            end = folded(texts[x["doc"]])[-m.ORDERS[o["k"]] :]
            after = [a for a in re.findall(b"(?=" + re.escape(end) + b"(.))", every, re.S) if a != b"\0"]
            assert (o["t"], o["stops"]) == (len(after), after.count(b"\n")), (x["doc"], end)


def test_weights_tell_cuts_from_ends():
    r = np.random.default_rng(1)
    cut = np.repeat([0.0, 1.0], [3000, 300])
    x = np.column_stack([np.ones(3300), r.normal(3 - 6 * cut, 1.5), r.normal(2 - 5 * cut, 1.5)])
    noisy = cut.copy()
    noisy[3000:3030] = 0  # cut, but with all cells
    w = m.weights(x, noisy, np.array(m.WEIGHTS), np.full(3, 0.01))
    assert ((x @ w > 0) == cut).mean() > 0.99
    assert np.allclose(m.weights(x[:0], cut[:0], np.array(m.WEIGHTS), np.full(3, 0.01)), m.WEIGHTS)


def test_several_field_limits(spark):
    data = [(i, "a", "x", i, "en", n, n + 5) for i, n in enumerate([100] * 6 + [70] * 5 + list(range(200, 300)))]
    df = spark.createDataFrame([(d, s, c, n, b) for d, s, _, c, _, n, b in data], "doc int, source string, copy int, n_chars int, n_bytes int")
    got = m.field_limits(df).first()["limits"]
    assert {(x["unit"], x["most"]) for x in got} == {("chars", 100), ("chars", 70), ("bytes", 105), ("bytes", 75)}


def test_stop_inside_code_is_no_sentence_end(spark):
    r = random.Random(6)
    texts = [" ".join(f"y = np.{r.choice(['sum', 'abs', 'exp'])}(x)" for _ in range(1000)) + f"\n\nThe {r.choice(['mean', 'rest'])} holds." for _ in range(60)]
    texts[7] = texts[7][: texts[7].rindex("np.") + 3]
    out = m.find_truncated(spark.createDataFrame([(i, t, "a", "en", None, "t", 1) for i, t in enumerate(texts)], SCHEMA))
    assert [x["doc"] for x in out.filter("cut").collect()] == [7]


def test_sums_are_sent_in_parts():
    sums, got = m._Sums(), {}
    r = np.random.default_rng(2)
    keys = r.integers(0, 50, 500).astype(np.uint64)
    for part in np.split(keys, 5):
        sums.add(part, np.ones(len(part)), (part % np.uint64(2)).astype(float))
        for b in sums.sent():
            for h, t, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[h] = tuple(np.add(got.get(h, (0, 0)), (t, s)))
    assert list(sums.sent()) == []
    assert got == {int(k): (int((keys == k).sum()), int((keys == k).sum() * (k % 2))) for k in np.unique(keys)}
