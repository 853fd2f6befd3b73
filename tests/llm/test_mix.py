import os
import random
from collections import Counter

import numpy as np
import pytest

from timberline.llm import encode, mix, queries

DOCS = "doc_id bigint, text string, source string, n_tokens string, shard int"
TARGETS = "source string, target_share double, max_repeats int, n_tokens int"

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")


def test_quotas_fill_up_and_keep_ratios():
    t = [mix.Target("a", 0.5, 1), mix.Target("b", 0.3, 1), mix.Target("c", 0.2, 3), mix.Target("d", 0.0, 1), mix.Target("e", 0.1, 0)]
    q = mix.quotas(t, {"a": 1000, "b": 1000, "c": 20, "d": 99, "e": 9}, 1000)
    assert q["c"] == 60 and q["d"] == 0 and q["e"] == 0
    assert q["a"] + q["b"] == 940 and abs(q["a"] / q["b"] - 5 / 3) < 0.01
    assert mix.quotas([], {}, 10) == {}
    assert mix.reachable(t[:3], {"a": 1000, "b": 1000, "c": 20}) == 300


def shares_of(counts, shards, seed):
    found = list(mix.leaves((0, shards, counts, [0] * len(counts)), seed))
    assert [n[0] for n in found] == list(range(shards))
    return np.array([n[2] for n in found]), np.array([n[3] for n in found])


def test_split_is_exact_and_fair():
    counts = [100, 7, 0, 33]
    got, before = shares_of(counts, 6, 1)
    assert got.shape == (6, 4) and (got.sum(0) == counts).all() and (got >= 0).all()
    assert (np.cumsum(got, 0)[:-1] == before[1:]).all() and (before[0] == 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 2
    mean = np.mean([shares_of(counts, 6, s)[0][0] for s in range(300)], axis=0)
    assert np.allclose(mean, np.array(counts) * (got.sum(1)[0] / sum(counts)), rtol=0.1)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    out = mix.permuted(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 100 or (out.tolist() != list(range(n)) and (mix.permuted(np.arange(n), n, 6) != out).any())
    assert n < 100 or abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.1


def test_search_for_the_last_block(spark, monkeypatch):
    monkeypatch.setattr(mix, "FAN", 3)
    r = random.Random(4)
    docs = [(s, r.randrange(50), r.randrange(1, 9)) for s in "ab" for _ in range(300)]
    df = spark.createDataFrame(docs, "source string, block bigint, n_tokens bigint")
    for share in (0.01, 0.4, 0.99):
        rest = {s: max(1, int(share * sum(t for q, _, t in docs if q == s))) for s in "ab"}
        for s, (block, left) in mix._search(df, rest, {"a": 50, "b": 50}).items():
            ahead = sum(t for q, b, t in docs if q == s and b < block)
            here = sum(t for q, b, t in docs if q == s and b == block)
            assert left == rest[s] - ahead and 0 < left <= here


@needs_vocabulary
def test_shares_reach_their_targets(spark):
    """Of the sources that have documents; the share of one that has none goes to the others."""
    got = {r["source"]: r for r in queries.p7_shares(spark, "/root/testdata/sf0.01").collect()}
    have = {s: r for s, r in got.items() if r["n_documents"]}
    whole = sum(r["target_share"] for r in have.values())
    assert len(have) >= 10
    assert all(r["most_uses"] <= r["max_repeats"] for r in have.values())
    assert all(abs(r["share"] * whole / r["target_share"] - 1) < 0.02 for r in have.values()), have


@needs_vocabulary
def test_mix(spark):
    r = np.random.default_rng(3)
    docs = [(i, " word" * int(r.integers(1, 40)), "ab"[i % 2] if i % 20 else "c", "x", 1) for i in range(2000)]
    docs += [(5001, None, "a", "x", 1), (5002, "", "a", "x", 1), (None, "lost", "a", "x", 1), (5003, "text", None, "x", 1), (5004, "text", "unlisted", "x", 1), docs[1], docs[1]]
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.2, 2, 1), ("c", 0.2, 3, 1), ("none", 0.1, 2, 1), (None, 0.1, 2, 1)], TARGETS)
    df = spark.createDataFrame(docs, DOCS)
    out = mix.mix(df, targets, total=20_000, shard_tokens=4000, block_tokens=300).cache()
    rows = out.collect()
    tokens = {s: sum(x["n_tokens"] for x in rows if x["source"] == s) for s in "abc"}
    have = {s: sum(len(t.split()) for t in {d: t for d, t, q, *_ in docs if q == s and d is not None and t}.values()) for s in "abc"}
    want = mix.quotas([mix.Target("a", 0.5, 1), mix.Target("b", 0.2, 2), mix.Target("c", 0.2, 3)], have, 20_000)
    for s in "abc":
        assert abs(tokens[s] - want[s]) <= 40, s
    uses = Counter((x["source"], x["doc_id"]) for x in rows)
    assert all(n <= {"a": 1, "b": 2, "c": 3}[s] for (s, _), n in uses.items())
    assert {x["doc_id"] for x in rows}.isdisjoint({5001, 5002, 5003, 5004, None})
    assert len({(x["source"], x["doc_id"], x["pass"]) for x in rows}) == len(rows)
    by = {}
    for x in rows:
        by.setdefault(x["shard"], []).append(x["position"])
    assert len(by) == 5 and all(sorted(p) == list(range(len(p))) for p in by.values())
    again = mix.mix(df.repartition(7), targets, total=20_000, shard_tokens=4000, block_tokens=300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    shares = {x["source"]: x for x in mix.mix_shares(out, targets).collect()}
    assert shares["none"]["n_tokens"] == 0 and abs(sum(x["share"] for x in shares.values()) - 1) < 1e-4


@needs_vocabulary
def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1, 1)], TARGETS)
    out = mix.mix(spark.createDataFrame([], DOCS), targets)
    assert out.count() == 0
    assert [tuple(r) for r in mix.mix_shares(out, targets).collect()] == [("a", 1.0, 1, 0, 0, 0, 0.0)]
