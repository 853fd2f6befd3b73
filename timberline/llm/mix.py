"""Mixing sources to target shares of tokens, over shards of an exact and reproducible draw.

Each source's documents fall into blocks of about equal tokens by a seeded hash, a permutation that
nothing has to sort. A source's quota is a number of whole passes over its blocks and a part of one more,
which ends inside one block as near to the quota as a document can bring it. How many block uses of each source a shard gets is
drawn by a splitting tree: a node halves its shards and draws the left half's counts from the
multivariate hypergeometric distribution, so the counts of all shards add up exactly. The tree's upper
nodes are drawn on the driver and the rest in tasks, which deal the uses of each shard out of a
permutation that is computed and not stored; documents are then shuffled inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.encode import with_token_counts
from timberline.session import shared_folder

BLOCK_TOKENS = 1 << 16  # of a block, more where a source would have over MOST_USES blocks
MOST_USES = 1 << 27
SHARD_TOKENS = 1 << 25
ROOTS = 256  # subtrees that tasks expand
FAN = 1024  # parts that one step of a search for a block looks at


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def quotas(targets: list[Target], available: dict[str, int], total: int) -> dict[str, int]:
    """Tokens of each source: its share of ``total`` where that many can be drawn, else all that can.

    What short sources leave is taken up by the others in proportion to their shares, so that among the
    sources that can reach them the shares keep their ratios. Sources without documents get nothing.
    """
    room = {t.source: available.get(t.source, 0) * t.repeats for t in targets}
    share = {t.source: t.share for t in targets if t.share > 0 and room[t.source] > 0}
    out = {t.source: 0 for t in targets}
    left = total
    while share:
        whole = sum(share.values())
        short = [s for s, p in share.items() if room[s] <= left * p / whole]
        if not short:
            for s, p in share.items():
                out[s] = round(left * p / whole)
            break
        for s in short:
            out[s] = room[s]
            left -= room[s]
            del share[s]
        left = max(left, 0)
    return out


def reachable(targets: list[Target], available: dict[str, int]) -> int:
    """The largest total at which every source that has documents reaches its share."""
    room = [available.get(t.source, 0) * t.repeats / t.share for t in targets if t.share > 0 and available.get(t.source, 0) * t.repeats > 0]
    return int(min(room) * (1 - sum(t.share for t in targets if available.get(t.source, 0) * t.repeats == 0))) if room else 0


Node = tuple[int, int, list[int], list[int]]  # first shard, shards, block uses of each source, and how many are left of them


def halves(node: Node, seed: int) -> tuple[Node, Node]:
    """The two halves of a node's shards, with the block uses that each of them gets."""
    first, shards, counts, before = node
    left = shards // 2
    counts, n = np.array(counts, np.int64), sum(counts)
    rng = np.random.default_rng([seed, first, shards])
    drawn = rng.multivariate_hypergeometric(counts, n * left // shards) if n else np.zeros_like(counts)
    return (first, left, drawn.tolist(), before), (first + left, shards - left, (counts - drawn).tolist(), (np.array(before) + drawn).tolist())


def leaves(node: Node, seed: int) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        if node[1] == 1:
            yield node
        else:
            todo.extend(reversed(halves(node, seed)))


def permuted(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A fixed permutation of 0 .. n - 1 at some positions: four Feistel rounds, repeated until below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), positions.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            mixed = (b + np.uint64(seed * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Of a source: its blocks, whole passes over them, and the blocks of one more pass, of whose last one
    only some tokens are used (none where ``part`` is 0)."""

    source: str
    blocks: int
    passes: int
    more: int
    part: int

    @property
    def uses(self) -> int:
        return self.passes * self.blocks + self.more


_USES = "source string, block bigint, pass int, shard int, last boolean"


def _deal(plans: list[Plan], seed: int):
    """Expands nodes of the tree to the block uses of their shards."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for shard, _, counts, before in leaves((r.first, r.shards, list(r.counts), list(r.before)), seed):
                    for j, p in enumerate(plans):
                        if counts[j]:
                            use = permuted(np.arange(before[j], before[j] + counts[j]), p.uses, seed + j)
                            k, block = np.divmod(use, p.blocks)
                            yield pd.DataFrame({"source": p.source, "block": block, "pass": k, "shard": shard, "last": (use == p.uses - 1) & (p.part > 0)})

    return deal


def _search(placed: DataFrame, rest: dict[str, int], blocks: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Of each source, the block in which its first ``rest`` tokens end, in the order of blocks, and how
    many of them are in it. Each step sums at most ``FAN`` parts of a source."""
    low, high, left = dict.fromkeys(rest, 0), {s: blocks[s] for s in rest}, dict(rest)
    while wide := {s: math.ceil((high[s] - low[s]) / FAN) for s in rest if high[s] - low[s] > 1}:
        rows = [(s, low[s], high[s], wide[s]) for s in wide]
        bounds = placed.sparkSession.createDataFrame(rows, "source string, low bigint, high bigint, wide bigint")
        near = placed.join(F.broadcast(bounds), "source").filter("block >= low and block < high")  # a row for each source
        sums: dict[str, dict[int, int]] = {s: {} for s in wide}
        for r in near.groupBy("source", F.expr("(block - low) div wide").alias("i")).agg(F.sum("n_tokens").alias("t")).collect():
            sums[r["source"]][r["i"]] = r["t"]
        for s, w in wide.items():
            i = 0
            for i in sorted(sums[s]):
                if sums[s][i] >= left[s]:
                    break
                left[s] -= sums[s][i]
            low[s], high[s] = low[s] + i * w, min(high[s], low[s] + (i + 1) * w)
    return {s: (low[s], left[s]) for s in rest}


def _targets(targets: DataFrame) -> list[Target]:
    rows = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.first("target_share").alias("p"), F.first("max_repeats").alias("r")).collect()
    whole = sum(r["p"] for r in rows) or 1.0
    return [Target(r["source"], r["p"] / whole, max(0, r["r"] or 0)) for r in sorted(rows, key=lambda r: r["source"])]


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, doc: str = "doc_id", text: str = "text", source: str = "source", shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, position, doc_id, source, pass, n_tokens): every use of a document.

    ``total`` tokens are drawn, by default the most at which every source with documents reaches its
    share, see :func:`reachable`. ``targets`` has source,
    target_share and max_repeats, a table of bounded size. A document is in one pass at most once, and
    passes never exceed max_repeats. Documents without an id, a source or any token are never drawn, nor
    are sources that ``targets`` doesn't list; rows that repeat an id in a source are one document.
    Sources that cannot reach their share of a given total give all they can (see :func:`quotas`).
    """
    spark = docs.sparkSession
    shared_folder(spark, "mix")
    goals = _targets(targets)
    mine = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("doc_id is not null")
    listed = mine.join(targets.select(F.col("source").alias("_s")).distinct(), F.col("source") == F.col("_s"), "left_semi")
    counted = with_token_counts(listed, "text", "n_tokens", ["doc_id", "source"]).filter("n_tokens > 0").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    counted = counted.withColumn("hash", F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))).checkpoint()
    available = {r["source"]: r["t"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row for each target
    size = max(block_tokens, sum(available.values()) // MOST_USES)
    blocks = {s: max(1, math.ceil(t / size)) for s, t in available.items()}
    count_of = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else F.create_map(F.lit(""), F.lit(1))
    # blocks are ranges of the hash
    unit = F.shiftrightunsigned("hash", 11).cast("double") / float(1 << 53)
    placed = counted.withColumn("block", F.floor(unit * F.try_element_at(count_of, F.col("source"))).cast("bigint"))
    quota = quotas(goals, available, reachable(goals, available) if total is None else total)
    drawn = {s: divmod(q, available[s]) for s, q in quota.items() if q}
    ends = _search(placed, {s: rest for s, (_, rest) in drawn.items() if rest}, blocks)
    plans = [Plan(s, blocks[s], k, ends[s][0] + 1 if rest else 0, ends[s][1] if rest else 0) for s, (k, rest) in sorted(drawn.items())]
    shards = max(1, math.ceil(sum(quota.values()) / shard_tokens))
    nodes: list[Node] = [(0, shards, [p.uses for p in plans], [0] * len(plans))]
    while len(nodes) < ROOTS and any(n[1] > 1 for n in nodes):
        nodes = [x for n in nodes for x in (halves(n, seed) if n[1] > 1 else (n,))]
    roots = spark.createDataFrame(nodes, "first int, shards int, counts array<bigint>, before array<bigint>").repartition(min(len(nodes), ROOTS))
    uses = roots.mapInPandas(_deal(plans, seed), _USES)
    # of the block that a source uses in part: documents in permuted order while they fit, and the one more
    # that comes nearest to what is left
    parts = spark.createDataFrame([(p.source, p.more - 1, p.part) for p in plans if p.part], "source string, block bigint, part bigint")
    marked = placed.join(F.broadcast(parts), ["source", "block"], "left")  # a row for each source
    block = Window.partitionBy("source")
    ended = marked.filter("part is not null").withColumn("upto", F.sum("n_tokens").over(block.orderBy("hash", "doc_id"))).withColumn("fits", F.col("upto") <= F.col("part"))
    ended = ended.withColumn("left", F.col("part") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(block), F.lit(0)))
    near = F.struct(F.abs(F.col("n_tokens") - F.col("left")).alias("off"), "hash", "doc_id")
    nearest = F.min(F.when(~F.col("fits"), near)).over(block)
    ended = ended.withColumn("early", F.col("fits") | F.coalesce((near == nearest) & (nearest["off"] < F.col("left")), F.lit(False))).drop("upto", "fits", "left")
    every = marked.filter("part is null").withColumn("early", F.lit(True)).unionByName(ended).drop("part")
    taken = every.join(uses, ["source", "block"]).filter("early or not last")
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("doc_id"), F.col("pass")), "source", "doc_id", "pass")
    return taken.withColumn("position", F.row_number().over(inside) - 1).select("shard", "position", "doc_id", "source", "pass", "n_tokens")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, most_uses, n_tokens, share) of a mix; a target
    source that gave nothing has zeros."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"), F.sum("t").alias("n_tokens"))
    whole = per.agg(F.sum("n_tokens").alias("whole"))
    zero = {"n_documents": 0, "most_uses": 0, "n_tokens": 0}
    rows = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(zero)
    total = F.coalesce(whole.scalar(), F.lit(0))
    return rows.select("source", "target_share", "max_repeats", "n_documents", "most_uses", "n_tokens", F.round(F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), total.cast("double")), F.lit(0.0)), 6).alias("share"))
