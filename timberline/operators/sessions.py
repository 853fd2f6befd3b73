"""Activity of an entity, cut into sessions at gaps; one Cartesian tree serves any gap setting.

The tree of an entity has one node per maximal run of events whose inner gaps are all smaller than
the gaps at both its ends. For a gap setting T the sessions are the nodes with ``gap_us <= T`` and
``parent_gap_us > T``. Trees are built in chunks of time, so that a busy entity is spread over many
tasks; what a chunk cannot decide alone, the subtrees along its two edges, is merged per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = np.iinfo(np.int64).max
OPEN = -1
PIECE_ROWS = 1 << 18
_BLOCK = ("start_us", "end_us", "n_events", "gap_us")


def cartesian(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes of the Cartesian tree (largest gap at the root) over blocks with ``gaps`` between.

    Returns first block, last block and gap of each node; equal gaps make one node of many children.
    """
    first, last, gap = [], [], []
    stack: list[tuple[int, int]] = []  # (gap, first block) of the open nodes, gaps falling
    for i, g in enumerate(gaps.tolist()):
        start = i
        while stack and stack[-1][0] < g:
            h, start = stack.pop()
            first.append(start)
            last.append(i)
            gap.append(h)
        if not stack or stack[-1][0] > g:
            stack.append((g, start))
    for h, start in reversed(stack):
        first.append(start)
        last.append(len(gaps))
        gap.append(h)
    return np.array(first, np.int64), np.array(last, np.int64), np.array(gap, np.int64)


def _pieces(batches: Iterator[pd.DataFrame], same: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches in pieces of about ``PIECE_ROWS``, rows that repeat the one before in all columns of
    ``same`` left out."""
    held: list[pd.DataFrame] = []
    size, last = 0, None
    for b in batches:
        if not len(b):
            continue
        if same:
            keep = _starts(b, same)
            if last is not None and all(last[c] == b[c].iloc[0] for c in same):
                keep[0] = False
            last = b.iloc[-1]
            b = b[keep]
        held.append(b)
        size += len(b)
        if size >= PIECE_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no group of the key columns is spread over two of them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        at = int(np.flatnonzero(_starts(b, keys))[-1])
        if held and at == 0 and all(held[-1][c].iloc[-1] == b[c].iloc[0] for c in keys):
            held.append(b)
            continue
        whole = pd.concat([*held, b.iloc[:at]], ignore_index=True)
        if len(whole):
            yield whole
        held = [b.iloc[at:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _blocks(pdf: pd.DataFrame, keys: list[str], least: int) -> pd.DataFrame:
    """Sorted events to blocks: gaps up to ``least`` never separate."""
    new = _starts(pdf, keys)
    us = pdf["us"].to_numpy()
    cut = new.copy()
    cut[1:] |= np.diff(us) > least
    at = np.flatnonzero(cut)
    stop = np.append(at[1:], len(us))
    gap = np.diff(us, prepend=us[:1])
    gap[at] = 0
    out = pdf.iloc[at][keys].reset_index(drop=True)
    return out.assign(start_us=us[at], end_us=us[stop - 1], n_events=stop - at, gap_us=np.maximum.reduceat(gap, at) if len(at) else gap[:0], first=new[at])


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in keys:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _nodes(b: pd.DataFrame, keys: list[str], most: int, open_ends: bool) -> pd.DataFrame:
    """Nodes of sorted blocks; ``first`` marks where an entity (or its chunk) begins.

    Gaps beyond ``most`` end a run. With ``open_ends`` the first and last run of each entity are not
    final: of them only the subtrees that touch neither end are nodes, and what remains, their roots
    and the outermost blocks, is handed on as blocks whose parent is ``OPEN``.
    """
    start, end, n, inner, first = (b[c].to_numpy() for c in (*_BLOCK, "first"))
    gap_before = np.empty(len(b), np.int64)
    gap_before[0] = INF
    gap_before[1:] = start[1:] - end[:-1]
    gap_before[first] = INF
    run = first | (gap_before > most)
    at = np.flatnonzero(run)
    stop = np.append(at[1:], len(b))
    gap_after = np.append(gap_before[1:], INF)
    left_open = first[at] & open_ends
    right_open = np.append(first, True)[stop] & open_ends
    piece = run.copy()  # where a subtree begins
    several = (stop - at > 1) & (left_open | right_open)
    for i, j, lo, ro in zip(at[several].tolist(), stop[several].tolist(), left_open[several].tolist(), right_open[several].tolist(), strict=True):
        gaps = gap_before[i + 1 : j]
        if lo:  # gaps of nodes that touch an open end
            piece[i + 1 : j] |= gaps >= np.maximum.accumulate(gaps)
        if ro:
            piece[i + 1 : j] |= (gaps[::-1] >= np.maximum.accumulate(gaps[::-1]))[::-1]
    # all subtrees at once: as one tree in which they are apart by gaps without end, whose node is none of theirs
    f, l, g = cartesian(np.where(piece, INF, gap_before)[1:])
    f, l, g = f[g < INF], l[g < INF], g[g < INF]
    k = np.arange(len(b))
    f, l, g = np.concatenate([k, f]), np.concatenate([k, l]), np.concatenate([inner, g])
    root = piece[f] & np.append(piece, True)[l + 1] & np.repeat(left_open | right_open, stop - at)[f]
    total = np.concatenate([[0], np.cumsum(n)])
    out = b.iloc[f][keys].reset_index(drop=True)
    parent = np.where(root, OPEN, np.minimum(gap_before[f], gap_after[l]))
    return out.assign(start_us=start[f], end_us=end[l], n_events=total[l + 1] - total[f], gap_us=g, parent=parent)[[*keys, *_BLOCK, "parent"]]


def gap_tree(events: DataFrame, entity: list[str], us: str, ids: list[str] | None = None, least_us: int = 0, most_us: int = 86_400_000_000, chunk_us: int = 6 * 3_600_000_000) -> DataFrame:
    """(entity..., start_us, end_us, n_events, gap_us, parent_gap_us): the nodes that gap settings from
    ``least_us`` to ``most_us`` can select.

    Events with a null entity column or instant belong to no entity and are left out. With ``ids``,
    rows that agree in entity, instant and ids are one event. Events at the same instant are in one
    session. An empty table gives no rows; other columns of ``events`` may have any name.

    A task holds a piece of bounded rows, and then the blocks that an entity's chunks leave open: at
    most ``chunk_us / least_us`` of a chunk, as blocks are further apart than ``least_us``.
    """
    ids = ids or []
    keys = [f"k{i}" for i in range(len(entity))]
    id_names = [f"i{i}" for i in range(len(ids))]
    src = events.select(*[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)], *[F.col(c).cast("string").alias(k) for c, k in zip(ids, id_names, strict=True)], F.col(us).cast("bigint").alias("us"))
    src = src.dropna(subset=[*keys, "us"]).withColumn("chunk", F.floor(F.col("us") / chunk_us).cast("bigint"))
    if ids:  # null ids are a value like any other
        src = src.fillna("\0", subset=id_names)
    kinds = dict(src.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_us bigint, end_us bigint, n_events bigint, gap_us bigint, parent bigint"
    order = [*keys, "chunk"]
    columns = [*keys, "chunk", *_BLOCK, "parent"]

    def in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches, [*order, "us", *id_names] if ids else []):
            # what a chunk has decided is spread by its number, what is left meets its entity's rest
            out = _nodes(_blocks(pdf, order, least_us), order, most_us, True)
            yield out.assign(chunk=out["chunk"].where(out["parent"] != OPEN, -INF))[columns]

    def over_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sorted_groups(batches, order):
            done = pdf["parent"] != OPEN
            yield pdf[done][[*keys, *_BLOCK, "parent"]]
            left = pdf[~done].reset_index(drop=True)
            if len(left):
                yield _nodes(left.assign(first=_starts(left, keys)), keys, most_us, False)

    parts = src.repartition(*order).sortWithinPartitions(*order, "us", *id_names).mapInPandas(in_chunks, schema.replace(", start_us", ", chunk bigint, start_us"))
    parts = parts.filter((F.col("parent") == OPEN) | (F.col("parent") > least_us))
    nodes = parts.repartition(*order).sortWithinPartitions(*order, "start_us").mapInPandas(over_chunks, schema).filter(F.col("parent") > least_us)
    return nodes.select(*[F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)], "start_us", "end_us", "n_events", "gap_us", F.when(F.col("parent") <= most_us, F.col("parent")).alias("parent_gap_us"))


def sessions_at(tree: DataFrame, gap_us: int) -> DataFrame:
    """The sessions of a tree for one gap setting: a session ends where more than ``gap_us`` pass."""
    return tree.filter((F.col("gap_us") <= gap_us) & F.coalesce(F.col("parent_gap_us") > gap_us, F.lit(True))).drop("gap_us", "parent_gap_us").withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def sessionize(events: DataFrame, entity: list[str], us: str, gap_us: int, ids: list[str] | None = None) -> DataFrame:
    """(entity..., start_us, end_us, n_events, duration_us) for one gap setting; see :func:`gap_tree`.

    Only this gap can be selected, so the trees are of single blocks.
    """
    return sessions_at(gap_tree(events, entity, us, ids, gap_us, gap_us), gap_us)
