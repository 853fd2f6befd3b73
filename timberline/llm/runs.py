"""Runs of repeated consecutive events, collapsed into one row each.

One state machine walks the events of each entity in order and compares every event with the anchor of
the current run, its first event. It works in chunks of the order column, so a busy entity is spread over
tasks. What a chunk cannot decide alone are the events before its first sure cut, a place where every run
ends whatever its anchor is: there an exact column changes, or more time passes than a run allows. These
events, with equal neighbours already as one, and the last run of each chunk meet in one more walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 17
HEAD, TAIL, DONE = 0, 1, 2  # undecided events at a chunk's begin; its last run; a finished run
EDGE = -(1 << 62)  # the chunk number under which an entity's undecided rows meet


def masked_words(text: Column) -> Column:
    """Lower-cased words between white space, every word that has a digit as ``0``."""
    masked = F.regexp_replace(F.lower(text), r"(?U)(?<!\S)[^\s\d]*+\d\S*+", "0")
    return F.regexp_replace(F.regexp_replace(masked, r"(?U)\s+", " "), r"^ | $", "")


def word_agreement(a: str | None, b: str | None) -> float:
    """Share of the positions of the longer text at which both have the same word; null agrees with null only."""
    if a == b:
        return 1.0
    if a is None or b is None:
        return 0.0
    x, y = a.split(), b.split()
    most = max(len(x), len(y))
    return sum(map(str.__eq__, x, y)) / most if most else 1.0


class _Run:
    """A run, or several equal events in a row. ``known`` and ``seen``: its first and last known instant."""

    __slots__ = ("exact", "first", "high", "known", "last", "low", "n", "seen", "text")

    def __init__(self, exact: tuple, text: str | None, first: int, last: int, n: int, low: int | None, high: int | None, known: int | None, seen: int | None):
        self.exact, self.text, self.first, self.last, self.n = exact, text, first, last, n
        self.low, self.high, self.known, self.seen = low, high, known, seen

    def take(self, other: _Run) -> None:
        self.last, self.n = other.last, self.n + other.n
        if other.known is not None:
            if self.seen is None:
                self.low, self.high, self.known = other.low, other.high, other.known
            else:
                self.low, self.high = min(self.low, other.low), max(self.high, other.high)
            self.seen = other.seen

    def row(self) -> tuple:
        return self.first, self.last, self.n, self.low, self.high, self.known, self.seen


class _Machine:
    def __init__(self, similarity: float, max_gap_us: int | None):
        self.similarity, self.most = similarity, max_gap_us

    def late(self, seen: int | None, now: int | None) -> bool:
        return self.most is not None and seen is not None and now is not None and now - seen > self.most

    def joins(self, run: _Run, event: _Run) -> bool:
        """Whether the event is like the run's anchor and soon enough after its last event."""
        return run.exact == event.exact and not self.late(run.seen, event.known) and (run.text == event.text or (self.similarity < 1 and word_agreement(run.text, event.text) >= self.similarity))

    def equal(self, item: _Run, event: _Run) -> bool:
        """Whether any run that takes ``item`` takes the event after it, too, and the other way round."""
        return item.text == event.text and (self.most is None or event.known is None or (item.seen is not None and not self.late(item.seen, event.known)))


_FIELDS = ("first", "last", "n", "low", "high", "known", "seen", "h", "g", "text")
_TAIL = "chunk bigint, role int, first bigint, last bigint, n bigint, low bigint, high bigint, known bigint, seen bigint, h bigint, g int, text string"


def _batch(rows: list[tuple], keys: list[pa.Field]) -> pa.RecordBatch:
    kinds = [f.type for f in keys] + [pa.int64(), pa.int32()] + [pa.int64()] * 8 + [pa.int32(), pa.string()]
    names = [f.name for f in keys] + [x.split()[0] for x in _TAIL.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _walk(n_keys: int, machine: _Machine, least: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, run, head, order, before = None, None, True, None, None
        fields: list[pa.Field] = []
        out: list[tuple] = []

        def put(role: int) -> None:
            if role != DONE:
                out.append((*group[:-1], EDGE, role, *run.row(), *run.exact, run.text))
            elif run.n >= least:
                out.append((*group, DONE, *run.row(), None, None, None))

        for batch in batches:
            fields = [batch.schema.field(i) for i in range(n_keys - 1)]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, o, h, g, text, us in zip(*columns, strict=True):
                event = _Run((h, g), text, o, o, 1, us, us, us, us)
                if key != group:
                    if group is not None:
                        put(HEAD if head else TAIL)
                    group, run, head = key, event, True
                elif o == order:
                    continue
                elif head and (event.exact != run.exact or machine.late(before, us)):
                    put(HEAD)
                    run, head = event, False
                elif machine.equal(run, event) if head else machine.joins(run, event):
                    run.take(event)
                else:
                    put(HEAD if head else DONE)
                    run = event
                order, before = o, us
            yield _batch(out, fields)
            out.clear()
        if group is not None:
            put(HEAD if head else TAIL)
            yield _batch(out, fields)

    return walk


def _meet(n_keys: int, machine: _Machine, least: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, run = None, None
        fields: list[pa.Field] = []
        out: list[tuple] = []

        def put() -> None:
            if run.n >= least:
                out.append((*entity, DONE, DONE, *run.row(), None, None, None))

        for batch in batches:
            fields = [batch.schema.field(i) for i in range(n_keys)]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, chunk, role, first, last, n, low, high, known, seen, h, g, text in zip(*columns, strict=True):
                if role == DONE:
                    out.append((*key, chunk, DONE, first, last, n, low, high, known, seen, None, None, None))
                    continue
                event = _Run((h, g), text, first, last, n, low, high, known, seen)
                if key == entity and role == HEAD and machine.joins(run, event):
                    run.take(event)
                    continue
                if entity is not None:
                    put()
                entity, run = key, event
            yield _batch(out, fields)
            out.clear()
        if entity is not None:
            put()
            yield _batch(out, fields)

    return meet


def collapse_runs(df: DataFrame, entity: list[str], order: str, same: list[Column], text: Column | None = None, similarity: float = 1.0, us: str | None = None, max_gap_us: int | None = None, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(entity..., first, last, n, start_us, end_us, duration_us): one row per longest run of at least
    ``least`` consecutive events of an entity that are like the run's first event.

    An event is like it if all columns of ``same`` agree, where nulls agree with nulls, and if the words of
    ``text`` agree at ``similarity`` of their positions or more, see :func:`word_agreement`. Rows with a
    null entity or order value belong to no sequence. Rows that repeat an (entity, order) value are one
    event (the one of the smallest instant counts). With ``max_gap_us`` a run also ends where more time than that has
    passed since its last known instant; a null instant never ends one. start_us and end_us are the
    smallest and largest known instant, null without ``us``. An empty table gives no rows.

    A task holds one run and one batch, whatever the sequence is. The second walk is over what chunks leave
    undecided; where no chunk of an entity has a sure cut, that is each of its changes of text.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))
    exact = [mark(c) for c in [*same, *([text] if text is not None and similarity >= 1 else [])]] or [F.lit("")]
    instant = F.col(us) if us else F.lit(None)
    src = df.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)],
        F.floor(F.col(order).cast("bigint") / chunk).cast("bigint").alias("chunk"),
        F.col(order).cast("bigint").alias("o"),
        F.xxhash64(*exact).alias("h"),
        F.hash(*exact[::-1]).alias("g"),
        (text if text is not None and similarity < 1 else F.lit(None)).cast("string").alias("text"),
        instant.cast("bigint").alias("us"),
    ).dropna(subset=[*keys, "o"])
    kinds = dict(src.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), _TAIL])
    machine = _Machine(similarity, max_gap_us)
    group = [*keys, "chunk"]
    parts = src.repartition(*group).sortWithinPartitions(*group, "o", F.asc_nulls_last("us"), "h", "text").mapInArrow(_walk(len(group), machine, least), schema)
    # finished runs are spread by their chunks
    rows = parts.repartition(*group).sortWithinPartitions(*group, "first").mapInArrow(_meet(len(keys), machine, least), schema)
    return rows.select(*[F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)], "first", "last", "n", F.col("low").alias("start_us"), F.col("high").alias("end_us"), (F.col("high") - F.col("low")).alias("duration_us"))
