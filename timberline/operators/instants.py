"""Mixed timestamp formats and zones, normalised to UTC instants.

Each text yields the array of all its valid readings (functions/instants.py), and one path through the
arrays of a source, in its order of records, is chosen by Viterbi: a step back in time, a change of the
format and a change to the second pass of a repeated hour cost. A record of one reading splits the path
exactly, so only records that stand in a repeated hour, and the sources in which a text has several
formats, are shuffled for it. They go in chunks of consecutive lines: each chunk's costs from its first
to its last record are a small matrix, the matrices of a source give the readings at the borders, and
with these each chunk is walked on its own. No source has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.instants import ORDERS, with_readings
from timberline.session import shared_folder

BACK, SWITCH = 2.0, 1.0
CHUNK_LINES = 1 << 17

Reading = tuple[int, int, int]  # layout, pass, instant
_ENDS = "unit0 bigint, reads0 array<bigint>, unit1 bigint, reads1 array<bigint>, costs array<double>"
_KEY = ["source", "part", "chunk"]


def entry_cost(reading: Reading) -> float:
    return SWITCH if reading[1] == 2 else 0.0


def step_cost(a: Reading, b: Reading, unit: int) -> float:
    """Of the reading ``b`` after ``a``; ``unit`` is the coarser precision of the two texts."""
    back = BACK if b[2] // unit < a[2] // unit else 0.0
    return back + (SWITCH if a[0] != b[0] else 0.0) + (SWITCH if b[1] == 2 and a[1] != 2 else 0.0)


def _preferred(reading: Reading) -> tuple[int, int]:
    """Of equally good paths: earlier layouts, and the earliest change to the second pass."""
    return reading[0], -reading[1]


def best_path(rows: list[list[Reading]], units: list[int], first: int | None = None, last: int | None = None) -> list[int]:
    """The reading of each row on the cheapest path, which begins and ends at given readings if asked for."""
    cost = [entry_cost(r) if first is None or j == first else np.inf for j, r in enumerate(rows[0])]
    back: list[list[int]] = []
    for i in range(1, len(rows)):
        unit = max(units[i - 1], units[i])
        came, now = [], []
        for b in rows[i]:
            options = [(cost[j] + step_cost(a, b, unit), *_preferred(a), j) for j, a in enumerate(rows[i - 1])]
            least = min(options)
            now.append(least[0])
            came.append(least[-1])
        cost = now
        back.append(came)
    at = min((cost[j], *_preferred(r), j) for j, r in enumerate(rows[-1]))[-1] if last is None else last
    out = [at]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def cost_matrix(rows: list[list[Reading]], units: list[int]) -> np.ndarray:
    """Cheapest way from each reading of the first row to each of the last."""
    cost = np.where(np.eye(len(rows[0]), dtype=bool), 0.0, np.inf)
    for i in range(1, len(rows)):
        unit = max(units[i - 1], units[i])
        step = np.array([[step_cost(a, b, unit) for b in rows[i]] for a in rows[i - 1]])
        cost = (cost[:, :, None] + step[None]).min(axis=1)
    return cost


def _walks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], list[list[Reading]]]]:
    """Of each chunk of a batch: its row, lines, precisions and readings, a line delivered again once."""
    packed = batch.column("rows")
    flat = packed.flatten()
    lines, units, reads = (flat.field(k) for k in range(3))
    cuts = np.asarray(packed.offsets) - packed.offsets[0].as_py()
    of = np.asarray(reads.offsets) - reads.offsets[0].as_py()
    triple = reads.flatten()
    triple = list(zip(*(triple.field(k).to_pylist() for k in range(3)), strict=True))
    lines, units = lines.to_pylist(), units.to_pylist()
    for i in range(batch.num_rows):
        rows = [k for k in range(cuts[i], cuts[i + 1]) if k == cuts[i] or lines[k] != lines[k - 1]]
        yield i, [lines[k] for k in rows], [units[k] for k in rows], [triple[of[k] : of[k + 1]] for k in rows]


def _chunk_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_KEY, *(x.split()[0] for x in _ENDS.split(", "))]
    for batch in batches:
        if batch.num_rows:
            found = [(units[0], [x for r in rows[0] for x in r], units[-1], [x for r in rows[-1] for x in r], cost_matrix(rows, units).ravel().tolist()) for _, _, units, rows in _walks(batch)]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _KEY), *(pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True))], names=names)


def _triples(flat: list[int]) -> list[Reading]:
    return [tuple(flat[k : k + 3]) for k in range(0, len(flat), 3)]


def border_readings(ends: pd.DataFrame) -> list[tuple[int, int]]:
    """Of each of a source's chunks, in order, its first and last reading on the cheapest path."""
    cost, came, before = None, [], None
    for r in ends.itertuples():
        first, last = _triples(list(r.reads0)), _triples(list(r.reads1))
        inside = np.array(r.costs).reshape(len(first), len(last))
        if before is None:
            start, link = np.array([entry_cost(x) for x in first]), None
        else:
            unit = max(before[1], r.unit0)
            options = [[(cost[j] + step_cost(a, b, unit), *_preferred(a), j) for j, a in enumerate(before[0])] for b in first]
            link = [min(o)[-1] for o in options]
            start = np.array([min(o)[0] for o in options])
        total = start[:, None] + inside
        via = [min((total[f, l], *_preferred(first[f]), f) for f in range(len(first)))[-1] for l in range(len(last))]
        cost = [total[f, l] for l, f in enumerate(via)]
        came.append((link, via))
        before = (last, r.unit1)
    at = min((cost[j], *_preferred(x), j) for j, x in enumerate(before[0]))[-1]
    out = []
    for link, via in reversed(came):
        out.append((via[at], at))
        at = link[via[at]] if link else at
    return out[::-1]


def _borders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame([(*key, c, f, l) for c, (f, l) in zip(pdf["chunk"], border_readings(pdf), strict=True)], columns=[*_KEY, "first", "last"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last = batch.column("first").to_pylist(), batch.column("last").to_pylist()
        source, out = batch.column("source").to_pylist(), []
        for i, lines, units, rows in _walks(batch):
            path = best_path(rows, units, first[i], last[i])
            out += [(source[i], n, r[j][2]) for n, r, j in zip(lines, rows, path, strict=True) if j]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["source", "line", "us"])


def chosen_readings(readings: DataFrame, orders: tuple[str, ...] = ("mdy",)) -> DataFrame:
    """(source, line, us) of the records for which another than the first of their readings is chosen.

    ``readings`` has (source, line) and the columns of :func:`with_readings`. Lines delivered again count once.
    """
    rows = readings.filter(F.col("line").isNotNull() & F.col("source").isNotNull() & (F.size("_reads") > 0))
    if len(set(orders) & set(ORDERS)) > 1:
        # any record can show the order of the others; sources without a text of two layouts need no path
        several = rows.filter(F.size(F.array_distinct("_reads.layout")) > 1).select(F.col("source").alias("_s")).distinct()
        rows = rows.join(several, F.col("source") == F.col("_s"), "left_semi").unionByName(rows.join(several, F.col("source") == F.col("_s"), "left_anti").filter("_fold is not null"))
        rows = rows.withColumn("part", F.lit(0).cast("bigint"))
    else:
        rows = rows.filter("_fold is not null").withColumn("part", F.col("_fold"))
    chunk = F.floor(F.col("line") / CHUNK_LINES).cast("bigint")
    packed = rows.groupBy("source", "part", chunk.alias("chunk")).agg(F.sort_array(F.collect_set(F.struct("line", F.col("_unit").alias("unit"), F.col("_reads").alias("reads")))).alias("rows"))
    key = "source string, part bigint, chunk bigint"
    ends = packed.mapInArrow(_chunk_ends, f"{key}, {_ENDS}")
    borders = ends.groupBy("source", "part").applyInPandas(_borders, f"{key}, first int, last int")
    return packed.join(borders, _KEY).mapInArrow(_choices, "source string, line bigint, us bigint")


def resolve_instants(df: DataFrame, files: DataFrame, out: str = "utc_us", text: str = "timestamp", source: str = "file_path", line: str = "line_number", zone: str = "time_zone", opened: str = "opened_at", orders: tuple[str, ...] = ("mdy",)) -> DataFrame:
    """``df`` with the column ``out``: microseconds since 1970 (UTC) of its timestamp text, or null.

    ``files`` gives each source's zone (null: UTC) and the instant at or just before its first line,
    from which years left out are counted; a source without a row there counts as UTC, and its texts
    without a year as no instants. ``orders`` says what numbers between slashes can be, "mdy", "dmy" or
    both, which the source's other records then decide. A row without a source or line number keeps its
    first reading. Null, empty, damaged and impossible texts, and readings that the zone's clock skips,
    give null. Duplicate rows are all kept. Other columns of ``df`` are untouched. The texts are read
    once, into a table of the shared folder.
    """
    spark = df.sparkSession
    dims = files.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("__src")).agg(F.first(zone).alias("__tz"), F.first(opened).alias("__op"))
    # the row travels packed, whatever its columns are called
    keep = [c for c in df.columns if c != out]
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(source).alias("source"), F.col(line).cast("bigint").alias("line"), F.col(text).alias("__text"))
    read = with_readings(packed.join(dims, F.col("source") == F.col("__src"), "left"), "__text", F.col("__tz"), F.col("__op"), orders)
    at = shared_folder(spark, "readings")
    read.select("row", "source", "line", "_unit", "_fold", F.size("_reads").alias("n"), F.get("_reads", F.lit(0))["us"].alias("us"), F.when((F.size("_reads") > 1) | F.col("_fold").isNotNull() | F.lit(len(orders) > 1), F.col("_reads")).alias("_reads")).write.parquet(at)
    table = spark.read.schema(_schema(packed)).parquet(at)
    chosen = chosen_readings(table.drop("row", "us", "n"), orders).select(F.col("source").alias("_s"), F.col("line").alias("_l"), F.col("us").alias("_us"))
    several = table.filter("n > 1").join(chosen, (F.col("source") == F.col("_s")) & (F.col("line") == F.col("_l")), "left").withColumn("us", F.coalesce("_us", "us"))
    every = table.filter("n <= 1").select("row", "us").unionByName(several.select("row", "us"))
    return every.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], F.col("us").alias(out))


def _schema(packed: DataFrame) -> str:
    row = packed.schema["row"].dataType.simpleString()
    return f"row {row}, source string, line bigint, _unit bigint, _fold bigint, n int, us bigint, _reads array<struct<layout:int,pass:int,us:bigint>>"
