"""Filters, counts and top-k over records of either pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import value_of

EQUAL = ("process", "event", "hostname", "pid")
GROUPS = ("process", "event", "user", "hostname", "hour")


def matches(pid: str | int | None = None, user: str | None = None, rhost: str | None = None, meta: dict[str, str] | None = None, message_contains: str | None = None, **equal: str | None) -> Column:
    """The conjunction of all options given; an empty option counts as not given.

    A metadata key that a record lacks compares as the text ``None``. The text search ignores case and
    knows no wildcards.
    """
    unknown = set(equal) - set(EQUAL)
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    parts = [F.col(k) == v for k, v in equal.items() if v]
    if pid not in (None, ""):
        parts.append(F.col("pid").cast("string") == str(pid))
    wanted = {k: v for k, v in (("user", user), ("rhost", rhost)) if v} | (meta or {})
    parts += [F.coalesce(value_of(F.col("metadata"), k), F.lit("None")) == v for k, v in wanted.items()]
    if message_contains:
        parts.append(F.contains(F.lower("message"), F.lit(message_contains.lower())))
    return reduce(Column.__and__, parts, F.lit(True))


def meta_args(args: list[str]) -> dict[str, str]:
    """``k=v`` arguments as a dictionary, split at the first ``=``; others are ignored."""
    return dict(a.split("=", 1) for a in args if "=" in a)


def hour_text(timestamp: Column) -> Column:
    """The hour as it is written: after a ``T`` if there is one, else in the third word."""
    after_t = F.substring_index(F.split(timestamp, "T")[1], ":", 1)
    words = F.filter(F.split(timestamp, r"\s+"), lambda w: w != "")
    return F.when(timestamp.contains("T"), after_t).when(F.size(words) >= 3, F.substring_index(F.try_element_at(words, F.lit(3)), ":", 1)).otherwise("unknown")


def group_key(by: str) -> Column:
    if by not in GROUPS:
        raise ValueError(f"group by one of {', '.join(GROUPS)}")
    key = value_of(F.col("metadata"), "user") if by == "user" else hour_text(F.col("timestamp")) if by == "hour" else F.col(by)
    return F.coalesce(key, F.lit("unknown"))


def count_by(records: DataFrame, by: str, limit: int = 100) -> DataFrame:
    """(key, count): the ``limit`` most frequent keys (0: all), of equal ones the one seen first."""
    counts = records.groupBy(group_key(by).alias("key")).agg(F.count("*").alias("count"), F.min(F.struct("file_path", "line_number")).alias("seen"))
    if limit:
        counts = counts.orderBy(F.desc("count"), "seen").limit(limit)
    return counts.select("key", "count")


def first_rows(records: DataFrame, limit: int = 100, order: tuple[str, ...] = ("file_path", "line_number")) -> DataFrame:
    """The first rows in input order."""
    ordered = records.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def flattened(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scalar columns and ``meta.<key>`` columns, all sorted by name; what is missing is ''.

    ``keys``: the metadata keys; by default those that occur, which takes one pass over the records.
    """
    if keys is None:
        keys = sorted(r[0] for r in records.select(F.explode("metadata").alias("m")).select("m.key").distinct().collect())
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in records.columns if c != "metadata"}
    meta = {f"meta.{k}": F.coalesce(value_of(F.col("metadata"), k), F.lit("")) for k in keys}
    every = plain | meta
    return records.select(*[every[c].alias(c) for c in sorted(every)])
