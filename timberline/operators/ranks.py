"""Values at given ranks of a whole column, exactly, without sorting it: histograms that narrow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024
FEW = 20_000  # values that the driver sorts


def at_ranks(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0, rising order) of a column of numbers without nulls and NaN.

    Each step counts the values of ``PARTS`` equal parts of a range and goes on with the part that has the
    rank, until it has ``FEW`` values at most, which are collected, or only one different value.
    """
    return _search(df.select(value.alias("v")), list(ranks))


def _search(df: DataFrame, ranks: list[int]) -> list[float]:
    if not ranks:
        return []
    ends = df.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if ends["low"] == ends["high"]:
        return [ends["low"]] * len(ranks)
    if ends["n"] <= FEW:
        values = sorted(r["v"] for r in df.collect())  # at most FEW
        return [values[k] for k in ranks]
    width = float(ends["high"]) - float(ends["low"])
    if math.isinf(width):
        part = F.when(F.col("v") == float("inf"), 3).when(F.col("v") == float("-inf"), 0).when(F.col("v") < 0, 1).otherwise(2)
    else:
        part = F.least(F.floor((F.col("v") - F.lit(ends["low"])) / F.lit(width) * PARTS), F.lit(PARTS - 1)).cast("int")
    counts = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # at most PARTS
    inside: dict[int, list[int]] = {}
    before, at = 0, {}
    for p in sorted(counts):
        for k in ranks:
            if before <= k < before + counts[p]:
                inside.setdefault(p, []).append(k - before)
                at[k] = (p, k - before)
        before += counts[p]
    found = {p: dict(zip(ks, _search(df.filter(part == p), ks), strict=True)) for p, ks in inside.items()}
    return [found[p][k] for p, k in (at[k] for k in ranks)]


def median(df: DataFrame, value: Column) -> float | None:
    """The median, between the two middle values of an even number of them; null of none."""
    n = df.count()
    if not n:
        return None
    low, high = at_ranks(df, value, [(n - 1) // 2, n // 2]) if n % 2 == 0 else at_ranks(df, value, [n // 2]) * 2
    return (low + high) / 2
