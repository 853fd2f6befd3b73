"""One evaluation per row for columns that later expressions use many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, as by withColumns, but never substituted into what uses them.

    The optimizer merges neighbouring projections and pushes filters through them by replacing each
    column by its expression; over a chain of parsing steps that multiplies the work and the size of
    the plan. It doesn't do so across a generator, so the columns pass through one, as a row of one.
    """
    keep = [c for c in df.columns if c not in cols]
    one = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in cols.items()])))
    return df.select(*[F.col(f"`{c}`") for c in keep], one.alias("__one")).select(*[F.col(f"`{c}`") for c in keep], *[F.col("__one")[k].alias(k) for k in cols])
