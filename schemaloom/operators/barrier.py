"""Filters on and explodes of computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: str, pos: str, item: str) -> DataFrame:
    """``keep`` columns with one row per element of a computed array: its position and itself.

    A plain explode makes the optimizer filter out empty arrays beforehand, which evaluates the
    expression of the array a second time; the outer form does not.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on columns that were expensive to compute.

    A plain filter is pushed below the projections that compute its columns, with their
    expressions copied into it, so that everything is evaluated twice. A row number that the
    filter also looks at keeps it above them; filters on stored columns still reach the scan. A stream, which cannot
    number its rows, has a random number instead.
    """
    return (
        df.withColumn("_row", F.rand(0) if df.isStreaming else F.monotonically_increasing_id())
        .filter(condition & (F.col("_row") >= 0))
        .drop("_row")
    )
