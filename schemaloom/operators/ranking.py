"""Row numbers and running sums that do not gather a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of one key that a single task sorts at most, for orders without repeated values.
BUCKET = 1 << 20


def running_index(df: DataFrame, keys: list[str], order: str, name: str, bucket: int | None = None) -> DataFrame:
    """1-based position of each row within its keys, by a whole-number ``order`` column.

    A plain ``row_number`` sorts all rows of a key in one task. Here the order is cut into
    buckets of fixed width: counts per (key, bucket) give the start of each bucket, and only
    the rows of one bucket are sorted together.
    """
    width = bucket or BUCKET
    df = df.withColumn("_b", F.expr(f"`{order}` div {width}"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        .drop("_count")
    )
    within = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order))
    return (
        df.join(starts, [*keys, "_b"])
        .withColumn(name, (F.col("_start") + within).cast("bigint"))
        .drop("_b", "_start")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, bucket: int | None = None
) -> DataFrame:
    """``lag(value)`` within keys by a unique whole-number ``order``, cut into buckets likewise.

    The first row of a bucket takes the last value of the closest bucket before it.
    ``value`` must not be null.
    """
    width = bucket or BUCKET
    df = df.withColumn("_b", F.expr(f"`{order}` div {width}"))
    in_order = W.partitionBy(*keys).orderBy("_b")
    carried = (
        df.groupBy(*keys, "_b")
        .agg(F.max_by(value, order).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(in_order))
        .drop("_last")
    )
    within = F.lag(value).over(W.partitionBy(*keys, "_b").orderBy(order))
    return (
        df.join(carried, [*keys, "_b"]).withColumn(name, F.coalesce(within, F.col("_carried"))).drop("_b", "_carried")
    )
