"""The given tables, and rows that travel whole beside computed columns."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Each row as one struct ``_row`` beside the named columns, so that no name of the input can clash."""
    named = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *named)


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The columns of ``_row``, then the added ones; an input column of the name of an added one is replaced."""
    kept = [c for c in df.schema["_row"].dataType.names if c.lower() not in {a.lower() for a in added}]
    return df.select(*[F.col("_row").getField(c).alias(c) for c in kept], *added)


def released() -> None:
    """Give memory that a task has freed back to the system: workers outlive their tasks, and others share the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
