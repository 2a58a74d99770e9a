"""Schema registry: versioned headers and last-write-wins tables of plans and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.identifiers import dataset_path_key
from schemaloom.operators.ranking import running_index


def latest_schema(versions: DataFrame) -> DataFrame:
    """The row with the highest version of each dataset.

    ``max_by`` combines map-side, so a dataset with very many versions sends one row per task.
    """
    rest = [c for c in versions.columns if c not in ("dataset_id", "version")]
    return (
        versions.groupBy("dataset_id")
        .agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_row"))
        .select("dataset_id", "version", "_row.*")
    )


def next_versions(accepted: DataFrame, versions: DataFrame, order: str = "seq", bucket: int | None = None) -> DataFrame:
    """Number accepted headers: highest stored version + 1, 2, ... in ``order`` per dataset."""
    current = versions.groupBy("dataset_id").agg(F.max("version").alias("_current"))
    ranked = running_index(accepted, ["dataset_id"], order, "_nth", bucket)
    return (
        ranked.join(current, "dataset_id", "left")
        .withColumn("version", (F.coalesce("_current", F.lit(0)) + F.col("_nth")).cast("bigint"))
        .drop("_current", "_nth")
    )


def store_versions(rows: DataFrame, path: str) -> None:
    """Append version rows below a path-safe folder per dataset."""
    rows.withColumn("dataset_key", F.expr(dataset_path_key("dataset_id"))).write.mode("append").partitionBy(
        "dataset_key"
    ).parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "plan_id", order: str = "stored_at") -> DataFrame:
    """Union in which the newest row per key replaces the others as a whole.

    ``max_by`` over the whole row combines map-side: many rewrites of one key meet as one
    row per task. Columns of fixed width are taken one by one, which a hash table can do: all see the rows in
    one order, so they come from one row. Others need the rows sorted.
    """
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c != key]
    if all(isinstance(both.schema[c].dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for c in rest):
        return both.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*both.columns)
    return (
        both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*both.columns)
    )
