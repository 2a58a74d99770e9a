"""Evidence about tables as they are: columns, types and observed nullability."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nullability_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Null counts of every column, one pass per table.

    Parquet tables report all columns as nullable, so what is actually null has to be counted.
    """

    def one(name, df):
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
        rows = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_rows")) for c in df.columns]
        )
        return agg.select(F.lit(name).alias("table_name"), F.col("_n").alias("total_rows"), F.explode(rows).alias("r")).select(
            "table_name", "r.column_name", "r.null_rows", "total_rows", (F.col("r.null_rows") > 0).alias("has_nulls")
        )

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def lake_evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, pos, column_name, physical_type, nullable (observed) of every column."""
    spark = next(iter(tables.values())).sparkSession
    declared = [
        (name, pos, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for pos, f in enumerate(df.schema)
    ]
    columns = spark.createDataFrame(declared, "table_name string, pos int, column_name string, physical_type string")
    observed = nullability_profile(tables)
    return columns.join(observed, ["table_name", "column_name"]).select(
        "table_name", "pos", "column_name", "physical_type", F.col("has_nulls").alias("nullable"), "total_rows"
    )


def as_lake_tables(evidence: DataFrame) -> DataFrame:
    """The nested form used for verification: one array of attributes per table."""
    attribute = F.struct(
        F.col("pos"),
        F.col("column_name").alias("name"),
        F.lit(None).cast("string").alias("logical_type"),
        F.col("physical_type"),
        F.lit(None).cast("string").alias("type"),
        F.col("nullable"),
    )
    return evidence.groupBy("table_name").agg(F.sort_array(F.collect_list(attribute)).alias("attributes"))
