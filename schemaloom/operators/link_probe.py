"""Link candidates: foreign-key columns found by testing inclusion of their values."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_TABLE = "TABLE_NOT_FOUND"


def _profile(name: str, df: DataFrame, columns: list[str]) -> list[dict]:
    """Min, max and count of key-like columns, in one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col = F.col(c).cast("bigint")
        aggs += [
            F.min(col).alias(f"min{i}"),
            F.max(col).alias(f"max{i}"),
            F.count(col).alias(f"cnt{i}"),
        ]
    r = df.agg(*aggs).first()
    return [
        {
            "table": name, "column": c, "rows": r["rows"], "min": r[f"min{i}"], "max": r[f"max{i}"],
            "count": r[f"cnt{i}"],
        }
        for i, c in enumerate(columns)
    ]


def _stem(column: str) -> str:
    return column.split("_", 1)[-1]


def probe_links(
    tables: Mapping[str, DataFrame], targets: list[str] | None = None, fk_filter: str | None = None, same_name: bool = False
) -> DataFrame:
    """Foreign keys of the target tables: table_name, name, key_column, parent_table, parent_key,
    distinct_values.

    A candidate is a whole-number column whose values all occur in a unique column of another
    table. ``same_name`` asks that both have the same name after the table prefix; ``fk_filter`` keeps child columns
    that contain the text. Bounds of the columns, which are exact, rule out most pairs; the remaining ones are tested
    together in one job, over distinct values.
    """
    spark = next(iter(tables.values())).sparkSession
    unknown = [t for t in targets or [] if t not in tables]
    if unknown:
        raise KeyError(f"{NO_TABLE}: {unknown}")
    profiles = []
    for name, df in tables.items():
        keys = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
        if keys:
            profiles += _profile(name, df, keys)
    # Exact bounds rule pairs out; uniqueness is tested exactly below, over the values.
    maybe_unique = [p for p in profiles if p["rows"] and p["count"] == p["rows"] and p["max"] - p["min"] >= p["rows"] - 1]
    pairs = [
        (c, p)
        for c in profiles
        for p in maybe_unique
        if c["table"] != p["table"]
        and (targets is None or c["table"] in targets)
        and (fk_filter is None or fk_filter in c["column"])
        and (not same_name or _stem(c["column"]) == _stem(p["column"]))
        and c["count"]
        and c["min"] >= p["min"]
        and c["max"] <= p["max"]
    ]
    result = "table_name string, name string, key_column string, parent_table string, parent_key string, distinct_values bigint"
    if not pairs:
        return spark.createDataFrame([], result)

    def values(p):
        return tables[p["table"]].select(
            F.lit(f"{p['table']}.{p['column']}").alias("col_id"), F.col(p["column"]).cast("bigint").alias("v")
        ).filter(F.col("v").isNotNull())

    used = {f"{p['table']}.{p['column']}": p for pair in pairs for p in pair}
    counted = reduce(DataFrame.unionByName, [values(p) for p in used.values()]).groupBy("col_id", "v").count()
    parent_ids = sorted({f"{p['table']}.{p['column']}" for _, p in pairs})
    described = [
        (f"{c['table']}.{c['column']}", f"{p['table']}.{p['column']}", c["table"], f"link_{c['table']}_{p['table']}",
         c["column"], p["table"], p["column"])
        for c, p in pairs
    ]
    pair_rows = spark.createDataFrame(
        described,
        "child_id string, parent_id string, table_name string, name string, key_column string, "
        "parent_table string, parent_key string",
    )
    # One row per pair of columns; the planner knows its size.
    child = counted.join(pair_rows, counted["col_id"] == pair_rows["child_id"]).select("parent_id", *pair_rows.columns[:1], *pair_rows.columns[2:], "v")
    parent = counted.filter(F.col("col_id").isin(parent_ids)).select(
        F.col("col_id").alias("parent_id"), "v", (F.col("count") == 1).alias("single")
    )
    repeated = parent.groupBy("parent_id").agg(F.bool_and("single").alias("unique"))
    tested = (
        child.join(parent.select("parent_id", "v", F.lit(True).alias("hit")), ["parent_id", "v"], "left")
        .groupBy("parent_id", "table_name", "name", "key_column", "parent_table", "parent_key")
        .agg(F.count(F.lit(1)).alias("distinct_values"), F.count("hit").alias("hits"))
        .filter(F.col("hits") == F.col("distinct_values"))
    )
    return (
        tested.join(repeated.filter("unique").select("parent_id"), "parent_id", "left_semi")
        .select("table_name", "name", "key_column", "parent_table", "parent_key", "distinct_values")
    )
