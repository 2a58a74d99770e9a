"""Planned changes applied to DataFrames.

A change never rewrites a table in place: it yields a projection of the current table, which
the caller writes to a new folder. A whole plan becomes one projection, so the scan still
prunes columns and pushes filters through it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.typenames import TYPE_SPELLINGS, WIDENS_TO
from schemaloom.types import SPARK_TYPES, STATUS_ALREADY_APPLIED, STATUS_OK, STATUS_PERMANENT_ERROR

_CANONICAL = {s: name for name, spellings in TYPE_SPELLINGS.items() for s in spellings}
_PASSED_THROUGH = {
    "long": T.LongType(),
    "smallint": T.ShortType(),
    "int2": T.ShortType(),
    "tinyint": T.ByteType(),
    "float4": T.FloatType(),
    "decimal": SPARK_TYPES["numeric"],
    "numeric": SPARK_TYPES["numeric"],
    "date": T.DateType(),
    "binary": T.BinaryType(),
}


def spark_type(type_name: str | None) -> T.DataType:
    """Spark type for a header's type name; sized text and unknown names become strings."""
    name = (type_name or "").strip().lower()
    name = _CANONICAL.get(name, name)
    if name in SPARK_TYPES:
        return SPARK_TYPES[name]
    if name in _PASSED_THROUGH:
        return _PASSED_THROUGH[name]
    sized = re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", name)
    if sized and int(sized[1]) <= 38:
        return T.DecimalType(int(sized[1]), int(sized[2] or 0))
    return T.StringType()


def _family(t: T.DataType) -> str:
    if isinstance(t, T.LongType):
        return "bigint"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.DecimalType):
        return "numeric"
    if isinstance(t, T.FractionalType):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.DateType):
        return "date"
    return "timestamp" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else "string"


def lossless(source: T.DataType, target: T.DataType) -> bool:
    a, b = _family(source), _family(target)
    return a == b or b in WIDENS_TO.get(a, [])


def _attempt(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Conversion that gives null for misfits.

    Texts that cannot be whole numbers are set aside first: each failure inside ``try_cast``
    raises and catches an exception, which is slow when most rows fail.
    """
    if isinstance(source, T.StringType) and isinstance(target, T.IntegralType):
        return F.when(c.rlike(r"\A\s*[+-]?\d+\s*\z"), c.try_cast(target))
    return c.try_cast(target)


def converted(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """A widening is a plain cast, so an unexpected overflow fails; otherwise misfits become null."""
    if source == target:
        return c
    return c.cast(target) if lossless(source, target) else _attempt(c, source, target)


def apply_operations(df: DataFrame, operations: Iterable[Mapping]) -> tuple[DataFrame, list[int]]:
    """Fold lake operations over a table as one projection.

    Each operation has ``kind`` and ``params`` (column_name, logical_type, new_name), as mapping or as a row of
    ``explode_operations``. Operations of another ``layer`` than the lake belong to other handlers and are
    passed over. Returns the evolved table and one status per lake operation; the plan stops at the first permanent error.
    """
    # name -> (expression over df, type); insertion order is column order
    columns: dict[str, tuple[Column, T.DataType]] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    statuses = []
    for op in operations:
        op = op.asDict() if hasattr(op, "asDict") else op
        if op.get("layer", "lake") != "lake":
            continue
        status = _apply(columns, op["kind"], op["params"])
        statuses.append(status)
        if status == STATUS_PERMANENT_ERROR:
            break
    return df.select(*[expr.alias(name) for name, (expr, _) in columns.items()]), statuses


def _apply(columns: dict, kind: str, params: Mapping) -> int:
    if "column_name" not in params:
        return STATUS_PERMANENT_ERROR
    name = params["column_name"]
    if kind == "ADD_COLUMN":
        if name in columns:
            return STATUS_ALREADY_APPLIED
        target = spark_type(params.get("logical_type"))
        columns[name] = (F.lit(None).cast(target), target)
        return STATUS_OK
    if kind == "DROP_COLUMN":
        if name not in columns:
            return STATUS_ALREADY_APPLIED
        del columns[name]
        return STATUS_OK
    if kind == "RENAME_COLUMN":
        new_name = params["new_name"]
        if name not in columns:
            return STATUS_ALREADY_APPLIED if new_name in columns else STATUS_PERMANENT_ERROR
        if new_name in columns:
            return STATUS_PERMANENT_ERROR
        renamed = {new_name if k == name else k: v for k, v in columns.items()}
        columns.clear()
        columns.update(renamed)
        return STATUS_OK
    if kind == "CHANGE_TYPE":
        if name not in columns:
            return STATUS_PERMANENT_ERROR
        expr, source = columns[name]
        target = spark_type(params.get("to_logical_type") or params.get("logical_type"))
        if source == target:
            return STATUS_ALREADY_APPLIED
        columns[name] = (converted(expr, source, target), target)
        return STATUS_OK
    return STATUS_PERMANENT_ERROR


def add_column(df: DataFrame, name: str, type_name: str) -> DataFrame:
    return apply_operations(
        df, [{"kind": "ADD_COLUMN", "params": {"column_name": name, "logical_type": type_name}}]
    )[0]


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return apply_operations(df, [{"kind": "DROP_COLUMN", "params": {"column_name": name}}])[0]


def rename_column(df: DataFrame, name: str, new_name: str) -> DataFrame:
    op = {"kind": "RENAME_COLUMN", "params": {"column_name": name, "new_name": new_name}}
    return apply_operations(df, [op])[0]


def change_type(df: DataFrame, name: str, type_name: str) -> DataFrame:
    op = {"kind": "CHANGE_TYPE", "params": {"column_name": name, "to_logical_type": type_name}}
    return apply_operations(df, [op])[0]


def lossy_cast_report(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Rows per column whose value a conversion would lose, for all columns in one pass.

    A value is lost if it becomes null or, between numeric types, if it does not convert back.
    """
    types = {f.name: f.dataType for f in df.schema}

    def lost(name):
        c, source, target = F.col(f"`{name}`"), types[name], spark_type(targets[name])
        new = _attempt(c, source, target)
        bad = new.isNull()
        if isinstance(source, T.NumericType) and isinstance(target, T.NumericType):
            bad = bad | ~new.try_cast(source).eqNullSafe(c)
        return F.count_if(c.isNotNull() & bad)

    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[lost(n).alias(n) for n in targets])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("to_type"), F.col(f"`{n}`").alias("lossy_rows"))
            for n, t in targets.items()
        ]
    )
    return one.select(F.explode(rows).alias("r"), F.col("_rows").alias("total_rows")).select("r.*", "total_rows")


def project_to_header(df: DataFrame, header: Iterable[tuple[str, str]]) -> DataFrame:
    """Columns of ``header`` (name, type name) in its order: missing ones null, others converted."""
    have = {f.name: f.dataType for f in df.schema}

    def column(name, type_name):
        target = spark_type(type_name)
        if name not in have:
            return F.lit(None).cast(target).alias(name)
        return converted(F.col(f"`{name}`"), have[name], target).alias(name)

    return df.select(*[column(n, t) for n, t in header])


def create_compat_view(df: DataFrame, header: Iterable[tuple[str, str]], view: str) -> DataFrame:
    """Register the table as older readers know it."""
    out = project_to_header(df, header)
    out.createOrReplaceTempView(view)
    return out


def drop_compat_view(df: DataFrame, view: str) -> bool:
    return df.sparkSession.catalog.dropTempView(view)


def multi_version_read(parts: Iterable[DataFrame], header: Iterable[tuple[str, str]]) -> DataFrame:
    """Files written under different headers, read as the latest header."""
    header = list(header)
    return reduce(DataFrame.unionByName, [project_to_header(p, header) for p in parts])
