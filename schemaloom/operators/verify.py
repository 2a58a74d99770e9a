"""Verification of lake and vault evidence against the expected header.

Evidence for one plan is one record (its tables and vault structures as arrays), so the
checks run inside the row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.headers import DEFAULT_TECHNICAL, unique_by_name
from schemaloom.functions.identifiers import identifier_candidates, normalized_identifier
from schemaloom.functions.text import empty, in_list, let, lit, struct
from schemaloom.functions.typenames import effective_type, physical_first_type

COLUMN_KINDS = ["ADD_COLUMN", "DROP_COLUMN", "CHANGE_TYPE"]
NOT_EXECUTED = "Execution did not complete successfully"
NO_TABLES = "Lake introspection returned no tables"
NO_STRUCTURES = "Vault introspection returned no vault structures"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(arrays_overlap({a}, {b}), false)"


def select_target_table(tables: str, dataset_id: str = "dataset_id", rdbms: bool = True) -> str:
    """First table known under one of the dataset's names, else the only table, else null."""
    known = _overlap(identifier_candidates("_t.name", rdbms), "_wanted")
    choose = f"coalesce(get(filter({tables}, _t -> {known}), 0), CASE WHEN size({tables}) = 1 THEN get({tables}, 0) END)"
    return let(identifier_candidates(dataset_id, rdbms), "_wanted", choose)


def _lake_columns(operations: str, kind: str) -> str:
    ops = f"filter({operations}, _o -> _o.layer = 'lake' AND _o.kind = '{kind}')"
    return f"array_distinct(transform({ops}, _o -> {normalized_identifier('_o.column_name')}))"


def logical_first_columns(operations: str) -> str:
    """Columns whose expected type is read logical-first: those of lake CHANGE_TYPE operations."""
    return _lake_columns(operations, "CHANGE_TYPE")


def type_preferences(operations: str) -> str:
    """``array<struct<column_name,preference>>`` for the lake columns that a plan touches."""
    logical = f"filter({logical_first_columns(operations)}, _c -> _c <> '')"
    added = f"filter({_lake_columns(operations, 'ADD_COLUMN')}, _c -> _c <> '')"

    def tagged(columns, value):
        return f"transform({columns}, _c -> {struct(column_name='_c', preference=lit(value))})"

    both = f"concat({tagged('_l', 'logical')}, {tagged(f'array_except({added}, _l)', 'physical')})"
    return let(logical, "_l", both)


def _entries(attributes: str, side: int, technical) -> str:
    """Comparable entries of one side: unique lowercased names, technical ones dropped."""
    entry = struct(
        name=normalized_identifier("_a.name"),
        side=str(side),
        ptype=physical_first_type("_a"),
        ltype=effective_type("_a"),
        nullable="_a.nullable",
    )
    shaped = f"transform(filter({attributes}, _a -> _a IS NOT NULL), _a -> {entry})"
    hidden = in_list("_e.name", ["", *[t.strip().lower() for t in technical]])
    return unique_by_name(f"filter({shaped}, _e -> NOT {hidden})")


def _python_list(names: str) -> str:
    quote = "CASE WHEN contains(_n, '\\'') AND NOT contains(_n, '\"') THEN '\"' ELSE '\\'' END"
    quoted = let(quote, "_q", "concat(_q, _n, _q)")
    return f"concat('[', array_join(transform({names}, _n -> {quoted}), ', '), ']')"


def verify_lake(
    df: DataFrame,
    expected: str = "attributes",
    tables: str = "lake_tables",
    operations: str = "operations",
    technical=DEFAULT_TECHNICAL,
    rdbms: bool = True,
) -> DataFrame:
    """Add ``lake_issues``: differences between the expected header and the lake table.

    Expected and actual columns are merged by one sort, so counterparts are neighbours.
    """

    def listed(first, second, text):
        lacking = f"sort_array(array_except(transform({first}, _e -> _e.name), transform({second}, _e -> _e.name)))"
        return let(lacking, "_x", f"CASE WHEN size(_x) > 0 THEN concat({lit(text)}, array_join(_x, ', ')) END")

    def word(b):
        return f"CASE WHEN {b} THEN 'True' ELSE 'False' END"

    exp_type = "CASE WHEN array_contains(_logical, _c.name) THEN _b.ltype ELSE _b.ptype END"
    actual_null = "coalesce(_c.nullable, false)"
    type_issue = let(
        exp_type,
        "_et",
        "CASE WHEN NOT (_et <=> _c.ptype) THEN concat('Lake column \\'', _c.name, '\\' type mismatch: expected ', "
        "coalesce(_et, 'unknown'), ' got ', coalesce(_c.ptype, 'unknown')) END",
    )
    null_issue = (
        f"CASE WHEN _b.nullable <> {actual_null} THEN concat('Lake column \\'', _c.name, "
        f"'\\' nullability mismatch: expected ', {word('_b.nullable')}, ' got ', {word(actual_null)}) END"
    )
    compare = let(
        "get(_m, _i - 1)",
        "_b",
        f"CASE WHEN _c.side = 1 AND _b.name <=> _c.name THEN array({type_issue}, {null_issue}) ELSE {empty()} END",
    )
    column_issues = let("sort_array(concat(_exp, _act))", "_m", f"flatten(transform(_m, (_c, _i) -> {compare}))")
    missing = listed("_exp", "_act", "Lake table missing expected columns: ")
    unexpected = listed("_act", "_exp", "Lake table contains unexpected columns: ")
    names = f"transform({tables}, _t -> coalesce(_t.name, 'None'))"
    no_target = (
        "concat('Unable to identify target lake table for verification (dataset_id=', dataset_id, "
        f"', available_tables=', {_python_list(names)}, ')')"
    )
    issues = f"""CASE
      WHEN {expected} IS NULL THEN {empty()}
      WHEN {tables} IS NULL THEN array('Lake evidence missing while verifying expected schema')
      WHEN _target IS NULL THEN array({no_target})
      ELSE array_compact(concat(array({missing}, {unexpected}), {column_issues})) END"""
    return (
        df.withColumn("_target", F.expr(select_target_table(tables, "dataset_id", rdbms)))
        .withColumns(
            {
                "_exp": F.expr(_entries(expected, 0, technical)),
                "_act": F.expr(_entries("_target.attributes", 1, technical)),
                "_logical": F.expr(logical_first_columns(operations)),
            }
        )
        .withColumn("lake_issues", F.expr(issues))
        .drop("_target", "_exp", "_act", "_logical")
    )


def verify_vault(
    df: DataFrame, structures: str = "vault_structures", operations: str = "operations", rdbms: bool = True
) -> DataFrame:
    """Add ``vault_issues``: what the plan's vault operations should have left but did not."""
    related = _overlap(identifier_candidates("_v", rdbms), "_ds")
    links, satellites = f"coalesce(_x.links, {empty()})", f"coalesce(_x.satellites, {empty()})"
    hit = struct(
        hub=_overlap(identifier_candidates("_x.hub", rdbms), "_ds"),
        other=f"exists(concat({links}, {satellites}), _v -> coalesce({related}, false))",
        links=f"size({links}) > 0",
    )

    def about(text):
        return f"concat({lit(text)}, dataset_id)"

    structural = f"""array_compact(array(
      CASE WHEN array_contains(_kinds, 'NEW_HUB') AND NOT exists(_hits, _h -> _h.hub)
        THEN {about("Vault evidence does not show expected hub for dataset ")} END,
      CASE WHEN array_contains(_kinds, 'NEW_LINK') AND NOT exists(_hits, _h -> _h.links)
        THEN {about("Vault evidence does not show any links after NEW_LINK for dataset ")} END))"""
    column_kinds = ", ".join(map(lit, COLUMN_KINDS))
    issues = f"""CASE
      WHEN size(_kinds) = 0 THEN {empty()}
      WHEN {structures} IS NULL THEN array('Vault evidence missing while verifying plan execution')
      WHEN size({structures}) = 0 THEN array({lit(NO_STRUCTURES)})
      WHEN size(_structural) > 0 THEN _structural
      WHEN arrays_overlap(_kinds, array({column_kinds})) AND NOT exists(_hits, _h -> _h.hub OR _h.other)
        THEN array({about("Vault evidence does not expose a structure related to dataset ")})
      ELSE {empty()} END"""
    kinds = f"array_distinct(transform(filter({operations}, _o -> _o.layer = 'vault'), _o -> _o.kind))"
    return (
        df.withColumns({"_kinds": F.expr(kinds), "_ds": F.expr(identifier_candidates("dataset_id", rdbms))})
        # each structure's names are expanded once, then only compared
        .withColumn("_hits", F.expr(f"transform({structures}, _x -> {hit})"))
        .withColumn("_structural", F.expr(structural))
        .withColumn("vault_issues", F.expr(issues))
        .drop("_kinds", "_ds", "_hits", "_structural")
    )


def verification_result(
    df: DataFrame,
    tables: str = "lake_tables",
    structures: str = "vault_structures",
    operations: str = "operations",
) -> DataFrame:
    """Add ``issues`` and ``status`` from successful, lake_issues and vault_issues.

    An unsuccessful execution is the only issue reported; evidence is then not consulted.
    """

    def unmet(ready, issues, fallback):
        return (
            f"CASE WHEN {ready} THEN {empty()} WHEN size({issues}) > 0 THEN {issues} ELSE array({lit(fallback)}) END"
        )

    lake_ready = f"coalesce(array_size({tables}), 0) > 0 AND size(lake_issues) = 0"
    vault_ready = (
        f"NOT exists({operations}, _o -> _o.layer = 'vault') "
        f"OR (coalesce(array_size({structures}), 0) > 0 AND size(vault_issues) = 0)"
    )
    evidence = f"concat({unmet(lake_ready, 'lake_issues', NO_TABLES)}, {unmet(vault_ready, 'vault_issues', NO_STRUCTURES)})"
    return df.withColumn(
        "issues", F.expr(f"CASE WHEN NOT successful THEN array({lit(NOT_EXECUTED)}) ELSE {evidence} END")
    ).withColumn("status", F.expr("CASE WHEN size(issues) = 0 THEN 'passed' ELSE 'failed' END"))


def evidence_refs(results: str) -> str:
    """Non-empty snapshot ids in operation order, from ``array<struct<op_seq,evidence_snapshot_id>>``."""
    return f"filter(transform(sort_array({results}), _r -> _r.evidence_snapshot_id), _x -> _x <> '')"
