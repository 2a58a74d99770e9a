"""Policy evaluation over atoms, impact counts and a policy struct in the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.text import empty, let, struct
from schemaloom.functions.typenames import family_widens, type_family

IMPACT_COLUMNS = ("impacted_lake", "impacted_vault", "impacted_transformations")


def policy_flags(df: DataFrame, atoms: str = "atoms") -> DataFrame:
    """Add has_atoms, has_drop, has_change, only_additive, widening_only and offenders."""
    change = struct(
        attribute="_a.attribute",
        from_type="_a.from_type",
        to_type="_a.to_type",
        ff=type_family("_a.from_type"),
        tf=type_family("_a.to_type"),
    )
    changes = f"transform(filter({atoms}, _a -> _a.kind = 'CHANGE_TYPE'), _a -> {change})"
    narrowing = f"filter(_changes, _x -> NOT {family_widens('_x.ff', '_x.tf')})"
    shown = "transform(_narrowing, _x -> concat(_x.attribute, ':', _x.from_type, '->', _x.to_type))"
    return (
        df.withColumn("_changes", F.expr(changes))
        .withColumn("_narrowing", F.expr(narrowing))
        .withColumns(
            {
                "has_atoms": F.expr(f"size({atoms}) > 0"),
                "has_drop": F.expr(f"exists({atoms}, _a -> _a.kind = 'DROP_COLUMN')"),
                "has_change": F.expr("size(_changes) > 0"),
                "only_additive": F.expr(f"size({atoms}) > 0 AND forall({atoms}, _a -> _a.kind = 'ADD_COLUMN')"),
                "widening_only": F.expr("size(_changes) > 0 AND size(_narrowing) = 0"),
                "offenders": F.expr(f"array_join({shown}, ', ')"),
            }
        )
        .drop("_changes", "_narrowing")
    )


def guard_looks(policy: str = "policy") -> str:
    """Whether the impact guards of a policy look at a change at all."""
    return f"({policy}.impact_mode <> 'off' AND NOT ({policy}.impact_mode = 'breaking_only' AND only_additive))"


def impact_reasons(policy: str = "policy") -> str:
    """Reasons for which the impact guards block; empty when they pass."""
    lake, vault, xforms = IMPACT_COLUMNS
    total = f"({lake} + {vault} + {xforms})"

    def over(cap, value, start, end):
        message = f"concat('{start}', {value}, '{end}', {policy}.{cap})"
        return f"CASE WHEN {value} > {policy}.{cap} THEN {message} END"

    caps = ", ".join(
        [
            over("max_impacted_total", total, "Impacted artifact count ", " exceeds policy limit "),
            over("max_impacted_lake_tables", lake, "Impacted lake tables ", " exceed policy limit "),
            over("max_impacted_vault_objects", vault, "Impacted vault objects ", " exceed policy limit "),
            over(
                "max_impacted_transformations", xforms, "Impacted downstream transformations ", " exceed policy limit "
            ),
        ]
    )
    any_impact = (
        f"array(concat('Policy blocks changes with downstream impact (lake_tables=', {lake}, ', vault_objects=', {vault}, "
        f"', transformations=', {xforms}, ')'))"
    )
    blocked = let(
        f"array_compact(array({caps}))",
        "_caps",
        f"CASE WHEN size(_caps) > 0 THEN _caps WHEN {policy}.block_on_any_impact THEN {any_impact} ELSE {empty()} END",
    )
    return (
        f"CASE WHEN {guard_looks(policy)} AND {total} > 0 THEN {blocked} ELSE {empty()} END"
    )


def policy_case(df: DataFrame, policy: str = "policy") -> DataFrame:
    """Add ``_case``, what kind of change the policy meets, and ``_impact``, the reasons of the impact guards.

    Needs the columns of ``policy_flags`` plus impacted_lake, impacted_vault and
    impacted_transformations (bigint counts). The cases of ``BLOCKED`` are not allowed.
    """
    p = policy
    case = f"""CASE
      WHEN NOT has_atoms THEN 'unchanged'
      WHEN has_drop AND NOT {p}.allow_drop THEN 'drop'
      WHEN has_change AND {p}.change_mode = 'none' THEN 'change'
      WHEN has_change AND {p}.change_mode = 'widen' AND NOT widening_only THEN 'narrowing'
      WHEN size(_impact) > 0 THEN 'impact'
      WHEN only_additive THEN 'additive'
      ELSE 'destructive' END"""
    return df.withColumn("_impact", F.expr(impact_reasons(policy))).withColumn("_case", F.expr(case))


BLOCKED = ("drop", "change", "narrowing", "impact")


def policy_decision(df: DataFrame, policy: str = "policy") -> DataFrame:
    """Add decision, compatibility, obligations and reasons; see ``policy_case`` for what it needs."""
    p = policy
    after_drop = f"CASE WHEN has_drop THEN {p}.compatibility_for_drop ELSE 'breaking' END"
    compatibility = f"""CASE
      WHEN _case IN ('unchanged', 'additive') THEN 'backward'
      WHEN _case <> 'destructive' THEN 'breaking'
      WHEN NOT has_change THEN {after_drop}
      WHEN widening_only THEN {p}.compatibility_for_change_type_widening
      ELSE coalesce({p}.compatibility_for_change_type, {after_drop}) END"""
    reasons = """CASE _case
      WHEN 'unchanged' THEN array('No structural changes detected')
      WHEN 'drop' THEN array('DROP_COLUMN not allowed by policy')
      WHEN 'change' THEN array('CHANGE_TYPE not allowed by policy')
      WHEN 'narrowing' THEN array(concat('Non-widening CHANGE_TYPE blocked by policy: ', offenders))
      WHEN 'impact' THEN _impact
      WHEN 'additive' THEN array('Only additive changes detected')
      ELSE CASE WHEN has_change AND widening_only THEN array('Only widening CHANGE_TYPE detected')
                ELSE array('Destructive changes allowed by policy') END END"""
    return (
        policy_case(df, policy)
        .withColumns(
            {
                "decision": F.when(F.col("_case").isin(*BLOCKED), "block").otherwise("allow"),
                "compatibility": F.expr(compatibility),
                "obligations": F.expr(
                    f"CASE WHEN _case = 'additive' THEN coalesce({p}.obligations_on_additive, {empty()}) ELSE {empty()} END"
                ),
                "reasons": F.expr(reasons),
            }
        )
        .drop("_case", "_impact")
    )
