"""Header diff: ADD_COLUMN, CHANGE_TYPE and DROP_COLUMN atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.headers import signature
from schemaloom.functions.text import empty, let, struct
from schemaloom.operators.barrier import unnest
from schemaloom.types import ATOM_DDL

_SIGNATURE_ITEM = "struct<name:string,ctype:string>"
_TAGGED = "struct<name:string,side:int,pos:int,ctype:string>"


def _tag(sig: str, side: int) -> str:
    entry = struct(name="_s.name", side=str(side), pos="_i", ctype="_s.ctype")
    return f"transform(coalesce({sig}, {empty(_SIGNATURE_ITEM)}), (_s, _i) -> {entry})"


def diff_signatures(prev: str, new: str) -> str:
    """Atoms between two signatures, new-header order first and drops after it.

    Both sides are merged by one sort, so an attribute meets its counterpart as its
    neighbour; no pairwise search is done and wide headers stay cheap.
    """
    nothing = f"array(cast(NULL AS {_TAGGED}))"
    framed = f"concat({nothing}, sort_array(concat({_tag(prev, 0)}, {_tag(new, 1)})), {nothing})"
    before, after = "get(_f, _i - 1)", "get(_f, _i + 1)"

    def atom(section, kind, from_type, to_type):
        return struct(
            section=str(section), pos="_c.pos", kind=f"'{kind}'", attribute="_c.name", from_type=from_type, to_type=to_type
        )

    null = "cast(NULL AS string)"
    classify = f"""CASE
      WHEN _c.side = 1 AND NOT ({before}.name <=> _c.name) THEN {atom(0, 'ADD_COLUMN', null, '_c.ctype')}
      WHEN _c.side = 1 AND {before}.ctype <> _c.ctype THEN {atom(0, 'CHANGE_TYPE', f'{before}.ctype', '_c.ctype')}
      WHEN _c.side = 0 AND NOT ({after}.name <=> _c.name) THEN {atom(1, 'DROP_COLUMN', '_c.ctype', null)}
    END"""
    found = let(framed, "_f", f"sort_array(array_compact(transform(_f, (_c, _i) -> {classify})))")
    plain = struct(kind="_a.kind", attribute="_a.attribute", from_type="_a.from_type", to_type="_a.to_type")
    return f"CASE WHEN {prev} <=> {new} THEN {empty(ATOM_DDL)} ELSE transform({found}, _a -> {plain}) END"


def with_atoms(df: DataFrame, prev: str = "prev_attributes", new: str = "attributes") -> DataFrame:
    """Add ``atoms`` to rows that hold a previous and a new attribute array."""
    return (
        df.withColumns({"_prev_sig": F.expr(signature(prev)), "_new_sig": F.expr(signature(new))})
        .withColumn("atoms", F.expr(diff_signatures("_prev_sig", "_new_sig")))
        .drop("_prev_sig", "_new_sig")
    )


def explode_atoms(df: DataFrame, *keys: str) -> DataFrame:
    """One row per atom with its 1-based position."""
    return unnest(df, keys, "atoms", "atom_pos", "atom").select(
        *keys, (F.col("atom_pos") + 1).alias("atom_seq"), "atom.*"
    )


def changed_attributes(atoms: str) -> str:
    """Sorted distinct names touched by the atoms."""
    return f"sort_array(array_distinct(transform({atoms}, _a -> _a.attribute)))"


def atom_count(atoms: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({atoms}, _a -> _a.kind = '{kind}')) AS bigint)")


def column_set_ops(df: DataFrame, prev: str, new: str) -> DataFrame:
    """Added, removed and kept column names per row, as arrays."""
    p, n = F.col(prev), F.col(new)
    return df.withColumns(
        {
            "added": F.array_except(n, p),
            "removed": F.array_except(p, n),
            "kept": F.array_intersect(n, p),
        }
    )
