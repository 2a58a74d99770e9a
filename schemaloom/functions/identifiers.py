"""Physical names and the set of spellings under which a table may be found."""

from __future__ import annotations

from schemaloom.functions.text import let, lit
from schemaloom.functions.typenames import strip

# Prefixes that vault tables carry in front of the dataset name.
IDENTIFIER_PREFIXES = ["hub_", "sat_", "satellite_", "link_", "lnk_"]

# Fixed value: longest identifier of the relational lake.
RDBMS_IDENTIFIER_LIMIT = 63


def normalized_identifier(x: str) -> str:
    return f"coalesce(lower({strip(x)}), '')"


def physical_identifier(x: str, rdbms: bool = True) -> str:
    # instr gives 0 without a dot, so the text after the first dot is the whole text
    tail = let(f"coalesce({strip(x)}, '')", "_r", "substr(_r, instr(_r, '.') + 1)")
    name = f"translate(btrim({tail}, '\"'), '.-', '__')"
    return f"lower(left({name}, {RDBMS_IDENTIFIER_LIMIT}))" if rdbms else f"lower({name})"


def identifier_candidates(x: str, rdbms: bool = True) -> str:
    """Distinct non-empty spellings of an identifier (a handful per value)."""
    # Spellings mostly coincide: each step goes on with the distinct ones only.
    seeds = f"array_distinct(array({normalized_identifier(x)}, {physical_identifier(x, rdbms)}))"
    for sep in "/.":
        seeds = f"array_distinct(flatten(transform({seeds}, _s -> array(_s, substring_index(_s, '{sep}', -1)))))"
    cut = ", ".join(
        f"CASE WHEN startswith(_s, {lit(p)}) THEN substr(_s, {len(p) + 1}) ELSE '' END" for p in IDENTIFIER_PREFIXES
    )
    return f"filter(array_distinct(flatten(transform({seeds}, _s -> array(_s, {cut})))), _s -> _s <> '')"


def dataset_path_key(x: str) -> str:
    """Path-safe form of a dataset id. Different ids can share one key."""
    return f"translate({x}, '/:', '__')"
