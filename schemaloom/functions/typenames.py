"""Type names found in headers.

Two normalizers exist on purpose. ``canonical_type`` decides whether two headers differ;
``type_family`` decides whether a difference is a widening. They disagree on many spellings
and must not be merged.
"""

from __future__ import annotations

from schemaloom.functions.text import in_list, let, lit

# Every spelling that stands for a canonical type.
TYPE_SPELLINGS = {
    "string": ["text", "varchar", "character varying", "bpchar", "char", "string"],
    "integer": ["int", "int4", "integer"],
    "bigint": ["bigint", "int8"],
    "float": ["float", "float8", "double", "double precision", "real"],
    "boolean": ["bool", "boolean"],
    "timestamp": ["timestamp", "timestamp without time zone"],
    "timestamptz": ["timestamptz", "timestamp with time zone"],
}

# Substrings that put a type name in a family, first hit wins.
FAMILY_SUBSTRINGS = [
    ("boolean", ["bool"]),
    ("bigint", ["bigint", "long"]),
    ("integer", ["int"]),
    ("float", ["double", "float", "real"]),
    ("numeric", ["decimal", "numeric"]),
    ("timestamp", ["timestamp", "datetime"]),
]

# Families a family may widen to.
WIDENS_TO = {
    "boolean": ["string"],
    "integer": ["bigint", "float", "numeric", "string"],
    "bigint": ["float", "numeric", "string"],
    "float": ["numeric", "string"],
    "numeric": ["string"],
    "date": ["timestamp", "string"],
    "timestamp": ["string"],
}

WIDENING_PAIRS = [f"{a}>{b}" for a, targets in WIDENS_TO.items() for b in targets]

# All characters that count as white space around a type name or identifier.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


_SPELLING_MAP = "map({})".format(
    ", ".join(f"{lit(s)}, {lit(name)}" for name, spellings in TYPE_SPELLINGS.items() for s in spellings)
)


def strip(x: str) -> str:
    """Text without surrounding white space of any kind.

    Most texts start and end with a printable ASCII character and are returned as they are;
    trimming by a set of characters is far slower than looking at two of them.
    """
    ends = f"ascii({x}) BETWEEN 33 AND 126 AND ascii(right({x}, 1)) BETWEEN 33 AND 126"
    return f"CASE WHEN {ends} THEN {x} ELSE btrim({x}, {lit(WHITESPACE)}) END"


def canonical_type(x: str) -> str:
    """Canonical name of a type; unknown names pass through lowercased, blank is null."""
    # known spellings are found without trimming
    direct = f"try_element_at({_SPELLING_MAP}, lower({x}))"
    trimmed = let(f"lower({strip(x)})", "_t", f"coalesce(try_element_at({_SPELLING_MAP}, _t), nullif(_t, ''))")
    return f"coalesce({direct}, {trimmed})"


def _first_type(attribute: str, fields: list[str]) -> str:
    return f"coalesce({', '.join(canonical_type(f'{attribute}.{f}') for f in fields)})"


def effective_type(attribute: str) -> str:
    """Logical type if given, else physical, else the fallback ``type`` field."""
    return _first_type(attribute, ["logical_type", "physical_type", "type"])


def physical_first_type(attribute: str) -> str:
    return _first_type(attribute, ["physical_type", "logical_type", "type"])


def type_family(x: str) -> str:
    """Widening family by the first matching substring; anything else, null included, is string."""
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(_t, {lit(w)})' for w in words)} THEN {lit(family)}"
        for family, words in FAMILY_SUBSTRINGS
    )
    dates = "WHEN contains(_t, 'date') AND NOT contains(_t, 'time') THEN 'date'"
    # white space around the name cannot change which substrings it holds
    return let(f"lower({x})", "_t", f"CASE {whens} {dates} ELSE 'string' END")


def family_widens(from_family: str, to_family: str) -> str:
    pair = f"concat({from_family}, '>', {to_family})"
    return f"({from_family} = {to_family} OR {in_list(pair, WIDENING_PAIRS)})"


def is_widening(from_type: str, to_type: str) -> str:
    return let(type_family(from_type), "_ff", let(type_family(to_type), "_tf", family_widens("_ff", "_tf")))
