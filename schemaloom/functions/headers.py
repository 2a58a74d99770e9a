"""Attribute arrays.

One header is one message, so its attribute array is bounded by the message size. Everything
that concerns a single header therefore stays inside its row: no explode, no shuffle, and a
cost of n log n in the number of attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.text import empty, let, lit, struct
from schemaloom.functions.typenames import effective_type, type_family
from schemaloom.types import ATTRIBUTE

DEFAULT_TECHNICAL = ("ingestion_timestamp",)


def strip_technical(attributes: str, technical=DEFAULT_TECHNICAL) -> str:
    """Drop technical attributes; names are compared exactly, case included."""
    if not technical:
        return attributes
    names = ", ".join(map(lit, technical))
    return f"filter({attributes}, _a -> _a IS NOT NULL AND (_a.name IS NULL OR _a.name NOT IN ({names})))"


def attribute_names(attributes: str) -> str:
    """Non-empty attribute names in header order; empty array for a null header."""
    return f"coalesce(filter(transform({attributes}, _a -> _a.name), _n -> _n <> ''), {empty()})"


def unique_by_name(entries: str) -> str:
    """Keep one entry per ``name``: the last value, at the position of the first.

    The common case of unique names costs one hash pass; only rows that do repeat a name take
    the second branch.
    """
    rebuilt = "transform(array_distinct(_names), _n -> element_at(filter(_found, _e -> _e.name = _n), -1))"
    check = f"CASE WHEN size(array_distinct(_names)) = size(_names) THEN _found ELSE {rebuilt} END"
    return let(entries, "_found", let("transform(_found, _e -> _e.name)", "_names", check))


def signature(attributes: str) -> str:
    """``array<struct<name,ctype>>``: what the diff compares, in header order."""
    named = f"filter({attributes}, _a -> _a.name IS NOT NULL)"
    entry = struct(name="_a.name", ctype=effective_type("_a"))
    return unique_by_name(f"transform({named}, _a -> {entry})")


def signature_json(sig: str) -> str:
    """Order-insensitive text form of a signature, with the widening family of each type."""
    entry = struct(n="_s.name", t="_s.ctype", f=type_family("_s.ctype"))
    return f"to_json(transform(sort_array({sig}), _s -> {entry}))"


def header_shape(df: DataFrame, latest_json: str) -> DataFrame:
    """Add ``shape`` and ``attributes`` of a stored "latest" record given as JSON text.

    Shapes in order of preference: direct, wrapped_header, latest_is_header; a missing,
    empty or unreadable record is no_latest and anything else is invalid_shape.
    """
    places = {
        "direct": ("$.header", "$.header.attributes"),
        "wrapped_header": ("$.header.header", "$.header.header.attributes"),
        "latest_is_header": ("$", "$.attributes"),
    }
    item = f"array<{ATTRIBUTE.simpleString()}>"

    def kind(path):
        part = "_doc" if path == "$" else f"try_variant_get(_doc, '{path}', 'variant')"
        return f"coalesce(schema_of_variant({part}), 'none')"

    shapes = " ".join(
        f"WHEN startswith({kind(owner)}, 'OBJECT') AND startswith({kind(attributes)}, 'ARRAY') THEN '{name}'"
        for name, (owner, attributes) in places.items()
    )
    found = " ".join(
        f"WHEN '{name}' THEN try_variant_get(_doc, '{attributes}', '{item}')" for name, (_, attributes) in places.items()
    )
    top = kind("$")
    return (
        df.withColumn("_doc", F.try_parse_json(latest_json))
        .withColumn(
            "shape",
            F.expr(
                f"CASE WHEN NOT startswith({top}, 'OBJECT') OR {top} = 'OBJECT<>' THEN 'no_latest' {shapes} "
                "ELSE 'invalid_shape' END"
            ),
        )
        .withColumn("attributes", F.expr(f"CASE shape {found} END"))
        .drop("_doc")
    )


def resolve_previous_version(producer_value: str, current_version: str) -> str:
    return f"coalesce({producer_value}, {current_version})"
