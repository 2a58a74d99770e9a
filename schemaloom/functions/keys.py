"""Deterministic keys: idempotency keys, correlation ids and plan ids."""

from __future__ import annotations

from schemaloom.functions.text import let, lit

# Characters with a short escape in JSON text.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: str) -> str:
    return f"concat({lit(chr(92) + 'u')}, lower(lpad(hex({code}), 4, '0')))"


def _escaped(ch: str) -> str:
    """JSON form of one character; those above the basic plane become a pair of units."""
    short = " ".join(f"WHEN {ch} = {lit(c)} THEN {lit(e)}" for c, e in _SHORT.items())
    high, low = "55296 + shiftright(_c - 65536, 10)", "56320 + ((_c - 65536) & 1023)"
    return let(
        f"ascii({ch})",
        "_c",
        f"CASE {short} WHEN _c BETWEEN 32 AND 126 THEN {ch} WHEN _c < 65536 THEN {_unit('_c')} "
        f"ELSE concat({_unit(high)}, {_unit(low)}) END",
    )


def json_ascii_string(x: str) -> str:
    """JSON text of a string with every non-ASCII character escaped; null gives ``null``.

    Only texts that need it are taken apart, into runs of plain characters and single others.
    """
    plain = r"[ !#-\[\]-~]"
    whole, parts = lit(rf"\A{plain}*\z"), lit(rf"{plain}+|{plain.replace('[', '[^', 1)}")
    part = f"CASE WHEN length(_ch) > 1 THEN _ch ELSE {_escaped('_ch')} END"
    chars = f"array_join(transform(regexp_extract_all({x}, {parts}, 0), _ch -> {part}), '')"
    body = f"CASE WHEN rlike({x}, {whole}) THEN {x} ELSE {chars} END"
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE concat('\"', {body}, '\"') END"


def json_ascii_object(fields: dict[str, str]) -> str:
    """JSON object text with sorted keys and ", " / ": " separators."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [lit(("{" if i == 0 else ", ") + f'"{key}": '), fields[key]]
    return f"concat({', '.join(parts)}, '}}')"


def idempotency_key(dataset_id: str, layer: str, kind: str, target: str, params: str) -> str:
    """Content hash of an operation: equal operations on a dataset share one key.

    All arguments are JSON texts already (``json_ascii_string``, ``json_ascii_object``).
    """
    fields = {"dataset_id": dataset_id, "layer": layer, "kind": kind, "target": target, "params": params}
    return f"sha2({json_ascii_object(fields)}, 256)"


def _stable_id(kind: str, dataset_id: str, seq: str) -> str:
    return f"sha2(concat_ws('|', '{kind}', {dataset_id}, cast({seq} AS string)), 256)"


def correlation_id(dataset_id: str, seq: str) -> str:
    """Stable under task retries, unlike a random id."""
    return _stable_id("correlation", dataset_id, seq)


def plan_id(dataset_id: str, seq: str) -> str:
    return _stable_id("plan", dataset_id, seq)
