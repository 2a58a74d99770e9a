"""Building blocks of SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable


def lit(value: str) -> str:
    """String literal; anything but plain ASCII is written as an escape."""

    def char(c: str) -> str:
        if c in "\\'":
            return "\\" + c
        return c if " " <= c <= "~" else f"\\u{ord(c):04x}"

    return "'" + "".join(map(char, value)) + "'"


def in_list(x: str, values: Iterable[str]) -> str:
    return f"{x} IN ({', '.join(map(lit, values))})"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once per row.

    An expression that is repeated, or stands inside the lambda of a higher-order function, is
    otherwise evaluated at each place and for each element.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def empty(item: str = "string") -> str:
    return f"cast(array() AS array<{item}>)"
