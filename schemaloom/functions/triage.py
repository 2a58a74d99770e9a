"""Classification of handler errors."""

from __future__ import annotations

from schemaloom.functions.text import in_list, lit

# Call codes and message parts that mark an error as worth retrying.
TRANSIENT_CODES = ["UNAVAILABLE", "DEADLINE_EXCEEDED", "RESOURCE_EXHAUSTED"]
TRANSIENT_MARKERS = [
    "statuscode.unavailable",
    "connection refused",
    "failed to connect to all addresses",
    "connect: connection refused",
    "unavailable",
    "temporarily unavailable",
]


def is_transient(code: str, message: str) -> str:
    by_text = " OR ".join(f"contains(lower(coalesce({message}, '')), {lit(m)})" for m in TRANSIENT_MARKERS)
    return f"(coalesce({in_list(code, TRANSIENT_CODES)}, false) OR {by_text})"
