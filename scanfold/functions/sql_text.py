"""Small helpers to write Spark SQL expressions from value tables.

One parsed expression is much cheaper to build than the same tree put together from
hundreds of ``Column`` calls.
"""

import re


def quote(text) -> str:
    """A string literal, or NULL."""
    if text is None:
        return "NULL"
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def numbers(values) -> str:
    return ", ".join(str(v) for v in values)


def strings(values) -> str:
    return ", ".join(quote(v) for v in values)


def case(pairs, otherwise: str | None = None) -> str:
    """CASE over (condition, value) pairs of SQL text; the first match wins."""
    body = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    return f"CASE {body}" + ("" if otherwise is None else f" ELSE {otherwise}") + " END"


def contains_any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in tokens) + ")"


def listed(pairs) -> str:
    """Array of the values whose condition holds, in order; pairs are SQL text."""
    if not pairs:
        return "cast(array() AS array<string>)"
    return "array_compact(array(" + ", ".join(
        value if cond is None else f"CASE WHEN {cond} THEN {value} END" for value, cond in pairs) + "))"


def fill(text: str, **known: str) -> str:
    """A text with ``{column}`` places as a concatenation; ``known`` gives SQL for a place."""
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{"):
            name = piece[1:-1]
            parts.append(f"cast({known.get(name, name)} AS string)")
        elif piece:
            parts.append(quote(piece))
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"
