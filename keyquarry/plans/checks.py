"""Small SQL text builders for the checks."""

from __future__ import annotations


def lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def values(rows, name: str, columns: list[str]) -> str:
    """``name(columns) AS (VALUES …)`` as a CTE member."""
    body = ", ".join("(" + ", ".join(v if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def case(pairs, otherwise: str = "NULL") -> str:
    """First-match CASE of (condition, result) texts."""
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in pairs) + f" ELSE {otherwise} END"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"
