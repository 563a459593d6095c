"""Small helpers for expressions written as SQL text."""

from __future__ import annotations


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array_of(items: list[str], element: str | None = None) -> str:
    text = "array(" + ", ".join(items) + ")"
    return f"cast({text} as array<{element}>)" if element else text


def compact(items: list[tuple[str, str]]) -> str:
    """Array of the items whose condition holds, in order; items are (condition, value).

    A concatenation of arrays of one or none is generated code; a filter of nulls would evaluate conditions and values as
    trees of objects.
    """
    return "concat(" + ", ".join(f"if({when}, array({item}), array())" for when, item in items) + ")"


def case_of(subject: str, branches: dict[str, str], default: str) -> str:
    whens = " ".join(f"when {subject} = {q(k)} then {v}" for k, v in branches.items())
    return f"case {whens} else {default} end"
