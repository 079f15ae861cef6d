"""SQL text for rules that are also column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def count_of(column: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({column}, {text(w)})::INT" for w in words) + ")"


def case(rules: Sequence[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {text(v)}" for c, v in rules) + f" ELSE {default} END"
