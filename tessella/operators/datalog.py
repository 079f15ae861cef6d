"""Horn rules over DataFrames: bodies are joins, and a fixpoint is reached by joining new facts only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.tables import stage


@dataclass(frozen=True)
class Atom:
    """A predicate with arguments; those that begin with a capital are variables."""

    predicate: str
    args: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


def is_variable(arg: str) -> bool:
    return arg[:1].isupper()


def bind(atom: Atom, facts: DataFrame) -> DataFrame:
    """The facts that fit an atom, with a column for each of its variables."""
    rows = facts.toDF(*(f"_{i}" for i in range(len(facts.columns))))
    seen: dict[str, str] = {}
    for i, arg in enumerate(atom.args):
        if not is_variable(arg):
            rows = rows.where(F.col(f"_{i}") == arg)
        elif arg in seen:
            rows = rows.where(F.col(f"_{i}") == F.col(seen[arg]))
        else:
            seen[arg] = f"_{i}"
    return rows.select(*(F.col(c).alias(v) for v, c in seen.items()))


def body(atoms: Sequence[Atom], facts: Mapping[str, DataFrame]) -> DataFrame:
    """All bindings of the variables of a rule's body: equi-joins on those that atoms share.

    Atoms are taken in an order in which each shares a variable with those before it.  Only a body whose parts
    share none, which asks for all combinations, has a cross join.
    """
    out, left = None, list(atoms)
    while left:
        near = [a for a in left if out is None or any(x in out.columns for x in a.args if is_variable(x))]
        atom = near[0] if near else left[0]
        left.remove(atom)
        rows = bind(atom, facts[atom.predicate])
        if out is None:
            out = rows
        else:
            shared = [c for c in rows.columns if c in out.columns]
            out = out.join(rows, shared) if shared else out.crossJoin(rows)
    return out


def normal(facts: DataFrame) -> DataFrame:
    """Distinct facts in lower case without outer blanks."""
    return facts.select(*(F.lower(F.trim(F.col(c))).alias(c) for c in facts.columns)).distinct()


def head_of(rule: Rule, bindings: DataFrame) -> DataFrame:
    value = lambda a: F.col(a) if is_variable(a) else F.lit(a)
    return bindings.select(*(value(a).cast("string").alias(f"_{i}") for i, a in enumerate(rule.head.args)))


def fixpoint(facts: Mapping[str, DataFrame], rules: Sequence[Rule], rounds: int = 50) -> dict[str, DataFrame]:
    """All facts that follow, by semi-naive evaluation: in each round one atom of a body takes new facts only."""
    known = {p: stage(normal(df.toDF(*(f"_{i}" for i in range(len(df.columns)))))) for p, df in facts.items()}
    new = dict(known)
    for _ in range(rounds):
        found: dict[str, DataFrame] = {}
        for rule in rules:
            for i, atom in enumerate(rule.body):
                if atom.predicate not in new or any(a.predicate not in known for a in rule.body):
                    continue
                parts = {f"{k}#{a.predicate}": (new if k == i else known)[a.predicate] for k, a in enumerate(rule.body)}
                atoms = [Atom(f"{k}#{a.predicate}", a.args) for k, a in enumerate(rule.body)]
                rows = head_of(rule, body(atoms, parts))
                p = rule.head.predicate
                found[p] = found[p].unionByName(rows) if p in found else rows
        new = {}
        for p, rows in found.items():
            rows = rows.distinct()
            fresh = stage(rows.join(known[p], rows.columns, "left_anti") if p in known else rows)
            if not fresh.isEmpty():
                new[p] = fresh
                known[p] = stage(known[p].unionByName(fresh)) if p in known else fresh
        if not new:
            break
    return known


def contradictions(facts: Mapping[str, DataFrame], a: str, b: str) -> DataFrame:
    """Facts that hold of both predicates."""
    return facts[a].join(facts[b], facts[a].columns, "left_semi")


def verdict(total: Column, verified: Column, contradicted: Column) -> Column:
    return F.when(contradicted > 0, "CONTRADICTED").when(total == 0, "UNGROUNDED").when(verified == total, "VERIFIED").when(verified > 0, "PARTIAL").otherwise("UNGROUNDED")
