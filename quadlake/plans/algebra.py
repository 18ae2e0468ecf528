"""The query algebra: terms, expressions and patterns as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Path:
    """op: '/', '|', '^', '*', '+', '?', '!'; args are paths or Iri."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass
class Call:
    """An operator or function application; op is lower case, or an IRI for a cast or extension."""

    op: str
    args: list = field(default_factory=list)


@dataclass
class Aggregate:
    op: str
    arg: Any = None
    distinct: bool = False
    separator: str = " "


@dataclass
class Exists:
    pattern: Any
    negated: bool = False


@dataclass
class Bgp:
    triples: list


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    conditions: list


@dataclass
class Union:
    parts: list


@dataclass
class Intersect:
    """The solutions that all parts have, each once."""

    parts: list


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    pattern: Any
    conditions: list


@dataclass
class Extend:
    pattern: Any
    var: str
    expr: Any


@dataclass
class Values:
    vars: list
    rows: list


@dataclass
class Graph:
    name: Any
    pattern: Any


@dataclass
class Group:
    pattern: Any
    keys: list  # (name, expr)
    aggregates: list  # (name, Aggregate)


@dataclass
class Project:
    pattern: Any
    names: list


@dataclass
class Distinct:
    pattern: Any
    reduced: bool = False


@dataclass
class OrderBy:
    pattern: Any
    keys: list  # (expr, ascending)


@dataclass
class Slice:
    pattern: Any
    offset: int | None
    limit: int | None


@dataclass
class Query:
    form: str
    pattern: Any
    template: list = field(default_factory=list)
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)


def children(node) -> list:
    return [x for k in ("left", "right", "pattern") if (x := getattr(node, k, None)) is not None] + list(getattr(node, "parts", []))


def expression_vars(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(expression_vars, e.args))
    if isinstance(e, Aggregate):
        return expression_vars(e.arg) if e.arg is not None else set()
    return set()


def graph_terms(node) -> list:
    """The names in GRAPH clauses of a pattern, in order (variables and IRIs)."""
    own = [node.name] if isinstance(node, Graph) else []
    return own + [x for c in children(node) for x in graph_terms(c)]


def conjuncts(e) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, Call) and e.op == "&&" else [e]
