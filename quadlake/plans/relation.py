"""Solution tables: a DataFrame and, for each variable, how its columns hold terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Term


@dataclass(frozen=True)
class Spec:
    kind: str
    prefix: str = ""
    type: str = ""
    num: bool = False


@dataclass
class Relation:
    df: DataFrame
    specs: dict[str, Spec]
    maybe: set[str] = field(default_factory=set)  # variables that may be unbound

    def term(self, name: str, suffix: str = "") -> Term:
        s = self.specs[name]
        col = f"v_{name}{suffix}"
        return Term(s.kind, F.col(col), s.prefix, F.col(col + "_lang") if s.kind == "lang" else None, F.col(col + "_num") if s.num else None, s.type)

    def scope(self) -> dict[str, Term]:
        return {n: self.term(n) for n in self.specs}

    def select(self, names: list[str]) -> Relation:
        return build(self.df, {n: self.term(n) for n in names if n in self.specs}, self.maybe & set(names))

    def renamed(self, suffix: str) -> DataFrame:
        return self.df.select(*[F.col(c).alias(c.replace(f"v_{n}", f"v_{n}{suffix}", 1)) for n in self.specs for c in columns(n, self.specs[n])])


def columns(name: str, spec: Spec) -> list[str]:
    return [f"v_{name}", *([f"v_{name}_lang"] if spec.kind == "lang" else []), *([f"v_{name}_num"] if spec.num else [])]


def parts(name: str, t: Term) -> list[Column]:
    out = [t.col.alias(f"v_{name}")]
    if t.kind == "lang":
        out.append(t.lang.alias(f"v_{name}_lang"))
    if t.num is not None:
        out.append(t.num.alias(f"v_{name}_num"))
    return out


def spec_of(t: Term) -> Spec:
    return Spec(t.kind, t.prefix, t.type, t.num is not None)


def build(df: DataFrame, terms: dict[str, Term], maybe: set[str] = frozenset()) -> Relation:
    """A relation of those terms; without any, rows still count."""
    chosen = [c for n, t in terms.items() for c in parts(n, t)]
    return Relation(df.select(*chosen) if chosen else df.select(F.lit(1).alias("__row")), {n: spec_of(t) for n, t in terms.items()}, set(maybe))
