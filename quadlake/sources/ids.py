"""A quad store of ids: patterns join on numbers, and terms are looked up after the joins.

Constants become ids once for a query, in one lookup. A basic graph pattern is evaluated over
ids alone; of its variables only those that the rest of the query reads are decoded. Numeric
values of objects travel with their ids, so comparisons need no terms.
"""

from __future__ import annotations

from collections import Counter
from copy import copy
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import constant
from ..functions.terms import Term
from ..plans.algebra import Aggregate, Bgp, Exists, Extend, Graph, Group, Iri, Literal, Project, Query, Triple, Values, Var
from ..plans.relation import Relation, build
from ..storage import persisted
from .store import ORDERS, QuadStore, access_path, canonical_text, sorted_layout

MARK = "id:"


def _inside(node):
    """All nodes of a query's algebra, expressions included."""
    yield node
    if is_dataclass(node):
        for f in fields(node):
            yield from _inside(getattr(node, f.name))
    elif isinstance(node, (list, tuple)):
        for x in node:
            yield from _inside(x)


def constants(q: Query) -> set[str]:
    """Canonical texts of the terms in a query's patterns."""
    places = [x for n in _inside(q) for x in ((n.s, n.p, n.o) if isinstance(n, Triple) else (n.name,) if isinstance(n, Graph) else ())]
    return {canonical_text(x) for y in places for x in _inside(y) if isinstance(x, (Iri, Literal))} | {f"<{x}>" for x in (*q.default_graphs, *q.named_graphs)}


def needed(q: Query) -> set[str] | None:
    """The variables that are read outside of the one basic graph pattern that binds them; None for all."""
    seen: Counter = Counter()
    used: set[str] = {x.name for x in _inside(q.template) if isinstance(x, Var)}
    if q.form == "describe" or q.form == "construct" and not q.template:
        return None

    def walk(node) -> bool:
        """False if all variables are read."""
        if isinstance(node, Bgp):
            seen.update({x.name for t in node.triples for x in _inside(t) if isinstance(x, Var)})
            return True
        if isinstance(node, Var):
            used.add(node.name)
        if isinstance(node, (Project, Values)):
            if isinstance(node, Project) and not node.names:
                return False
            used.update(node.names if isinstance(node, Project) else node.vars)
        if isinstance(node, Extend):
            used.add(node.var)
        if isinstance(node, Group):
            used.update(n for n, _ in node.keys)
        if isinstance(node, Aggregate) and node.arg is None and node.distinct:
            return False
        inner = [getattr(node, f.name) for f in fields(node)] if is_dataclass(node) else node if isinstance(node, (list, tuple)) else []
        return all([walk(x) for x in inner])

    return used | {n for n, k in seen.items() if k > 1} if walk(q.pattern) else None


@dataclass
class IdStore:
    """layouts: s, p, o, g as ids and o_num, sorted in several orders; dictionary: id, term and its parts."""

    spark: SparkSession
    layouts: dict[str, DataFrame]
    dictionary: DataFrame
    known: dict[str, int | None] = field(default_factory=dict)

    @classmethod
    def of(cls, store: QuadStore, known: DataFrame | None = None, orders: tuple[str, ...] = ORDERS) -> IdStore:
        """Gives ids to all terms (those of `known` keep theirs) and stores the quads of ids in each order."""
        dictionary = store.dictionary(known)
        encoded = persisted(store.encoded(dictionary))
        return cls(store.spark, {x: sorted_layout(encoded, x) for x in orders}, dictionary)

    def learn(self, q: Query) -> IdStore:
        """The store to ask. Looks up the ids of a query's constants, in one go; unknown terms match nothing."""
        wanted = sorted(constants(q) - set(self.known))
        if wanted:
            asked = self.spark.createDataFrame([(x,) for x in wanted], "term string")
            found = {r.term: r.id for r in self.dictionary.join(F.broadcast(asked), "term", "left_semi").select("term", "id").collect()}
            self.known.update({x: found.get(x) for x in wanted})
        return self

    def _is(self, name: str, x):
        text = canonical_text(x)
        if text not in self.known:
            self.learn(Query("ask", Bgp([Triple(x, x, x)])))
        found = self.known[text]
        return F.lit(False) if found is None else F.col(name) == found

    # for the compiler
    def triple(self, s, p, o, graph=None, default: list[str] = ()) -> list[Relation]:
        places = [("s", s), ("p", p), ("o", o)] + ([("g", graph)] if graph is not None else [])
        bound = {n for n, x in places if not isinstance(x, Var)}
        df, terms = self.layouts[access_path(bound, tuple(self.layouts))], {}
        if graph is None:
            if default:
                ids = [Iri(d) for d in default]
                named = F.lit(False)
                for d in ids:
                    named = named | self._is("g", d)
                df = df.where(named)
        for name, x in places:
            if isinstance(x, Var):
                continue
            number = constant(x) if name == "o" and isinstance(x, Literal) else None
            df = df.where(F.col("o_num") == number.col if number is not None and number.kind == "num" else self._is(name, x))
        if graph is None:
            df = df.select("s", "p", "o", "o_num").distinct()
        for name, x in places:
            if not isinstance(x, Var):
                continue
            if x.name in terms:
                df = df.where(terms[x.name].col == F.col(name))
            else:
                terms[x.name] = Term("key", F.col(name), MARK, num=F.col("o_num") if name == "o" else None)
        return [build(df, terms)]

    def keyed(self, pairs: list) -> bool:
        return False

    def star(self, subject, pairs: list, graph=None, default: list[str] = ()) -> list[Relation]:
        [(p, o)] = pairs
        return self.triple(subject, p, o, graph, default)

    def decode(self, out: Relation, wanted: set[str] | None) -> Relation:
        """Terms in place of the ids of those variables (None: of all)."""
        df, terms = out.df, out.scope()
        for n, t in out.scope().items():
            if t.prefix == MARK and (wanted is None or n in wanted):
                df = df.join(self.dictionary.select(F.col("id").alias(f"v_{n}"), F.col("term").alias(f"__t_{n}")), f"v_{n}")
                terms[n] = Term("term", F.col(f"__t_{n}"), num=t.num)
        return build(df, terms, out.maybe)


def unread(q: Query) -> set[str]:
    """The variables that stand in one place of the patterns and are read nowhere."""
    wanted = needed(q)
    if wanted is None or q.named_graphs:
        return set()
    seen = Counter(x.name for x in _inside([q.pattern, q.template]) if isinstance(x, Var))
    return {n for n, k in seen.items() if k == 1} - wanted


class IdParts(IdStore):
    """A store of ids that takes in the quads that patterns ask for, over a store of quads.

    A pattern's quads are stored as ids of its variables, once for patterns of one shape; new terms
    follow the dictionary's largest id. Constants are matched before that, and variables that nothing
    reads get no ids.
    """

    def __init__(self, store: QuadStore):
        self.spark, self.store, self.idle = store.spark, store, set()
        self.held: dict = {"parts": {}, "dictionary": store.spark.createDataFrame([], "id long, term string"), "next": 0}

    @property
    def dictionary(self) -> DataFrame:
        return self.held["dictionary"]

    def learn(self, q: Query) -> IdParts:
        asked = copy(self)
        asked.idle = unread(q)
        return asked

    def _take(self, texts: DataFrame, columns: list[str]) -> None:
        """Gives ids to the terms of those columns that have none."""
        if not columns:
            return
        terms = texts.select(F.explode(F.array(*columns)).alias("term") if len(columns) > 1 else F.col(columns[0]).alias("term")).where("term IS NOT NULL").distinct()
        if self.held["next"]:
            terms = terms.join(self.dictionary, "term", "left_anti")
        new = persisted(self.store.numbered(terms, self.held["next"]).select("id", "term"))
        largest = new.agg(F.max("id")).first()[0]
        if largest is not None:
            self.held["dictionary"] = self.dictionary.unionByName(new) if self.held["next"] else new
            self.held["next"] = largest + 1

    def triple(self, s, p, o, graph=None, default: list[str] = ()) -> list[Relation]:
        [found] = self.store.triple(s, p, o, graph, default)
        places = [s, p, o, graph]
        first = {x.name: k for k, x in reversed(list(enumerate(places))) if isinstance(x, Var)}
        live = {n: f"c{first[n]}" for n in found.specs if n not in self.idle}
        numbers = [n for n in live if found.specs[n].num]
        shape = (*[first[x.name] if isinstance(x, Var) else x if x is None else canonical_text(x) for x in places], *default, *live.values())
        if shape not in self.held["parts"]:
            texts = found.df.select(F.lit(1).cast("byte").alias("row"), *[F.col(f"v_{n}").alias(c) for n, c in live.items()], *[F.col(f"v_{n}_num").alias("num") for n in numbers])
            self._take(texts, list(live.values()))
            for c in live.values():
                ids = self.dictionary.select(F.col("id").alias("__id"), F.col("term").alias(c))
                texts = texts.join(ids, c).drop(c).withColumnRenamed("__id", c)
            self.held["parts"][shape] = persisted(texts)
        terms = {n: Term("key", F.col(live[n]) if n in live else F.lit(0).cast("long"), MARK, num=F.lit(None).cast("double") if spec.num and n not in live else F.col("num") if spec.num else None) for n, spec in found.specs.items()}
        return [build(self.held["parts"][shape], terms)]

    def decode(self, out: Relation, wanted: set[str] | None) -> Relation:
        return super().decode(out, (set(out.specs) if wanted is None else wanted) - self.idle)
