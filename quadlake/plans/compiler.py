"""Algebra to DataFrames. Everything is declared; Catalyst picks the physical plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.expr import compile_expression, number_of, order_keys, text_of, truth_of, unify
from ..functions.terms import Term, canonical
from ..operators import joins
from ..operators.paths import closure
from .algebra import XSD, Bgp, Call, Distinct, Exists, Extend, Filter, Graph, Group, Intersect, Iri, Join, LeftJoin, Minus, OrderBy, Path, Project, Slice, Triple, Union, Values, Var, expression_vars
from .optimizer import Fresh, flatten, merge, ordered, stars
from .relation import Relation, build, columns, parts, spec_of

#: Predicates with a meaning of their own: IRI -> function(compiler, triple, graph) -> Relation.
PROPERTY_FUNCTIONS: dict = {}


def register_property_function(iri: str, function: Callable[[Compiler, Triple, object], Relation]) -> None:
    """From now on, patterns with that predicate mean what the function gives; it binds the triple's variables."""
    PROPERTY_FUNCTIONS[iri] = function


class Compiler:
    """source: a mapped graph or a quad store; default and named: graphs of FROM and FROM NAMED."""

    def __init__(self, source, default: list[str] = (), named: list[str] = (), wanted: set[str] | None = None):
        """wanted: the variables to decode, if the source holds ids (None: all)."""
        self.source, self.spark, self.default, self.named, self.wanted = source, source.spark, list(default), list(named), wanted

    def compile(self, node, graph=None) -> Relation:
        return getattr(self, "_" + type(node).__name__.lower())(node, graph)

    def branches(self, node, graph) -> list[Relation] | None:
        """The parts of a pattern over one star that several tables have, with filters and assignments
        done in each: a part's terms keep their native columns, so that its scan takes the filter."""
        if isinstance(node, Bgp):
            plain, others = flatten(node)
            if others or any(isinstance(t.p, (Path, Var)) or t.p.value in PROPERTY_FUNCTIONS for t in plain) or isinstance(graph, Var):
                return None
            groups = stars(plain, self.source.keyed)
            if len(groups) != 1:
                return None
            found = self.source.star(groups[0][0].s, [(t.p, t.o) for t in groups[0]], graph, self.default)
            return found if len(found) > 1 else None
        if isinstance(node, Filter) and not any(map(_has_exists, node.conditions)):
            found = self.branches(node.pattern, graph)
            return found and [self._kept(x, node.conditions) for x in found]
        if isinstance(node, Extend) and not _has_exists(node.expr):
            found = self.branches(node.pattern, graph)
            return found and [self._assigned(x, node) for x in found]
        return None

    def _kept(self, out: Relation, conditions: list) -> Relation:
        df, scope = out.df, out.scope()
        for e in conditions:
            df = df.where(truth_of(compile_expression(e, scope)))
        return Relation(df, out.specs, out.maybe)

    def unit(self) -> Relation:
        return build(self.spark.range(1), {})

    # patterns
    def _bgp(self, node: Bgp, graph) -> Relation:
        plain, others = flatten(node)
        special = [t for t in plain if isinstance(t.p, Iri) and t.p.value in PROPERTY_FUNCTIONS]
        plain = [t for t in plain if t not in special]
        out, groups, paths = None, ordered(stars(plain, self.source.keyed)), []
        if hasattr(self.source, "decode"):  # paths give terms, so they wait until ids have become terms
            paths = [g for g in groups if isinstance(g[0].p, Path)]
            groups = [g for g in groups if g not in paths]
        for group in groups:
            found = self._group_of_triples(group, graph)
            out = found if out is None else joins.join(out, found)
        if out is not None and hasattr(self.source, "decode"):
            out = self.source.decode(out, None if others or special or paths else self.wanted)
        for group in paths:
            found = self._group_of_triples(group, graph)
            out = found if out is None else joins.join(out, found)
        if out is not None and isinstance(graph, Var) and self.named and graph.name in out.specs:
            out = Relation(out.df.where(text_of(out.term(graph.name)).isin(self.named)), out.specs, out.maybe)
        for x in others:
            found = self.compile(x, graph)
            out = found if out is None else joins.join(out, found)
        for t in special:
            found = PROPERTY_FUNCTIONS[t.p.value](self, t, graph)
            out = found if out is None else joins.join(out, found)
        return out if out is not None else self.unit()

    def _group_of_triples(self, group: list, graph) -> Relation:
        first = group[0]
        names = list(dict.fromkeys(x.name for t in group for x in (t.s, t.p, t.o, graph) if isinstance(x, Var)))
        if isinstance(first.p, Path):
            return self._path(first, graph)
        if isinstance(first.p, Var):
            found = self.source.triple(first.s, first.p, first.o, graph, self.default)
        else:
            found = self.source.star(first.s, [(t.p, t.o) for t in group], graph, self.default)
        if not found:
            return build(self.spark.range(0), {n: Term("str", F.lit(None).cast("string")) for n in names})
        return found[0] if len(found) == 1 else joins.union(found)

    def _path(self, t: Triple, graph) -> Relation:
        p, inner = t.p, Compiler(self.source, self.default, self.named)
        a, b = Fresh.var(), Fresh.var()
        if p.op == "!":
            v = Fresh.var()
            forward = [x.value for x in p.args if isinstance(x, Iri)]
            found = inner.compile(Bgp([Triple(a, v, b)]), graph)
            steps = Relation(found.df.where(~text_of(found.term(v.name)).isin(forward)), found.specs).select([a.name, b.name])
        else:
            steps = inner.compile(Bgp([Triple(a, p.args[0], b)]), graph).select([a.name, b.name])
        ends = joins.unify([steps.term(a.name), steps.term(b.name)])
        if ends[0].kind == "lang":
            ends = [Term("term", canonical(x)) for x in ends]
        kind = ends[0]
        pairs = steps.df.select(ends[0].col.alias("a"), ends[1].col.alias("b"))

        def fixed(x):
            if isinstance(x, Var):
                return None
            if kind.kind == "key":
                return F.lit(x.value.removeprefix(kind.prefix)).try_cast(pairs.schema["a"].dataType.simpleString()) if isinstance(x, Iri) and x.value.startswith(kind.prefix) else F.lit(None).cast(pairs.schema["a"].dataType)
            c = compile_expression(x, {})
            return canonical(c) if kind.kind == "term" else text_of(c)

        start, end = fixed(t.s), fixed(t.o)
        if p.op in ("*", "+"):
            pairs = closure(pairs, start, end)
        if p.op in ("*", "?"):
            if start is not None or end is not None:
                same = self.spark.range(1).select((start if start is not None else end).alias("a")).select("a", F.col("a").alias("b"))
            else:
                every = inner.compile(Union([Bgp([Triple(a, Var("__q"), Var("__o"))]), Bgp([Triple(Var("__s"), Var("__q"), a)])]), graph).select([a.name])
                node = every.term(a.name)
                if kind.kind == "key":
                    pairs, kind = pairs.select(text_of(kind.on(F.col("a"))).alias("a"), text_of(kind.on(F.col("b"))).alias("b")), Term("iri", F.col("a"))
                if kind.kind != node.kind:
                    pairs, kind = pairs.select(canonical(kind.on(F.col("a"))).alias("a"), canonical(kind.on(F.col("b"))).alias("b")), Term("term", F.col("a"))
                    node = Term("term", canonical(node))
                same = every.df.select(node.col.alias("a")).select("a", F.col("a").alias("b"))
            pairs = pairs.union(same).distinct()
        elif p.op == "?":
            pairs = pairs.distinct()
        if start is not None:
            pairs = pairs.where(F.col("a") == start)
        if end is not None:
            pairs = pairs.where(F.col("b") == end)
        terms = {}
        for x, c in ((t.s, "a"), (t.o, "b")):
            if isinstance(x, Var):
                if x.name in terms:
                    pairs = pairs.where("a = b")
                else:
                    terms[x.name] = Term(kind.kind, F.col(c), kind.prefix, type=kind.type)
        return build(pairs, terms)

    def _graph(self, node: Graph, graph) -> Relation:
        if isinstance(node.name, Iri) and self.named and node.name.value not in self.named:
            names = sorted(self.compile(node.pattern, node.name).specs)
            return build(self.spark.range(0), {n: Term("str", F.lit(None).cast("string")) for n in names})
        inner = Compiler(self.source, [], self.named, self.wanted)
        return inner.compile(node.pattern, node.name)

    def _values(self, node: Values, graph) -> Relation:
        """One table of literal rows; UNDEF is unbound."""
        if not node.vars:
            return self.unit() if node.rows else build(self.spark.range(0), {})
        if not node.rows:
            return build(self.spark.range(0), {n: Term("str", F.lit(None).cast("string")) for n in node.vars})
        one, fields, terms, maybe = self.spark.range(1), [[] for _ in node.rows], {}, set()
        for k, n in enumerate(node.vars):
            given = [i for i, row in enumerate(node.rows) if row[k] is not None]
            same = unify([compile_expression(node.rows[i][k], {}) for i in given]) if given else [Term("str", F.lit(None).cast("string"))]
            like = Term(same[0].kind, F.col(f"v_{n}"), same[0].prefix, F.col(f"v_{n}_lang") if same[0].kind == "lang" else None, None, same[0].type)
            kind = one.select(same[0].col.alias("x")).schema["x"].dataType
            for i, row in enumerate(fields):
                t = same[given.index(i)] if i in given else None
                row.append((t.col if t else F.lit(None)).cast(kind).alias(f"v_{n}"))
                if like.kind == "lang":
                    row.append((t.lang if t else F.lit(None)).cast("string").alias(f"v_{n}_lang"))
            terms[n] = like
            if len(given) < len(node.rows):
                maybe.add(n)
        return build(one.select(F.inline(F.array(*[F.struct(*row) for row in fields]))), terms, maybe)

    def _join(self, node: Join, graph) -> Relation:
        node = merge(node)
        if isinstance(node, Bgp):
            return self._bgp(node, graph)
        return joins.join(self.compile(node.left, graph), self.compile(node.right, graph))

    def _leftjoin(self, node: LeftJoin, graph) -> Relation:
        conditions = None
        if node.conditions:
            conditions = lambda scope: [compile_expression(e, scope) for e in node.conditions]
        return joins.left_join(self.compile(node.left, graph), self.compile(node.right, graph), conditions)

    def _union(self, node: Union, graph) -> Relation:
        return joins.union([self.compile(p, graph) for p in node.parts])

    def _intersect(self, node: Intersect, graph) -> Relation:
        return joins.intersect([self.compile(p, graph) for p in node.parts])

    def _minus(self, node: Minus, graph) -> Relation:
        return joins.minus(self.compile(node.left, graph), self.compile(node.right, graph))

    def _filter(self, node: Filter, graph) -> Relation:
        if found := self.branches(node, graph):
            return joins.union(found)
        out = self.compile(node.pattern, graph)
        for e in node.conditions:
            inner, negated = e, False
            while isinstance(inner, Call) and inner.op == "!":
                inner, negated = inner.args[0], not negated
            if isinstance(inner, Exists):
                out = self._exists(out, inner, negated, graph)
            else:
                marks: dict = {}
                scope = out.scope()
                condition = compile_expression(e, scope, lambda x, m=marks: self._mark(x, m))
                names = list(out.specs)
                for name, x in marks.items():
                    out = self._marked(out, x, name, graph)
                df = out.df.where(truth_of(condition))
                out = Relation(df, {n: out.specs[n] for n in names}, out.maybe)
        return out

    def _exists(self, out: Relation, e: Exists, negated: bool, graph) -> Relation:
        pattern, outer = e.pattern, []
        if isinstance(pattern, Filter):
            inside = set(self.compile(pattern.pattern, graph).specs)
            outer = [c for c in pattern.conditions if not isinstance(c, Exists) and not expression_vars(c) <= inside]
            rest = [c for c in pattern.conditions if c not in outer]
            pattern = Filter(pattern.pattern, rest) if rest else pattern.pattern
        conditions = (lambda scope: [compile_expression(c, scope) for c in outer]) if outer else None
        return joins.exists(out, self.compile(pattern, graph), e.negated != negated, conditions)

    def _mark(self, e: Exists, marks: dict) -> Term:
        name = f"__mark{len(marks)}"
        marks[name] = e
        return Term("bool", F.col(name))

    def _marked(self, out: Relation, e: Exists, name: str, graph) -> Relation:
        """A column that tells whether the pattern holds, for EXISTS inside an expression."""
        if not isinstance(e.pattern, Filter) and (flagged := joins.flagged(out, self.compile(e.pattern, graph), name, e.negated)):
            return flagged
        yes = self._exists(out, Exists(e.pattern), False, graph)
        no = self._exists(out, Exists(e.pattern, True), False, graph)
        df = yes.df.withColumn(name, F.lit(not e.negated)).unionByName(no.df.withColumn(name, F.lit(e.negated)))
        return Relation(df, out.specs, out.maybe)

    def _extend(self, node: Extend, graph) -> Relation:
        if found := self.branches(node, graph):
            return joins.union(found)
        return self._assigned(self.compile(node.pattern, graph), node)

    def _assigned(self, out: Relation, node: Extend) -> Relation:
        t = compile_expression(node.expr, out.scope())
        return Relation(out.df.select("*", *parts(node.var, t)), out.specs | {node.var: spec_of(t)}, out.maybe | {node.var})

    # solution modifiers
    def _group(self, node: Group, graph) -> Relation:
        out = self.compile(node.pattern, graph)
        scope = out.scope()
        keys = {n: compile_expression(e, scope) for n, e in node.keys}
        aggregates, terms = [], {}
        for name, a in node.aggregates:
            t = None if a.arg is None else compile_expression(a.arg, scope)
            made = self._aggregate(a, t, list(scope.values()))
            aggregates += [c.alias(f"v_{name}" + ("_lang" if i else "")) for i, c in enumerate(made[1])]
            terms[name] = Term(made[0].kind, F.col(f"v_{name}"), made[0].prefix, F.col(f"v_{name}_lang") if made[0].kind == "lang" else None, type=made[0].type)
        columns_ = [c for n, t in keys.items() for c in parts(n, Term(t.kind, t.col, t.prefix, t.lang, None, t.type))]
        if not aggregates:
            df = out.df.select(*columns_).distinct()
        else:
            df = out.df.groupBy(*columns_).agg(*aggregates)
        specs = {n: spec_of(Term(t.kind, t.col, t.prefix, t.lang, None, t.type)) for n, t in keys.items()} | {n: spec_of(t) for n, t in terms.items()}
        return Relation(df, specs, {n for n, _ in node.keys if n in out.maybe or n not in out.specs} | {n for n, a in node.aggregates if a.op in ("min", "max", "sample")})

    def _aggregate(self, a, t: Term | None, every: list[Term]):
        """(shape of the result, its columns)."""
        if a.op == "count":
            if t is None:
                if a.distinct:
                    return Term("num", None, type=XSD + "integer"), [F.count_distinct(F.struct(*[F.coalesce(canonical(x), F.lit("")) for x in every]))]
                return Term("num", None, type=XSD + "integer"), [F.count(F.lit(1))]
            what = t.col if t.kind != "lang" else F.when(t.col.isNotNull(), F.struct(t.col, t.lang))
            return Term("num", None, type=XSD + "integer"), [F.count_distinct(what) if a.distinct else F.count(t.col)]
        if a.op in ("sum", "avg"):
            value = number_of(t)
            f = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg, ("avg", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}[(a.op, a.distinct)]
            return Term("num", None, type=t.type or XSD + "double"), [F.coalesce(f(value), F.lit(0))]
        if a.op == "group_concat":
            text = text_of(t)
            return Term("str", None), [F.array_join(F.sort_array((F.collect_set if a.distinct else F.collect_list)(text)), a.separator)]
        f = F.max if a.op == "max" else F.min
        if t.kind == "term":
            number = number_of(t)
            return t, [f(F.struct(F.when(number.isNull(), 1).otherwise(0), number, text_of(t), t.col.alias("t")))["t"]]
        if t.kind == "lang":
            both = f(F.when(t.col.isNotNull(), F.struct(t.col.alias("t"), t.lang.alias("l"))))
            return t, [both["t"], both["l"]]
        return t, [f(t.col)]

    def _project(self, node: Project, graph) -> Relation:
        if node.names and (found := self.branches(node.pattern, graph)):
            return joins.union([self._projected(x, node.names) for x in found])
        out = self.compile(node.pattern, graph)
        return self._projected(out, node.names)

    def _projected(self, out: Relation, names: list) -> Relation:
        names = names or [n for n in out.specs if not n.startswith("__")]
        terms = {n: out.term(n) if n in out.specs else Term("str", F.lit(None).cast("string")) for n in names}
        return build(out.df, terms, out.maybe & set(names) | {n for n in names if n not in out.specs})

    def _distinct(self, node: Distinct, graph) -> Relation:
        inner = node.pattern
        order = inner.pattern if isinstance(inner, Project) and isinstance(inner.pattern, OrderBy) else None
        out = self._project(Project(order.pattern, inner.names), graph) if order else self.compile(inner, graph)
        keys = [c for n, s in out.specs.items() for c in columns(n, s) if not c.endswith("_num")]
        out = Relation(out.df.dropDuplicates(keys) if keys else out.df.distinct(), out.specs, out.maybe)
        return self._sorted(out, order.keys) if order else out

    def _orderby(self, node: OrderBy, graph) -> Relation:
        return self._sorted(self.compile(node.pattern, graph), node.keys)

    def _sorted(self, out: Relation, keys: list) -> Relation:
        scope = out.scope()
        by = [c for e, up in keys for c in order_keys(compile_expression(e, scope), up)]
        return Relation(out.df.orderBy(*by), out.specs, out.maybe)

    def _slice(self, node: Slice, graph) -> Relation:
        out = self.compile(node.pattern, graph)
        df = out.df.offset(node.offset) if node.offset else out.df
        return Relation(df if node.limit is None else df.limit(node.limit), out.specs, out.maybe)


def _has_exists(e) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(map(_has_exists, e.args))


def instantiate(out: Relation, template: list, row_id: bool = False) -> Relation:
    """CONSTRUCT: the template's triples for every solution, each once; incomplete ones are left out."""
    scope = out.scope()

    def place(x):
        if isinstance(x, Var) and x.name not in scope:
            return F.concat(F.lit(f"_:{x.name}_"), F.md5(F.concat_ws("|", *[F.coalesce(canonical(t), F.lit("")) for t in scope.values()])))
        return canonical(compile_expression(x, scope))

    rows = F.array(*[F.struct(place(t.s).alias("s"), place(t.p).alias("p"), place(t.o).alias("o")) for t in template])
    df = out.df.select(F.explode(rows).alias("t")).select("t.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND s NOT LIKE '\"%' AND p LIKE '<%'").distinct()
    return df
