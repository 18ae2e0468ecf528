"""Queries over a mapped graph or a quad store, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expr import compile_expression, text_of
from .functions.terms import canonical
from .operators import joins
from .plans.algebra import Bgp, Iri, Query, Triple, Union, Var, graph_terms
from .plans.compiler import Compiler, instantiate
from .plans.parser import parse
from .plans.relation import Relation, build
from .sources.ids import IdStore, needed


def result(out: Relation) -> DataFrame:
    """One column a variable: IRIs as text, literals in their native type, mixed terms as N-Triples."""
    cols = []
    for n in out.specs:
        t = out.term(n)
        cols.append((text_of(t) if t.kind in ("iri", "key") else t.col).alias(n))
    return out.df.select(*cols)


def sparql(source, text: str) -> DataFrame:
    """SELECT: a column a variable. ASK: result. CONSTRUCT and DESCRIBE: s, p, o."""
    q = parse(text)
    compiler = compiler_for(source, q)
    if q.form == "select":
        return result(compiler.compile(q.pattern))
    if q.form == "ask":
        found = compiler.compile(q.pattern).df.select(F.lit(1).alias("x")).limit(1)
        return found.agg((F.count("x") > 0).alias("result"))
    if q.form == "construct":
        return instantiate(compiler.compile(q.pattern), q.template)
    return describe(compiler, q)


def compiler_for(source, q: Query) -> Compiler:
    """A compiler of the query's data set; a store of ids learns the query's constants first."""
    wanted = None
    if isinstance(source, IdStore):
        source = source.learn(q)
        wanted = needed(q)
        if wanted is not None:
            wanted = wanted | {x.name for x in graph_terms(q.pattern) if isinstance(x, Var) and q.named_graphs}
    return Compiler(source, q.default_graphs, q.named_graphs, wanted)


def describe(compiler: Compiler, q: Query) -> DataFrame:
    """All statements about the resources, and about the blank nodes that they lead to."""
    found = compiler.compile(q.pattern)
    parts = []
    wanted = q.template or [Var(n) for n in found.specs if not n.startswith("__")]
    for x in wanted:
        if isinstance(x, Iri):
            parts.append(compiler.compile(Bgp([Triple(x, Var("p"), Var("o"))])))
            t = compile_expression(x, {})
            parts[-1] = build(parts[-1].df, {"s": t, "p": parts[-1].term("p"), "o": parts[-1].term("o")})
        else:
            which = build(found.df, {"s": found.term(x.name)})
            which = Relation(which.df.distinct(), which.specs)
            parts.append(joins.join(compiler.compile(Bgp([Triple(Var("s"), Var("p"), Var("o"))])), which).select(["s", "p", "o"]))
    whole = joins.union(parts) if len(parts) > 1 else parts[0]
    rows = whole.df.select(*[canonical(whole.term(n)).alias(n) for n in "spo"]).distinct()
    if hasattr(compiler.source, "quads"):
        quads = compiler.source.quads.select("s", "p", "o").distinct()
        while True:
            blanks = rows.where("o LIKE '\\_:%'").select(F.col("o").alias("s")).distinct().join(rows.select("s").distinct(), "s", "left_anti")
            more = quads.join(blanks, "s", "left_semi")
            if more.isEmpty():
                break
            rows = rows.union(more)
    return rows


def contexts(text: str) -> list[str]:
    """The variables that stand for graphs in a query."""
    return [x.name for x in dict.fromkeys(graph_terms(parse(text).pattern)) if isinstance(x, Var)]


def explain_algebra(text: str) -> str:
    """The algebra of a query, one node a line."""
    lines = []

    def show(node, depth: int) -> None:
        inner = [k for k in ("left", "right", "pattern") if hasattr(node, k)]
        rest = {k: v for k, v in vars(node).items() if k not in (*inner, "parts")}
        lines.append("  " * depth + type(node).__name__ + (f" {rest}" if rest else ""))
        for child in [getattr(node, k) for k in inner] + list(getattr(node, "parts", [])):
            show(child, depth + 1)

    show(parse(text).pattern, 0)
    return "\n".join(lines)


def everything(source) -> DataFrame:
    """All statements as canonical s, p, o."""
    found = Compiler(source).compile(Union([Bgp([Triple(Var("s"), Var("p"), Var("o"))])]))
    return found.df.select(*[canonical(found.term(n)).alias(n) for n in "spo"])


def statements(source) -> DataFrame:
    """All quads as canonical s, p, o, g: the materialised form of a mapped graph."""
    found = Compiler(source).compile(Bgp([Triple(Var("s"), Var("p"), Var("o"))]), Var("g"))
    return found.df.select(*[canonical(found.term(n)).alias(n) for n in "spog"])
