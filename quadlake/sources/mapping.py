"""Relational tables as a virtual graph: rows are subjects, columns predicates, keys IRIs.

A star (several predicates of one subject) over a table whose subject template is a key
reads one scan; the IRI of a subject or foreign key is only put together when it leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import constant, equal
from ..functions.terms import Term, xsd_of
from ..plans.algebra import RDF, XSD, Iri, Var
from ..plans.relation import Relation, build

TYPE = RDF + "type"


@dataclass(frozen=True)
class Property:
    column: str
    ref: str = ""  # prefix of the IRIs that the column's values name
    lang: str = ""  # column with the language tag


@dataclass
class TableMap:
    """keyed: the subject template identifies a row (else a star is joined predicate by predicate)."""

    name: str
    df: DataFrame
    prefix: str
    keys: list[str]
    cls: str
    props: dict[str, Property] = field(default_factory=dict)
    keyed: bool = True
    graph: str = ""
    graph_column: str = ""

    def subject(self) -> Term:
        if len(self.keys) == 1:
            return Term("key", F.col(self.keys[0]), self.prefix)
        return Term("iri", F.concat(F.lit(self.prefix), F.concat_ws("/", *[F.col(k).cast("string") for k in self.keys])))

    def value(self, p: Property) -> Term:
        kind = self.df.schema[p.column].dataType
        if p.ref:
            return Term("iri" if p.ref == "*" else "key", F.col(p.column), "" if p.ref == "*" else p.ref)
        if p.lang:
            return Term("lang", F.col(p.column), lang=F.col(p.lang))
        if isinstance(kind, T.NumericType):
            return Term("num", F.col(p.column), type=xsd_of(kind.simpleString()))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Term("time", F.col(p.column).cast("timestamp"), type=XSD + "dateTime")
        return Term("bool" if isinstance(kind, T.BooleanType) else "str", F.col(p.column))

    def graph_term(self) -> Term:
        return Term("key", F.col(self.graph_column), self.graph) if self.graph_column else Term("iri", F.lit(self.graph))


class MappedGraph:
    """A set of mapped tables; subjects of different tables are different."""

    def __init__(self, spark: SparkSession, tables: list[TableMap]):
        self.spark, self.tables = spark, tables

    def predicates(self) -> list[str]:
        return sorted({p for t in self.tables for p in t.props} | {TYPE})

    def nothing(self, names: list[str]) -> Relation:
        terms = {n: Term("str", F.lit(None).cast("string")) for n in names}
        return build(self.spark.range(0), terms)

    def _bind(self, df: DataFrame, terms: dict[str, Term], x, t: Term) -> DataFrame:
        """Matches a pattern's place with a term: filters, or binds the variable."""
        if isinstance(x, Var):
            if x.name in terms:
                a = terms[x.name]
                same = a.col == t.col if (a.kind, a.prefix) == (t.kind, t.prefix) else equal(a, t)
                return df.where(same)
            terms[x.name] = t
            return df
        if t.kind == "key":
            if not (isinstance(x, Iri) and x.value.startswith(t.prefix)):
                return df.where(F.lit(False))
            kind = df.select(t.col.alias("k")).schema["k"].dataType.simpleString()
            return df.where(t.col == F.lit(x.value[len(t.prefix) :]).try_cast(kind))
        return df.where(equal(t, constant(x)))

    def _scope(self, table: TableMap, terms: dict[str, Term], graph, df: DataFrame, default: list[str]) -> DataFrame:
        g = table.graph_term()
        if graph is not None:
            return self._bind(df, terms, graph, g)
        if default:
            if not table.graph_column:
                return df if table.graph in default else df.where(F.lit(False))
            names = [d[len(table.graph) :] for d in default if d.startswith(table.graph)]
            return df.where(F.col(table.graph_column).cast("string").isin(names))
        return df

    def star(self, subject, pairs: list[tuple], graph=None, default: list[str] = ()) -> list[Relation]:
        """The solutions of subject p1 o1; p2 o2; ... with constant predicates, one relation per table."""
        out = []
        for table in self.tables:
            if any(p.value != TYPE and p.value not in table.props for p, _ in pairs):
                continue
            if any(p.value == TYPE and isinstance(o, Iri) and o.value != table.cls for p, o in pairs):
                continue
            if isinstance(subject, Iri) and not subject.value.startswith(table.prefix):
                continue
            terms: dict[str, Term] = {}
            df = self._scope(table, terms, graph, table.df, default)
            df = self._bind(df, terms, subject, table.subject())
            for p, o in pairs:
                if p.value == TYPE:
                    df = self._bind(df, terms, o, Term("iri", F.lit(table.cls)))
                else:
                    t = table.value(table.props[p.value])
                    df = self._bind(df.where(t.col.isNotNull()), terms, o, t)
            out.append(build(df, terms))
        return out

    def keyed(self, pairs: list[tuple]) -> bool:
        return all(t.keyed for t in self.tables if all(p.value == TYPE or p.value in t.props for p, _ in pairs))

    def triple(self, s, p, o, graph=None, default: list[str] = ()) -> list[Relation]:
        """Solutions of one pattern whose predicate is a variable: one relation per table and predicate."""
        out = []
        for table in self.tables:
            for name in [TYPE, *table.props]:
                for r in MappedGraph(self.spark, [table]).star(s, [(Iri(name), o)], graph, default):
                    terms = r.scope()
                    out.append(build(self._bind(r.df, terms, p, Term("iri", F.lit(name))), terms))
        return out


def standard_mapping(spark: SparkSession, sf_dir: str, base: str = "http://example.org/") -> MappedGraph:
    """The mapping of the driver's tables: IRIs are base + table + '/' + key, predicates base + column."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def table(name: str, source: str, keys: list[str], refs: dict[str, str] | None = None, skip: tuple = (), lang: dict[str, str] | None = None, graph_column: str = "", **more) -> TableMap:
        df = read(source)
        refs, lang = refs or {}, lang or {}
        props = {base + c: Property(c, ("*" if refs[c] == "*" else base + refs[c] + "/") if c in refs else "", lang.get(c, "")) for c in df.columns if c not in skip}
        return TableMap(name, df, base + name + "/", keys, base + name.capitalize(), props, graph=base + "graph/" + ("" if graph_column else name), graph_column=graph_column, **more)

    conversations = read("conversations")
    turns = table("conv", "conversations", ["conv_id", "turn"])
    turns.df = conversations.withColumn("next", F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")))
    turns.props[base + "next"] = Property("next", base + "conv/")
    return MappedGraph(spark, [
        table("region", "region", ["r_regionkey"]),
        table("nation", "nation", ["n_nationkey"], {"n_regionkey": "region"}),
        table("customer", "customer", ["c_custkey"], {"c_nationkey": "nation"}),
        table("supplier", "supplier", ["s_suppkey"], {"s_nationkey": "nation"}),
        table("part", "part", ["p_partkey"]),
        table("order", "orders", ["o_orderkey"], {"o_custkey": "customer"}),
        table("lineitem", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supplier"}),
        table("event", "events", ["event_id"], {"user_id": "user"}),
        table("doc", "documents", ["doc_id"], skip=("lang",), lang={"text": "lang"}, graph_column="source"),
        table("label", "labels", ["doc_id"], {"doc_id": "doc"}),
        table("page", "pages", ["page_id"], {"url": "*"}),
        table("bench", "benchmark", ["item_id"]),
        turns,
    ])
