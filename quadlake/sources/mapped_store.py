"""The quads of mapped tables as a quad store that keeps no copy of them.

Quads are made from the rows when they are read, and of the tables and columns alone that can hold
a match. They are a set without dealing them out: the quads of a row whose subject no other row has
are different, so only rows that share a subject go through a distinct. Stored are just the hashes
of such subjects, found once for each table.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Term, canonical
from ..plans.algebra import XSD, Iri, Literal
from ..storage import persisted
from .mapping import TYPE, MappedGraph, TableMap
from .store import ENTRY_BYTES, TASK_BYTES, QuadStore, canonical_text, in_parts


def _may_be(t: Term, o, name: str, cls: str) -> bool:
    """Whether an object of that kind can be the constant o."""
    if isinstance(o, Iri):
        return o.value == cls if name == TYPE else t.kind == "iri" or t.kind == "key" and o.value.startswith(t.prefix)
    if isinstance(o, Literal):
        plain = {"str"} if o.dt in (None, "", XSD + "string") else {"num", "time", "bool"}
        return t.kind in ({"lang"} if o.lang else plain)
    return True


class MappedStore(QuadStore):
    def __init__(self, graph: MappedGraph):
        self.spark, self.graph, self.layouts = graph.spark, graph, {}
        self._repeated: dict[str, DataFrame | None] = {}

    @property
    def quads(self) -> DataFrame:
        return self._part()

    def triples(self) -> DataFrame:
        return self._part(unique=("s", "p", "o")).select("s", "p", "o")

    def _rows(self, graph, default: list[str], places: dict) -> DataFrame:
        if graph is not None:
            return self._part(**places, g=graph)
        named = F.col("g").isin([f"<{d}>" for d in default]) if default else None
        return self._part(**places, unique=("s", "p", "o"), where=named).select("s", "p", "o", "o_num")

    def hexastore_parts(self, *bound: str, most: int = 100_000) -> DataFrame:
        """By predicate, rows are dealt over parts before their triples are made; those whose subject others share follow as triples."""
        if bound != ("p",) or not self._apart():
            return super().hexastore_parts(*bound, most=most)
        self._find_repeated(self.graph.tables)
        out, shared, first = [], [], 0
        for table in self.graph.tables:
            rows, values, twice = self._subjects(table), self._values(table), self._repeated[table.name]
            if twice is not None:
                marked = rows.withColumn("__h", F.xxhash64("__s"))
                rows = marked.join(twice, "__h", "left_anti").drop("__h")
                shared.append(self._facts(marked.join(twice, "__h", "left_semi"), values).select("s", "p", "o"))
            subject = F.octet_length("__s") + 64
            # Texts count by their bytes, other values as 64.
            lengths = [F.sum(F.when(t.col.isNotNull(), subject + (F.octet_length(t.col) if t.kind in ("str", "lang", "iri") else F.lit(64)))) for t in values.values()]
            n, *sizes = rows.agg(F.count("*"), *[F.coalesce(x, F.lit(0)) for x in lengths]).first()
            if not n:
                continue
            parts = math.ceil(max(n / most, max(sizes) / ENTRY_BYTES, sum(sizes) / TASK_BYTES))
            dealt = rows.withColumn("part", F.pmod(F.xxhash64("__s"), F.lit(parts)) + first).drop("__s", "__g").repartition(parts, "part")
            facts = self._facts(self._subjects(replace(table, df=dealt)), values, "part")
            out.append(facts.groupBy("p", "part").agg(F.sort_array(F.collect_list(F.struct("s", "o"))).alias("entries")))
            first += parts
        if shared:
            out.append(in_parts(reduce(DataFrame.union, shared).distinct(), bound, most).withColumn("part", F.col("part") + first))
        return reduce(DataFrame.union, out) if out else super().hexastore_parts(*bound, most=most)

    def _apart(self) -> bool:
        """Whether the tables' subjects are different by their prefixes."""
        prefixes = [t.prefix for t in self.graph.tables]
        return not any(a.startswith(b) for i, a in enumerate(prefixes) for k, b in enumerate(prefixes) if i != k)

    def _values(self, table: TableMap) -> dict[str, Term]:
        return {TYPE: Term("iri", F.lit(table.cls))} | {n: table.value(x) for n, x in table.props.items()}

    def _part(self, s=None, p=None, o=None, g=None, unique: tuple = ("s", "p", "o", "g"), where=None) -> DataFrame:
        """The quads that can match the constants, each once in the places `unique`."""
        chosen = []
        for table in self.graph.tables:
            if isinstance(s, Iri) and not s.value.startswith(table.prefix) or isinstance(g, Iri) and not (g.value.startswith(table.graph) if table.graph_column else g.value == table.graph):
                continue
            kept = {n: t for n, t in self._values(table).items() if (not isinstance(p, Iri) or n == p.value) and _may_be(t, o, n, table.cls)}
            if kept:
                chosen.append((table, kept))
        fixed = {n: canonical_text(x) for n, x in (("s", s), ("g", g)) if isinstance(x, (Iri, Literal, str))}
        apart = self._apart()
        if apart and "s" not in fixed:
            self._find_repeated([t for t, _ in chosen])
        parts = []
        for table, values in chosen:
            rows = self._subjects(table)
            for n, text in fixed.items():
                rows = rows.where(F.col(f"__{n}") == text)
            if where is not None:  # the default graphs: before quads that differ by graph alone become one
                rows = rows.withColumn("g", F.col("__g")).where(where).drop("g")
            twice = None if "s" in fixed or not apart else self._repeated[table.name]
            if not apart:
                parts.append(self._facts(rows, values))
            elif "s" in fixed:
                parts.append(self._facts(rows, values).dropDuplicates(list(unique)))
            elif twice is None:
                parts.append(self._facts(rows, values))
            else:
                marked = rows.withColumn("__h", F.xxhash64("__s"))
                parts.append(self._facts(marked.join(twice, "__h", "left_anti"), values))
                parts.append(self._facts(marked.join(twice, "__h", "left_semi"), values).dropDuplicates(list(unique)))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string, g string, o_num double")
        whole = reduce(DataFrame.unionByName, parts)
        return whole if apart else whole.dropDuplicates(list(unique))

    def _subjects(self, table: TableMap) -> DataFrame:
        return table.df.withColumns({"__s": canonical(table.subject()), "__g": canonical(table.graph_term())})

    def _facts(self, rows: DataFrame, values: dict[str, Term], *more: str) -> DataFrame:
        """A quad for each value that a row has, with those columns of the row; places that nothing reads are not made."""
        if len(values) > 1:
            rows = rows.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in range(len(values))])))

        def of(make):
            made = [make(n, t) for n, t in values.items()]
            out = made[-1] if len(made) == 1 else F.when(F.col("__k") == 0, made[0])
            for k, x in enumerate(made[1:], 1):
                out = out.when(F.col("__k") == k, x)
            return out

        number = of(lambda n, t: t.col.cast("double") if t.kind == "num" else F.lit(None).cast("double"))
        facts = rows.where(of(lambda n, t: t.col.isNotNull()))
        return facts.select(F.col("__s").alias("s"), of(lambda n, t: F.lit(f"<{n}>")).alias("p"), of(lambda n, t: canonical(t)).alias("o"), F.col("__g").alias("g"), number.alias("o_num"), *more)

    def _find_repeated(self, tables: list[TableMap]) -> None:
        """Hashes of the subjects that several rows of a table have (None: there are none); two subjects of one hash count as one."""
        new = [t for t in tables if t.name not in self._repeated]
        if not new:
            return
        hashed = reduce(DataFrame.union, [self._subjects(t).select(F.lit(k).alias("t"), F.xxhash64("__s").alias("__h")) for k, t in enumerate(new)])
        twice = persisted(hashed.groupBy("t", "__h").count().where("count > 1").select("t", "__h"))
        some = {r.t for r in twice.select("t").distinct().collect()}
        self._repeated |= {t.name: twice.where(F.col("t") == k).select("__h") if k in some else None for k, t in enumerate(new)}
