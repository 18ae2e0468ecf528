"""A quad store: a set of statements as Parquet, partitioned by predicate and sorted.

Terms are canonical N-Triples texts; numeric objects also have their value in o_num, so
range patterns are pruned by Parquet statistics. A dictionary gives ids to terms and back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import Term, datatype, is_blank, is_iri, language, lexical
from ..plans.algebra import Iri, Literal, Var
from ..plans.relation import Relation, build
from ..storage import persisted
from .ntriples import is_plain, parse_lines, read_statements, with_values


def canonical_text(x) -> str:
    """N-Triples text of a constant."""
    if isinstance(x, Iri):
        return f"<{x.value}>"
    if isinstance(x, str):
        return x
    body = x.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{body}"' + (f"@{x.lang}" if x.lang else f"^^<{x.dt}>" if x.dt and not x.dt.endswith("#string") else "")


#: Sort orders of the quads; each combination of bound places has one that begins with some of them.
ORDERS = ("spog", "posg", "ospg", "gspo")


def access_path(bound: set[str], orders: tuple[str, ...] = ORDERS) -> str:
    """The order with the longest beginning of bound places; the first of equal ones."""

    def prefix(order: str) -> int:
        return next((i for i, c in enumerate(order) if c not in bound), len(order))

    return max(orders, key=prefix)


def arranged(quads: DataFrame, order: str) -> DataFrame:
    """The quads in ranges of that order, so that the statistics of a Parquet table prune by its beginning."""
    return quads.repartitionByRange(*order).sortWithinPartitions(*order)


def sorted_layout(quads: DataFrame, order: str) -> DataFrame:
    """The arranged quads as a stored table."""
    return persisted(arranged(quads, order))


#: Bytes of text in the entries of one value and part, and in those that one task collects.
ENTRY_BYTES, TASK_BYTES = 6_000_000, 24_000_000


def in_parts(rows: DataFrame, bound: tuple[str, ...], most: int) -> DataFrame:
    """Distinct triples by the values of the bound places and by part; as many tasks as the entries' bytes need."""
    rest = [c for c in "spo" if c not in bound]
    length = reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) + 32 for c in rest])
    sizes = persisted(rows.groupBy(*bound).agg(F.count("*").alias("n"), F.sum(length).alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = sizes.select(*bound, F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / ENTRY_BYTES)).alias("parts"))
    same = reduce(Column.__and__, [rows[c].eqNullSafe(parts[c]) for c in bound])
    dealt = rows.join(parts, same).select(*[rows[c] for c in "spo"], F.pmod(F.xxhash64(*[rows[c] for c in rest]), parts["parts"]).alias("part"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    return dealt.repartition(tasks, *bound, "part").groupBy(*bound, "part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("entries"))


@dataclass
class QuadStore:
    """quads: s, p, o, g, o_num; layouts: the same in several sort orders."""

    spark: SparkSession
    quads: DataFrame
    layouts: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, statements: DataFrame) -> QuadStore:
        """From statements s, p, o, g: well-formed rows, each quad once."""
        rows = statements.where("_corrupt IS NULL") if "_corrupt" in statements.columns else statements
        return cls(rows.sparkSession, with_values(rows.select("s", "p", "o", "g").dropDuplicates()))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls.of(read_statements(spark, path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls(spark, spark.read.parquet(path))

    def save(self, path: str, by_predicate: bool = True) -> None:
        """Parquet sorted by subject and object within the files of a predicate; hot predicates get many files."""
        spread = self.quads.repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s", "o")
        writer = spread.write.mode("overwrite")
        (writer.partitionBy("p") if by_predicate else writer).parquet(path)

    def laid_out(self, orders: tuple[str, ...] = ORDERS) -> QuadStore:
        """The store with its quads stored in those orders; patterns read the one that suits their bound places."""
        layouts = {x: sorted_layout(self.quads, x) for x in orders}
        return QuadStore(self.spark, layouts[orders[0]], layouts)

    def _part(self, **places) -> DataFrame:
        """Quads among which are all that have those constants in those places (others: None or a variable)."""
        bound = {n for n, x in places.items() if x is not None and not isinstance(x, Var)}
        return self.layouts[access_path(bound, tuple(self.layouts))] if self.layouts else self.quads

    def triples(self) -> DataFrame:
        """s, p, o over all graphs, each once."""
        return self.quads.select("s", "p", "o").distinct()

    def add(self, statements: DataFrame) -> QuadStore:
        """The store with more statements; quads that it has already stay single."""
        new = QuadStore.of(statements).quads
        return QuadStore(self.spark, self.quads.unionByName(new.join(self.quads.select("s", "p", "o", "g"), ["s", "p", "o", "g"], "left_anti")))

    def append(self, statements: DataFrame, path: str) -> None:
        """Writes statements that the table at path does not have yet."""
        have = self.spark.read.parquet(path).select("s", "p", "o", "g")
        QuadStore.of(statements).quads.join(have, ["s", "p", "o", "g"], "left_anti").write.mode("append").partitionBy("p").parquet(path)

    # patterns
    def match(self, s=None, p=None, o=None, g=None, low: float | None = None, high: float | None = None) -> DataFrame:
        """Quads that fit the pattern (None: any); low and high bound the object's value, inclusively."""
        df = self._part(s=s, p=p, o=o, g=g)
        for name, x in zip("spog", (s, p, o, g), strict=True):
            if x is not None:
                df = df.where(F.col(name) == canonical_text(x))
        if low is not None:
            df = df.where(F.col("o_num") >= low)
        if high is not None:
            df = df.where(F.col("o_num") <= high)
        return df.select("s", "p", "o", "g")

    def count(self, s=None, p=None, o=None, g=None, limit: int | None = None) -> int:
        found = self.match(s, p, o, g)
        return (found if limit is None else found.limit(limit)).count()

    def warm(self) -> dict[str, int]:
        """Reads every layout once: rows by order ('' for the plain quads)."""
        return {name: df.count() for name, df in (self.layouts or {"": self.quads}).items()}

    def has(self, s, p, o, g=None) -> bool:
        return not self.match(s, p, o, g).limit(1).isEmpty()

    def subject(self, iri: str) -> DataFrame:
        """Predicates and objects of a subject."""
        return self.match(Iri(iri)).select("p", "o")

    def export(self, iri: str, path: str) -> None:
        """A subject's statements as N-Triples lines."""
        self.match(Iri(iri)).select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(path)

    def reread(self) -> DataFrame:
        """The quads as N-Quads lines, read back to a set of quads.

        Quads whose lines read back as themselves stay as different as they are; only the others
        go through a distinct, and lose what is among the former.
        """
        places = ["s", "p", "o", "g"]

        def back(df: DataFrame) -> DataFrame:
            return parse_lines(df.select(F.concat_ws(" ", *places, F.lit(".")).alias("value"))).where("_corrupt IS NULL").select(*places)

        quads = self.quads.select(*places)
        plain = is_plain(quads)
        others = persisted(back(quads.where(~plain)).distinct())
        same = back(quads.where(plain))
        return same if others.isEmpty() else same.unionByName(others.join(same, places, "left_anti"))

    # ids
    def terms(self) -> DataFrame:
        return self.quads.select(F.explode(F.array("s", "p", "o", "g")).alias("term")).distinct()

    def dictionary(self, known: DataFrame | None = None) -> DataFrame:
        """id, term, kind, lex, dt, lang of every term; with `known`, its ids stay and new terms follow its largest.

        Ids are stored before use: monotonically_increasing_id gives others when it runs again.
        """
        terms, first = self.terms(), 0
        if known is not None:
            terms = terms.join(known.select("term"), "term", "left_anti")
            largest = known.agg(F.max("id")).first()[0]
            first = 0 if largest is None else largest + 1
        new = persisted(self.numbered(terms, first))
        return new if known is None else known.unionByName(new)

    def numbered(self, terms: DataFrame | None = None, first: int = 0) -> DataFrame:
        """Dictionary rows of some terms (None: all of them), to be stored before use."""
        t = F.col("term")
        kind = F.when(is_iri(t), 0).when(is_blank(t), 1).otherwise(2).cast("tinyint")
        terms = self.terms() if terms is None else terms
        return terms.select((F.monotonically_increasing_id() + first).alias("id"), "term", kind.alias("kind"), lexical(t).alias("lex"), datatype(t).alias("dt"), language(t).alias("lang"))

    def encoded(self, dictionary: DataFrame) -> DataFrame:
        """Quads of ids s, p, o, g with o_num."""
        df = self.quads
        for name in "spog":
            ids = dictionary.select(F.col("term").alias(name), F.col("id").alias(f"{name}_id"))
            df = df.join(ids, name)
        return df.select(*[F.col(f"{n}_id").alias(n) for n in "spog"], "o_num")

    @staticmethod
    def decoded(encoded: DataFrame, dictionary: DataFrame, names: tuple = ("s", "p", "o", "g")) -> DataFrame:
        """Terms in place of ids; a missing id raises when it is read."""
        for name in names:
            terms = dictionary.select(F.col("id").alias("__id"), F.col("term").alias("__term"))
            term = F.coalesce("__term", F.raise_error(F.concat(F.lit("no term has id "), F.col(name).cast("string"))).cast("string"))
            encoded = encoded.join(terms, encoded[name] == F.col("__id"), "left").withColumn(name, term).drop("__id", "__term")
        return encoded

    @staticmethod
    def lookup(dictionary: DataFrame, terms: list) -> DataFrame:
        """Ids of some constants (term, id); id is null where the dictionary lacks the term."""
        spark = dictionary.sparkSession
        asked = spark.createDataFrame([(canonical_text(t),) for t in terms], "term string")
        return asked.join(dictionary.select("term", "id"), "term", "left")

    # other layouts
    def hexastore(self, *bound: str) -> DataFrame:
        """For each value of the bound positions (of s, p, o) all tuples of the others, sorted."""
        rest = [c for c in "spo" if c not in bound]
        return self.quads.groupBy(*bound).agg(F.sort_array(F.collect_set(F.struct(*rest))).alias("entries"))

    def hexastore_parts(self, *bound: str, most: int = 100_000) -> DataFrame:
        """Like hexastore, with the tuples of a hot value dealt over parts of about `most`, or fewer long ones: a row for each value and part."""
        return in_parts(self.triples(), bound, most)

    def property_table(self, predicates: list[str] | None = None) -> DataFrame:
        """One row a subject: a map from predicate to its sorted values, or a column for each given predicate."""
        values = self.quads.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("o"))
        if predicates is None:
            return values.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "o"))).alias("properties"))
        return values.groupBy("s").pivot("p", predicates).agg(F.first("o"))

    def statistics(self) -> DataFrame:
        """Quads, distinct subjects and distinct objects by predicate, exactly."""
        return self.quads.groupBy("p").agg(F.count("*").alias("quads"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))

    # for the compiler
    def _rows(self, graph, default: list[str], places: dict) -> DataFrame:
        quads = self._part(**places, g=graph)
        if graph is not None:
            return quads.where(F.col("g") == canonical_text(graph)) if isinstance(graph, Iri) else quads
        df = quads.where(F.col("g").isin([f"<{d}>" for d in default])) if default else quads
        return df.select("s", "p", "o", "o_num").distinct()

    def triple(self, s, p, o, graph=None, default: list[str] = ()) -> list[Relation]:
        df, terms = self._rows(graph, default, {"s": s, "p": p, "o": o}), {}
        places = [("s", s), ("p", p), ("o", o)] + ([("g", graph)] if isinstance(graph, Var) else [])
        for name, x in places:
            t = Term("term", F.col(name), num=F.col("o_num") if name == "o" else None)
            if not isinstance(x, Var):
                number = None
                if name == "o" and isinstance(x, Literal):
                    from ..functions.expr import constant

                    number = constant(x)
                df = df.where(F.col("o_num") == number.col if number is not None and number.kind == "num" else F.col(name) == canonical_text(x))
            elif x.name in terms:
                df = df.where(terms[x.name].col == t.col)
            else:
                terms[x.name] = t
        return [build(df, terms)]

    def keyed(self, pairs: list) -> bool:
        return False

    def star(self, subject, pairs: list, graph=None, default: list[str] = ()) -> list[Relation]:
        [(p, o)] = pairs
        return self.triple(subject, p, o, graph, default)
