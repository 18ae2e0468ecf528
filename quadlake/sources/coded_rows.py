"""The quads of mapped tables as rows of ids, with a dictionary of their terms.

A row is encoded once, not once for each of its quads: a column of ids stands for a predicate.
Numbers, times and IRIs of whole-number keys are ids by themselves (type and value, the type is
the column's); all other terms are in a dictionary. Subjects that no other row has are numbered where
they are read, and their part of the dictionary lies in the same buckets as the rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import Term, canonical
from ..storage import persisted, shared_folder
from .mapped_store import MappedStore
from .mapping import TYPE, TableMap

#: Terms of a column that are sent to all executors: at most so many, of so many bytes.
FEW, FEW_BYTES = 20_000, 2_000_000
#: Rows to a bucket, and buckets of a table.
BUCKET_ROWS, BUCKETS = 1_000_000, 64
#: The buffers that snappy takes for many files or long texts lie outside the heap.
CODEC = "zstd"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Text columns to a bit mask.
_MASK = 62


def _hashed(term: Column) -> Column:
    return F.xxhash64(term)


def _bucketed(df: DataFrame, column: str, rows: int) -> DataFrame:
    """df as a table in buckets of that column: joins of two such tables on it move no rows."""
    name = f"table_{uuid.uuid4().hex}"
    n = max(1, min(BUCKETS, math.ceil(rows / BUCKET_ROWS)))
    df.write.option("path", f"{shared_folder(df.sparkSession)}/{name}").option("compression", CODEC).bucketBy(n, column).saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass
class Coded:
    """Rows of ids of a table: s, g and a column for each predicate; names: the dictionary of subjects that were numbered here."""

    table: TableMap
    rows: DataFrame
    shared: bool
    names: DataFrame | None = None


class CodedRows:
    """texts: id, term, and by bits the columns that hold it."""

    def __init__(self, store: MappedStore):
        self.store, self.spark, self.tables = store, store.spark, store.graph.tables
        store._find_repeated(self.tables)
        self.own = [t.name for t in self.tables if not self._whole(t) and not self._elsewhere("<" + t.prefix)]
        self.columns = [(t.name, c) for t in self.tables for c in self._written(t)]
        self._read_texts()
        self.coded: list[Coded] = []
        for table in self.tables:
            self._encode(table)

    @classmethod
    def fits(cls, store: MappedStore) -> bool:
        """Whether a term has one id: subjects of tables differ, and no text is an IRI that a key makes."""
        made = object.__new__(cls)
        made.store, made.tables, made.own = store, store.graph.tables, []
        keys = {t.prefix for t in made.tables if made._whole(t)} | {v.prefix for t in made.tables for v in store._values(t).values() if v.kind == "key" and made._inline(t, v)}
        texts = [t.prefix for t in made.tables if not made._whole(t)]
        return store._apart() and not any(p.startswith(t) or t.startswith(p) for p in keys for t in texts) and not any(made._elsewhere("<" + p) for p in sorted(keys))

    # what stands where
    def _whole(self, table: TableMap) -> bool:
        return len(table.keys) == 1 and isinstance(table.df.schema[table.keys[0]].dataType, _WHOLE)

    def _inline(self, table: TableMap, t: Term) -> bool:
        return t.kind in ("num", "bool", "time") or t.kind == "key" and isinstance(table.df.select(t.col.alias("v")).schema["v"].dataType, _WHOLE)

    def _values(self, table: TableMap) -> dict[str, Term]:
        """By column of ids: the terms of the table's predicates, but for its class."""
        return {f"c{k}": t for k, (n, t) in enumerate((n, t) for n, t in self.store._values(table).items() if n != TYPE)}

    def _written(self, table: TableMap) -> dict[str, Column]:
        """Columns of ids whose terms are in texts."""
        out = {} if self._whole(table) or table.name in self.own and self.store._repeated[table.name] is None else {"s": F.col("__s")}
        out |= {"g": F.col("__g")} if table.graph_column else {}
        return out | {c: canonical(t) for c, t in self._values(table).items() if not self._inline(table, t)}

    def _elsewhere(self, start: str) -> bool:
        """Whether a column of IRIs that are texts has one that begins so, or a graph or class does."""
        if any(iri.startswith(start) for t in self.tables for iri in (f"<{t.cls}>", f"<{t.graph}>", *[f"<{n}>" for n in self.store._values(t)])):
            return True
        for table in self.tables:
            terms = [t for t in self._values(table).values() if t.kind in ("iri", "key") and not self._inline(table, t)] + [table.graph_term()] * bool(table.graph_column)
            near = [t for t in terms if start.startswith("<" + t.prefix) or t.prefix.startswith(start[1:])]
            if near and not table.df.where(reduce(Column.__or__, [canonical(t).startswith(start) for t in near])).isEmpty():
                return True
        return False

    def _split(self, table: TableMap) -> list[tuple[DataFrame, bool]]:
        """The rows whose subject no other row has, and the others."""
        rows, twice = self.store._subjects(table).where("__s IS NOT NULL AND __g IS NOT NULL"), self.store._repeated[table.name]
        if twice is None:
            return [(rows, False)]
        marked = rows.withColumn("__h", F.xxhash64("__s"))
        return [(marked.join(twice, "__h", how).drop("__h"), shared) for how, shared in (("left_anti", False), ("left_semi", True))]

    # the dictionary
    def _read_texts(self) -> None:
        masks, found = math.ceil(len(self.columns) / _MASK) or 1, []
        for table in self.tables:
            for c, term in self._written(table).items():
                k = self.columns.index((table.name, c))
                rows = self._split(table)[1][0] if c == "s" and table.name in self.own else self.store._subjects(table)
                bits = [F.lit(1 << k % _MASK if k // _MASK == j else 0).cast("long").alias(f"m{j}") for j in range(masks)]
                found.append(rows.select(term.alias("term"), *bits))
        fixed = sorted({x for t in self.tables for x in (f"<{t.cls}>", *[f"<{t.graph}>"] * (not t.graph_column), *[f"<{n}>" for n in self.store._values(t)])})
        found.append(self.spark.createDataFrame([(x, *[0] * masks) for x in fixed], "term string, " + ", ".join(f"m{j} long" for j in range(masks))))
        each = reduce(DataFrame.union, found).where("term IS NOT NULL").groupBy("term").agg(*[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(masks)])
        self.texts = persisted(each.select(F.monotonically_increasing_id().alias("id"), _hashed(F.col("term")).alias("h"), "*"), CODEC)
        here = [self._holds(k) for k in range(len(self.columns))]
        sizes = self.texts.agg(F.max("id"), *[x for y in here for x in (F.count_if(y), F.sum(F.when(y, F.octet_length("term"))))]).first()
        self.few = [sizes[1 + 2 * k] <= FEW and (sizes[2 + 2 * k] or 0) <= FEW_BYTES for k in range(len(here))]
        self.next = sizes[0] + 1
        #: Texts are told apart by their hashes unless two have the same.
        self.by = ["h"] if self.texts.groupBy("h").count().where("count > 1").isEmpty() else ["h", "term"]

    def _holds(self, k: int) -> Column:
        return F.col(f"m{k // _MASK}").bitwiseAND(F.lit(1 << k % _MASK)) != 0

    def _of(self, table: TableMap, c: str, *columns: Column) -> DataFrame:
        """Dictionary rows of the terms of that column."""
        k = self.columns.index((table.name, c))
        part = self.texts.where(self._holds(k)).select(*columns)
        return F.broadcast(part) if self.few[k] else part

    def dictionary(self) -> DataFrame:
        """id, term: of all terms that are not ids by themselves."""
        return reduce(DataFrame.union, [self.texts.select("id", "term"), *[x.names for x in self.coded if x.names is not None]])

    # rows of ids
    def _encode(self, table: TableMap) -> None:
        values, written = self._values(table), self._written(table)
        for rows, shared in self._split(table):
            own = table.name in self.own and not shared
            ids = {"s": F.col(table.keys[0])} if self._whole(table) else {"s": F.monotonically_increasing_id() + self.next} if own else {}
            for c, t in values.items():
                if c not in written:
                    ids[c] = F.date_trunc("second", t.col).cast("timestamp_ntz") if t.kind == "time" else t.col
            coded = [c for c in written if c not in ids]
            texts = {c: {"h": _hashed(written[c]), "term": written[c]} for c in coded}
            # Parts of the key that are ids of a predicate are not kept twice.
            held = {x.column: c for c, x in zip(values, table.props.values(), strict=True) if c in ids and values[c].kind in ("num", "key")}
            keys = {f"k{j}": F.col(k) for j, k in enumerate(table.keys) if k not in held} if own else {}
            rows = rows.select(*[x.alias(c) for c, x in (ids | keys).items() if c != "s" or not own], *[texts[c][b].alias(f"{b}_{c}") for c in coded for b in self.by])
            for c in coded:
                part = self._of(table, c, F.col("id").alias(c), *[F.col(b).alias(f"{b}_{c}") for b in self.by])
                rows = rows.join(part, [f"{b}_{c}" for b in self.by], "left").drop(*[f"{b}_{c}" for b in self.by])
            if not own:
                self.coded.append(Coded(table, persisted(rows, CODEC), shared))
                continue
            n = table.df.count()
            rows = _bucketed(rows.withColumn("s", ids["s"]), "s", n)
            subject = rows.select("s", *[F.col(held.get(k, f"k{j}")).alias(k) for j, k in enumerate(table.keys)])
            names = _bucketed(subject.select(F.col("s").alias("id"), canonical(table.subject()).alias("term")), "id", n)
            self.coded.append(Coded(table, rows.drop(*keys), shared, names))
            self.next = 1 + (rows.agg(F.max("s")).first()[0] or self.next)

    def quads(self) -> DataFrame:
        """s, p, o, g, read back from the ids; one that the dictionary lacks raises."""
        return reduce(DataFrame.union, [self._decode(x) for x in self.coded])

    def _decode(self, x: Coded) -> DataFrame:
        table, rows, terms = x.table, x.rows, self._values(x.table)

        def named(rows: DataFrame, c: str, part: DataFrame) -> DataFrame:
            lacks = F.raise_error(F.concat(F.lit("no term has id "), F.col(c).cast("string"))).cast("string")
            joined = rows.join(part, F.col(c) == F.col("__id"), "left")
            return joined.withColumn(f"t_{c}", F.when(F.col(c).isNotNull(), F.coalesce("__term", lacks))).drop("__id", "__term", c)

        if x.names is not None:
            rows = named(rows, "s", x.names.select(F.col("id").alias("__id"), F.col("term").alias("__term")))
        for c in self._written(table):
            if c != "s" or x.names is None:
                rows = named(rows, c, self._of(table, c, F.col("id").alias("__id"), F.col("term").alias("__term")))
                terms |= {c: Term("term", F.col(f"t_{c}"))} if c in terms else {}
        terms = {c: t if t.kind == "term" else replace(t, col=F.col(c).cast("timestamp") if t.kind == "time" else F.col(c)) for c, t in terms.items()}
        subject = canonical(Term("key", F.col("s"), table.prefix)) if self._whole(table) else F.col("t_s")
        rows = rows.withColumns({"__s": subject, "__g": F.col("t_g") if table.graph_column else canonical(table.graph_term())})
        names = [n for n in self.store._values(table) if n != TYPE]
        facts = self.store._facts(rows, {TYPE: Term("iri", F.lit(table.cls))} | dict(zip(names, terms.values(), strict=True))).select("s", "p", "o", "g")
        return facts.dropDuplicates() if x.shared else facts
