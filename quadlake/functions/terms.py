"""RDF terms as columns: the canonical N-Triples text of a term, and its parts.

A solution column is described by a `Term`: native columns keep their Spark type as long as
a variable's kind is known from the mapping; only mixed or stored terms are canonical text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import XSD

#: The XSD types with numeric values, with the inclusive bounds of the bounded ones.
NUMERIC = {
    "double": None, "float": None, "decimal": None, "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255), "positiveInteger": (1, None),
}
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


@dataclass(frozen=True)
class Term:
    """kind: iri, key (IRI = prefix + key), num, str, lang, bool, time or term (canonical text, null if unbound).

    For term, num holds the numeric value when the store has it as a column; for lang, lang is the tag.
    """

    kind: str
    col: Column
    prefix: str = ""
    lang: Column | None = None
    num: Column | None = None
    type: str = ""

    def on(self, col: Column) -> Term:
        return replace(self, col=col)


def quoted(col: Column) -> Column:
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), out, F.lit('"'))


def unquoted(col: Column) -> Column:
    """The lexical form of a canonical literal's quoted part."""
    out = F.replace(col, F.lit("\\\\"), F.lit("\0"))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        out = F.replace(out, F.lit(mark), F.lit(raw))
    return F.replace(out, F.lit("\0"), F.lit("\\"))


def iso(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def xsd_of(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return XSD + ("integer" if spark_type.endswith(",0)") else "decimal")
    return XSD + {"double": "double", "float": "double", "int": "int", "bigint": "integer", "smallint": "short", "tinyint": "byte"}.get(spark_type, "double")


def canonical(t: Term) -> Column:
    """The N-Triples text of a term."""
    if t.kind == "term":
        return t.col
    if t.kind in ("iri", "key"):
        return F.concat(F.lit("<" + t.prefix), t.col.cast("string"), F.lit(">"))
    if t.kind == "lang":
        return F.concat(quoted(t.col), F.lit("@"), t.lang)
    if t.kind == "num":
        return F.concat(F.lit('"'), t.col.cast("string"), F.lit(f'"^^<{t.type or XSD + "double"}>'))
    if t.kind == "bool":
        return F.concat(F.lit('"'), t.col.cast("string"), F.lit(f'"^^<{XSD}boolean>'))
    if t.kind == "time":
        return F.concat(F.lit('"'), iso(t.col), F.lit(f'"^^<{XSD}dateTime>'))
    return quoted(t.col)


def is_iri(text: Column) -> Column:
    return text.startswith("<")


def is_blank(text: Column) -> Column:
    return text.startswith("_:")


def is_literal(text: Column) -> Column:
    return text.startswith('"')


def lexical(text: Column) -> Column:
    """The lexical form of a canonical literal, the IRI of a canonical IRI, null for blank nodes."""
    body = F.regexp_extract(text, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    return F.when(is_iri(text), F.substring(text, 2, F.length(text) - 2)).when(is_literal(text), unquoted(body))


def language(text: Column) -> Column:
    return F.when(is_literal(text), F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(text: Column) -> Column:
    dt = F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(text), F.when(language(text) != "", F.lit(LANG_STRING)).when(dt == "", F.lit(XSD + "string")).otherwise(dt))


def numeric(text: Column) -> Column:
    """The value of a canonical numeric literal as double; null if ill-typed, out of its type's range, or not numeric."""
    dt, lex = datatype(text), lexical(text)
    whole = lex.try_cast("decimal(38,0)")
    out = F.when(dt.isin(XSD + "double", XSD + "float", XSD + "decimal"), lex.try_cast("double"))
    for name, bounds in NUMERIC.items():
        if bounds is None:
            continue
        ok = lex.rlike(r"^\s*[+-]?[0-9]+\s*$")
        low, high = bounds
        if low is not None:
            ok = ok & (whole >= F.lit(low).cast("decimal(38,0)") if abs(low) < 2**63 else whole >= F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            ok = ok & (whole <= F.lit(str(high)).cast("decimal(38,0)"))
        out = out.when((dt == XSD + name) & ok, whole.cast("double"))
    return out
