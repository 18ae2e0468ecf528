"""Solutions in the formats of SPARQL endpoints, as rows of text lines, and as files.

Lines are made by column functions. A table of lines is the head, a line for each solution and
the tail, in partitions of that order: its files, joined by name, are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..api import compiler_for
from ..functions.terms import canonical, datatype, is_blank, is_iri, language, lexical
from ..plans.algebra import XSD
from ..plans.parser import parse
from ..storage import persisted

#: Names of the formats, and their namespaces.
FORMATS = ("json", "xml", "csv", "tsv", "text")
NAMESPACE = "http://www.w3.org/2005/sparql-results#"


def _json(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'^\{"x":|\}$', "")


def _xml(x: Column) -> Column:
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(raw), F.lit(mark))
    return x


def _csv(x: Column) -> Column:
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def _plain(t: Column) -> Column:
    """A term's text without its marks; blank nodes keep their label."""
    return F.when(is_blank(t), t).otherwise(lexical(t))


def _binding(name: str, t: Column, format_: str) -> Column:
    """A bound variable in JSON or XML; null if it is unbound."""
    own, text = F.when(is_blank(t), F.substring(t, 3, 1 << 30)).otherwise(lexical(t)), language(t)
    typed = F.when(~datatype(t).isin(XSD + "string") & (text == ""), datatype(t))
    if format_ == "json":
        kind = F.when(is_iri(t), "uri").when(is_blank(t), "bnode").otherwise("literal")
        more = F.concat(F.when(text != "", F.concat(F.lit(',"xml:lang":'), _json(text))).otherwise(""), F.when(typed.isNotNull(), F.concat(F.lit(',"datatype":'), _json(typed))).otherwise(""))
        return F.concat(_json(F.lit(name)), F.lit(':{"type":"'), kind, F.lit('","value":'), _json(own), more, F.lit("}"))
    tag = F.when(is_iri(t), "uri").when(is_blank(t), "bnode").otherwise("literal")
    more = F.concat(F.when(text != "", F.concat(F.lit(' xml:lang="'), text, F.lit('"'))).otherwise(""), F.when(typed.isNotNull(), F.concat(F.lit(' datatype="'), _xml(typed), F.lit('"'))).otherwise(""))
    return F.concat(F.lit(f'<binding name="{name}"><'), tag, more, F.lit(">"), _xml(own), F.lit("</"), tag, F.lit("></binding>"))


def formatted(source, text: str, format_: str = "json") -> DataFrame:
    """The lines (column value) of a SELECT query's result as json, xml, csv, tsv or text.

    JSON and XML leave unbound variables out; CSV and TSV have an empty field. The order of an
    ordered query is kept.
    """
    if format_ not in FORMATS:
        raise ValueError(f"no format {format_!r}; there are {', '.join(FORMATS)}")
    q = parse(text)
    if q.form != "select":
        raise ValueError("only solutions of SELECT have these formats")
    out = compiler_for(source, q).compile(q.pattern)
    names, spark = list(out.specs), out.df.sparkSession
    terms = {n: canonical(out.term(n)) for n in names}
    if format_ in ("json", "xml"):
        each = [F.when(t.isNotNull(), _binding(n, t, format_)) for n, t in terms.items()]
        line = F.concat_ws("," if format_ == "json" else "", *each)
        line = F.concat(F.lit("{"), line, F.lit("}")) if format_ == "json" else F.concat(F.lit("<result>"), line, F.lit("</result>"))
    elif format_ == "csv":
        line = F.concat_ws(",", *[F.coalesce(_csv(_plain(t)), F.lit("")) for t in terms.values()])
    else:
        line = F.concat_ws("\t", *[F.coalesce(t if format_ == "tsv" else _plain(t), F.lit("")) for t in terms.values()])
    lines = out.df.select(line.alias("value"))

    def fixed(*rows: str) -> DataFrame:
        return spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1)

    if format_ == "json":
        # all lines but the first begin with a comma
        rows = persisted(lines.select("value", F.monotonically_increasing_id().alias("id")))
        first = rows.agg(F.min("id")).first()[0]
        lines = rows.select(F.when(F.col("id") == first, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
        head = '{"head":{"vars":[' + ",".join(f'"{n}"' for n in names) + ']},"results":{"bindings":['
        return fixed(head).union(lines).union(fixed("]}}"))
    if format_ == "xml":
        head = [f'<?xml version="1.0"?><sparql xmlns="{NAMESPACE}"><head>' + "".join(f'<variable name="{n}"/>' for n in names) + "</head><results>"]
        return fixed(*head).union(lines).union(fixed("</results></sparql>"))
    mark = "?" if format_ == "tsv" else ""
    return fixed(("," if format_ == "csv" else "\t").join(mark + n for n in names)).union(lines)


def write_results(source, text: str, path: str, format_: str = "json") -> None:
    """A folder of files that, joined by name, are the result in that format."""
    formatted(source, text, format_).write.text(path)
