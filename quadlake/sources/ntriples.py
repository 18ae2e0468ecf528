"""N-Triples and N-Quads text: lines to statements with built-in column functions, and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import numeric
from ..plans.algebra import Iri, Literal
from ..plans.parser import unescape

#: Fixed value: the graph of statements without one, in data that is exchanged.
DEFAULT_GRAPH = "http://DEFAULT_CONTEXT"
_IRI, _BLANK = r"<[^<>\"{}|^`\\\s]*>", r"_:[A-Za-z0-9_][\w.-]*"
#: Possessive, so that a long literal is matched in a loop and not on the stack.
_LITERAL = r'"(?:[^"\\\n\r]++|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?'
LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"
_TERM = re.compile(rf"\s*(\?|{_IRI}|{_BLANK}|{_LITERAL})")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    r"""Statements s, p, o, g of text lines, and _corrupt with what is not a statement.

    Blank lines and comments give no row. A missing graph is the default graph's IRI. Blank
    node labels are kept, so one label means one node over all files. \u escapes become letters.
    """
    text = F.col(column)
    rows = lines.where(~F.trim(text).rlike(r"^(#.*)?$"))
    # One match a line: the terms between line ends. What matches has a full stop behind them, so it never equals its terms.
    rows = rows.select(text.alias("text"), F.regexp_replace(text, LINE, "$1\n$2\n$3\n$4").alias("terms"))
    good = F.col("terms") != F.col("text")
    rows = rows.select(F.when(good, F.split("terms", "\n")).alias("t"), F.when(~good, F.col("text")).alias("_corrupt"))
    s, p, o, g = (F.col("t")[k] for k in range(4))
    return rows.select(_decoded(s).alias("s"), p.alias("p"), _decoded(o).alias("o"), F.when(g == "", f"<{DEFAULT_GRAPH}>").otherwise(g).alias("g"), "_corrupt")


def is_plain(df: DataFrame):
    r"""Whether the line of a quad reads back as just that quad: its terms are well-formed and have no \u escape."""
    node = rf"\A(?:{_IRI}|{_BLANK})\z"
    fits = F.col("s").rlike(node) & F.col("p").rlike(rf"\A{_IRI}\z") & F.col("o").rlike(rf"\A(?:{_IRI}|{_BLANK}|{_LITERAL})\z") & F.col("g").rlike(node)
    escaped = [F.col(c).contains(x) for c in "so" for x in ("\\u", "\\U")]
    return F.coalesce(fits & ~(escaped[0] | escaped[1] | escaped[2] | escaped[3]), F.lit(False))


def _decoded(col):
    r"""Replaces \uXXXX escapes; most terms have none and pass unchanged."""
    pieces = F.split(col, r"(?=\\[uU][0-9A-Fa-f]{4})")
    four = F.transform(pieces, lambda x: F.when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.concat(_letter(F.substring(x, 3, 4)), F.substring(x, 7, 1 << 30))).when(x.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.concat(_letter(F.substring(x, 3, 8)), F.substring(x, 11, 1 << 30))).otherwise(x))
    return F.when((col.contains("\\u") | col.contains("\\U")) & col.rlike(r"\\[uU][0-9A-Fa-f]{4}"), F.array_join(four, "")).otherwise(col)


def _letter(digits):
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads files of a folder, a file or a pattern."""
    return parse_lines(spark.read.text(path))


def write_statements(df: DataFrame, path: str, quads: bool = True) -> None:
    """Statements as text lines."""
    df.select(F.concat_ws(" ", "s", "p", "o", *(["g"] if quads else []), F.lit(".")).alias("value")).write.text(path)


def parse_term(text: str):
    """A term of N-Triples syntax; None for ?."""
    text = text.strip()
    if text == "?":
        return None
    if text.startswith("<"):
        return Iri(unescape(text[1:-1]))
    if text.startswith("_:"):
        return text
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?', text, re.S)
    if not m:
        raise ValueError(f"not a term: {text!r}")
    return Literal(unescape(m[1]), m[3], m[2])


def parse_pattern(line: str) -> list[str | None]:
    """A pattern line of three or four terms with ? as wildcard: canonical texts, None for ?."""
    found, at = [], 0
    while m := _TERM.match(line, at):
        found.append(None if m[1] == "?" else m[1])
        at = m.end()
    if len(found) not in (3, 4):
        raise ValueError(f"a pattern has three or four terms: {line!r}")
    return found + [None] * (4 - len(found))


def with_values(df: DataFrame) -> DataFrame:
    """Adds o_num, the numeric value of the object."""
    return df.withColumn("o_num", F.when(F.col("o").contains("^^"), numeric(F.col("o"))))
