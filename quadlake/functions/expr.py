"""SPARQL expressions as columns. A type error is null, and so drops out of filters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import XSD, Call, Iri, Literal, Var
from .terms import LANG_STRING, NUMERIC, Term, canonical, datatype, is_blank, is_iri, is_literal, iso, language, lexical, numeric, quoted, xsd_of

#: Extension functions and casts by IRI: Callable from Terms to a Term.
REGISTRY: dict[str, Callable[..., Term]] = {}


class ExpressionError(ValueError):
    pass


def register_function(iri: str, function: Callable[..., Term]) -> None:
    REGISTRY[iri] = function


def text_of(t: Term) -> Column:
    """STR()."""
    if t.kind == "term":
        return lexical(t.col)
    if t.kind in ("iri", "key"):
        return F.concat(F.lit(t.prefix), t.col.cast("string")) if t.prefix else t.col.cast("string")
    return iso(t.col) if t.kind == "time" else t.col.cast("string")


def number_of(t: Term) -> Column:
    if t.kind == "num":
        return t.col
    if t.kind == "term":
        return t.num if t.num is not None else numeric(t.col)
    return F.lit(None).cast("double")


def truth_of(t: Term) -> Column:
    """Effective boolean value."""
    if t.kind == "bool":
        return t.col
    if t.kind == "num":
        return (t.col != 0) & ~F.isnan(t.col.cast("double"))
    if t.kind in ("str", "lang"):
        return t.col != ""
    if t.kind == "term":
        dt = datatype(t.col)
        return F.when(dt == XSD + "boolean", lexical(t.col).isin("true", "1")).when(dt == XSD + "string", lexical(t.col) != "").otherwise(numeric(t.col) != 0)
    return F.lit(None).cast("boolean")


def time_of(t: Term) -> Column:
    if t.kind == "time":
        return t.col
    if t.kind == "term":
        return F.when(datatype(t.col).isin(XSD + "dateTime", XSD + "date"), lexical(t.col).try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def string(col: Column, like: Term | None = None) -> Term:
    """A string result; keeps the language of the argument it is made from."""
    return Term("lang", col, lang=like.lang) if like is not None and like.kind == "lang" else Term("str", col)


def boolean(col: Column) -> Term:
    return Term("bool", col)


def number(col: Column, type_: str = XSD + "integer") -> Term:
    return Term("num", col, type=type_)


def constant(x) -> Term:
    if isinstance(x, Iri):
        return Term("iri", F.lit(x.value))
    if x.lang:
        return Term("lang", F.lit(x.lex), lang=F.lit(x.lang))
    name = (x.dt or "").removeprefix(XSD)
    try:
        if name in NUMERIC:
            whole = NUMERIC[name] is not None
            value = int(x.lex) if whole else float(x.lex)
            if not whole and name == "decimal":
                return Term("num", F.lit(x.lex).cast("double"), type=x.dt)
            if not whole or -(2**63) <= value < 2**63:
                return Term("num", F.lit(value).cast("bigint" if whole else "double"), type=x.dt)
    except ValueError:
        pass
    if name == "boolean":
        return boolean(F.lit(x.lex in ("true", "1")))
    if name in ("dateTime", "date"):
        return Term("time", F.lit(x.lex.rstrip("Z")).try_cast("timestamp"), type=x.dt)
    if not x.dt or name == "string":
        return Term("str", F.lit(x.lex))
    return Term("term", F.concat(quoted(F.lit(x.lex)), F.lit(f"^^<{x.dt}>")))


def same_term(a: Term, b: Term) -> Column:
    if a.kind == b.kind and a.kind in ("iri", "key", "str", "bool", "time"):
        return a.col == b.col if a.prefix == b.prefix else text_of(a) == text_of(b)
    if {a.kind, b.kind} <= {"iri", "key"}:
        return text_of(a) == text_of(b)
    return canonical(a) == canonical(b)


def equal(a: Term, b: Term) -> Column:
    """Value equality: numbers and times by value, language-tagged by text and tag, others as terms."""
    kinds = {a.kind, b.kind}
    if kinds == {"num"}:
        return a.col == b.col
    if kinds == {"time"}:
        return a.col == b.col
    if "term" in kinds:
        other = a if b.kind == "term" else b
        if other.kind == "time":
            return time_of(a) == time_of(b)
        if other.kind == "num":
            return number_of(a) == number_of(b)
        x, y = number_of(a), number_of(b)
        return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(canonical(a) == canonical(b)) if other.kind == "term" else canonical(a) == canonical(b)
    if a.kind == b.kind or kinds <= {"iri", "key"}:
        return (a.col == b.col) & (F.lower(a.lang) == F.lower(b.lang)) if a.kind == "lang" else same_term(a, b)
    if "num" in kinds or "time" in kinds or "bool" in kinds:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if kinds & {"iri", "key"} else F.lit(None).cast("boolean")
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def compare(op: str, a: Term, b: Term) -> Column:
    f = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    kinds = {a.kind, b.kind}
    if "num" in kinds:
        return f(number_of(a), number_of(b))
    if "time" in kinds:
        return f(time_of(a), time_of(b))
    if kinds == {"term"}:
        x, y, s, t = number_of(a), number_of(b), time_of(a), time_of(b)
        plain = (datatype(a.col) == XSD + "string") & (datatype(b.col) == XSD + "string")
        return F.when(x.isNotNull() & y.isNotNull(), f(x, y)).when(s.isNotNull() & t.isNotNull(), f(s, t)).when(plain, f(lexical(a.col), lexical(b.col)))
    if kinds == {"term", "str"}:
        term = a if a.kind == "term" else b
        return F.when(datatype(term.col) == XSD + "string", f(text_of(a), text_of(b)))
    if kinds in ({"str"}, {"bool"}, {"lang"}):
        return f(a.col, b.col)
    return F.lit(None).cast("boolean")


def _kind_test(name: str, t: Term) -> Column:
    if t.kind == "term":
        test = {"isiri": is_iri, "isuri": is_iri, "isblank": is_blank, "isliteral": is_literal, "isresource": lambda x: ~is_literal(x)}
        return test[name](t.col) if name in test else F.when(t.col.isNotNull(), number_of(t).isNotNull())
    iri = t.kind in ("iri", "key")
    value = {"isiri": iri, "isuri": iri, "isblank": False, "isliteral": not iri, "isresource": iri, "isnumeric": t.kind == "num"}[name]
    return F.when(t.col.isNotNull(), F.lit(value))


def _arith(op: str, a: Term, b: Term) -> Term:
    x, y = number_of(a), number_of(b)
    whole = a.kind == b.kind == "num" and all(t.type.removeprefix(XSD) not in ("double", "float", "decimal") and t.type for t in (a, b))
    if op == "/":
        return number(F.try_divide(x.cast("double"), y.cast("double")), XSD + ("decimal" if whole else "double"))
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return number(f(x, y), XSD + ("integer" if whole else "double"))


def _pattern(pattern: Term, flags: Term | None) -> Column:
    """A regular expression with its flags (i, s, m and x count)."""
    if flags is None:
        return text_of(pattern)
    kept = F.regexp_replace(text_of(flags), "[^ismx]", "")
    return F.concat(F.when(kept != "", F.concat(F.lit("(?"), kept, F.lit(")"))).otherwise(""), text_of(pattern))


def cast(t: Term, name: str) -> Term:
    s = text_of(t)
    if name == "string":
        return Term("str", s)
    if name == "boolean":
        return boolean(truth_of(t) if t.kind in ("num", "bool") else F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False))
    if name in ("dateTime", "date"):
        return Term("time", t.col if t.kind == "time" else s.try_cast("timestamp"), type=XSD + "dateTime")
    if name in ("double", "float", "decimal"):
        return number(t.col.cast("double") if t.kind in ("num", "bool") else s.try_cast("double"), XSD + name)
    value = t.col.try_cast("bigint") if t.kind in ("num", "bool") else F.when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), s.try_cast("bigint"))
    low, high = NUMERIC[name]
    if low is not None and low > -(2**63):
        value = F.when(value >= low, value)
    if high is not None and high < 2**63 - 1:
        value = F.when(value <= high, value)
    return number(value, XSD + name)


def unify(terms: list[Term]) -> list[Term]:
    """The same kind for all, so that their columns can be put together."""
    first = terms[0]
    if all(t.kind == first.kind and t.prefix == first.prefix and t.kind != "term" for t in terms):
        if first.kind == "num" and len({t.type for t in terms}) > 1:
            return [Term("num", t.col.cast("double"), type=XSD + "double") for t in terms]
        return terms
    if all(t.kind in ("iri", "key") for t in terms):
        return [Term("iri", text_of(t)) for t in terms]
    return [Term("term", canonical(t)) for t in terms]


def compile_expression(e, scope: dict[str, Term], exists: Callable | None = None) -> Term:
    """The Term of an expression; scope has the Terms of the variables in reach."""
    if isinstance(e, Var):
        return scope.get(e.name, Term("str", F.lit(None).cast("string")))
    if isinstance(e, (Iri, Literal)):
        return constant(e)
    if not isinstance(e, Call):
        if exists is None:
            raise ExpressionError(f"{type(e).__name__} is not allowed here")
        return exists(e)
    op, args = e.op, e.args
    if op in ("regex", "replace"):
        t = [compile_expression(a, scope, exists) for a in args]
        if op == "regex":
            return boolean(F.regexp_like(text_of(t[0]), _pattern(t[1], t[2] if len(t) > 2 else None)))
        # a backslash before anything but $ is a letter of the replacement
        new = F.lit(re.sub(r"\\(?!\$)", r"\\\\", args[2].lex)) if isinstance(args[2], Literal) else F.regexp_replace(text_of(t[2]), r"\\(?!\$)", r"\\\\")
        return string(F.regexp_replace(text_of(t[0]), _pattern(t[1], t[3] if len(t) > 3 else None), new), t[0])
    if op == "bound":
        return boolean(scope[args[0].name].col.isNotNull() if args[0].name in scope else F.lit(False))
    t = [compile_expression(a, scope, exists) for a in args]
    if op == "&&":
        return boolean(truth_of(t[0]) & truth_of(t[1]))
    if op == "||":
        return boolean(truth_of(t[0]) | truth_of(t[1]))
    if op == "!":
        return boolean(~truth_of(t[0]))
    if op == "=":
        return boolean(equal(*t))
    if op == "!=":
        return boolean(~equal(*t))
    if op in ("<", "<=", ">", ">="):
        return boolean(compare(op, *t))
    if op == "in":
        out = F.lit(False)
        for x in t[1:]:
            out = out | equal(t[0], x)
        return boolean(out)
    if op in ("+", "-", "*", "/"):
        return _arith(op, *t)
    if op == "neg":
        return number(F.negative(number_of(t[0])), t[0].type or XSD + "double")
    if op == "sameterm":
        return boolean(same_term(*t))
    if op in ("isiri", "isuri", "isblank", "isliteral", "isresource", "isnumeric"):
        return boolean(_kind_test(op, t[0]))
    if op == "if":
        a, b = unify(t[1:])
        c = truth_of(t[0])
        return a.on(F.when(c, a.col).when(~c, b.col))
    if op == "coalesce":
        same = unify(t)
        return same[0].on(F.coalesce(*[x.col for x in same]))
    if op in FUNCTIONS:
        return FUNCTIONS[op](*t)
    if op in REGISTRY:
        return REGISTRY[op](*t)
    if op.startswith(XSD) and (op.removeprefix(XSD) in NUMERIC or op.removeprefix(XSD) in ("string", "boolean", "dateTime", "date")):
        return cast(t[0], op.removeprefix(XSD))
    raise ExpressionError(f"unknown function {op!r}")


def _lang(t: Term) -> Term:
    if t.kind == "lang":
        return Term("str", F.when(t.col.isNotNull(), F.coalesce(t.lang, F.lit(""))))
    return Term("str", language(t.col) if t.kind == "term" else F.when(t.col.isNotNull(), F.lit(None if t.kind in ("iri", "key") else "")))


def _datatype(t: Term) -> Term:
    if t.kind == "term":
        return Term("iri", datatype(t.col))
    name = {"lang": LANG_STRING, "num": t.type, "str": XSD + "string", "bool": XSD + "boolean", "time": XSD + "dateTime"}.get(t.kind)
    return Term("iri", F.when(t.col.isNotNull(), F.lit(name)))


def _langmatches(a: Term, b: Term) -> Term:
    tag, want = F.lower(text_of(a)), F.lower(text_of(b))
    return boolean(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))


def _before(t: Term, x: Term) -> Term:
    s, y = text_of(t), text_of(x)
    return string(F.when(_at(s, y) > 0, F.substr(s, F.lit(1), _at(s, y) - 1)).otherwise(""), t)


def _after(t: Term, x: Term) -> Term:
    s, y = text_of(t), text_of(x)
    return string(F.when(_at(s, y) > 0, F.substr(s, _at(s, y) + F.length(y))).otherwise(""), t)


def _at(s: Column, y: Column) -> Column:
    return F.call_function("instr", s, y)




def _timezone(t: Term) -> Column:
    return F.regexp_extract(lexical(t.col), r"(Z|[+-]\d\d:\d\d)$", 1) if t.kind == "term" else F.when(t.col.isNotNull(), F.lit(""))


def _duration(t: Term) -> Term:
    zone = _timezone(t)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    size = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""), F.when((hours == 0) & (minutes == 0), "0S").otherwise(""))
    return Term("term", F.when(zone != "", F.concat(F.lit('"'), F.when(zone == "Z", "PT0S").otherwise(size), F.lit(f'"^^<{XSD}dayTimeDuration>'))))


def _rounded(f: Callable) -> Callable:
    def one(t: Term) -> Term:
        return number(f(number_of(t)), t.type or XSD + "double")

    return one


def _like(t: Term, x: Term) -> Term:
    return boolean(F.call_function("like", text_of(t), text_of(x)))


#: The names of SPARQL's functions.
FUNCTIONS: dict[str, Callable[..., Term]] = {
    "str": lambda t: Term("str", text_of(t)),
    "label": lambda t: Term("str", text_of(t)),
    "lang": _lang,
    "langmatches": _langmatches,
    "datatype": _datatype,
    "namespace": lambda t: Term("iri", F.regexp_extract(text_of(t), "^(.*[#/:])", 1)),
    "localname": lambda t: Term("str", F.regexp_extract(text_of(t), "([^#/:]*)$", 1)),
    "iri": lambda t: Term("iri", text_of(t)),
    "uri": lambda t: Term("iri", text_of(t)),
    "bnode": lambda *t: Term("term", F.concat(F.lit("_:b"), F.md5(text_of(t[0])) if t else F.replace(F.uuid(), F.lit("-"), F.lit("")))),
    "strdt": lambda t, d: Term("term", F.concat(quoted(text_of(t)), F.lit("^^<"), text_of(d), F.lit(">"))),
    "strlang": lambda t, x: Term("lang", text_of(t), lang=F.lower(text_of(x))),
    "uuid": lambda: Term("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "struuid": lambda: Term("str", F.uuid()),
    "strlen": lambda t: number(F.length(text_of(t)).cast("bigint")),
    "substr": lambda t, a, *n: string(F.substr(text_of(t), number_of(a).cast("int"), *[number_of(x).cast("int") for x in n]), t),
    "ucase": lambda t: string(F.upper(text_of(t)), t),
    "lcase": lambda t: string(F.lower(text_of(t)), t),
    "concat": lambda *t: string(F.concat(*[text_of(x) for x in t])),
    "contains": lambda t, x: boolean(F.contains(text_of(t), text_of(x))),
    "strstarts": lambda t, x: boolean(text_of(t).startswith(text_of(x))),
    "strends": lambda t, x: boolean(text_of(t).endswith(text_of(x))),
    "strbefore": _before,
    "strafter": _after,
    "encode_for_uri": lambda t: Term("str", F.replace(F.replace(F.url_encode(text_of(t)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))),
    "like": _like,
    "abs": _rounded(F.abs),
    "ceil": _rounded(F.ceil),
    "floor": _rounded(F.floor),
    "round": _rounded(lambda c: F.floor(c + F.lit(0.5))),
    "rand": lambda: number(F.rand(), XSD + "double"),
    "now": lambda: Term("time", F.current_timestamp(), type=XSD + "dateTime"),
    "year": lambda t: number(F.year(time_of(t)).cast("bigint")),
    "month": lambda t: number(F.month(time_of(t)).cast("bigint")),
    "day": lambda t: number(F.dayofmonth(time_of(t)).cast("bigint")),
    "hours": lambda t: number(F.hour(time_of(t)).cast("bigint")),
    "minutes": lambda t: number(F.minute(time_of(t)).cast("bigint")),
    "seconds": lambda t: number(F.date_format(time_of(t), "s.SSSSSS").cast("double"), XSD + "decimal"),
    "tz": lambda t: Term("str", _timezone(t)),
    "timezone": _duration,
    "md5": lambda t: Term("str", F.md5(text_of(t))),
    "sha1": lambda t: Term("str", F.sha1(text_of(t))),
    "sha256": lambda t: Term("str", F.sha2(text_of(t), 256)),
    "sha384": lambda t: Term("str", F.sha2(text_of(t), 384)),
    "sha512": lambda t: Term("str", F.sha2(text_of(t), 512)),
}


def order_keys(t: Term, ascending: bool) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals; numbers before other literals, each by value."""
    keys = [t.col] if t.kind not in ("term", "key") else [text_of(t)]
    if t.kind == "term":
        rank = F.when(t.col.isNull(), 0).when(is_blank(t.col), 1).when(is_iri(t.col), 2).otherwise(3)
        keys = [rank, number_of(t), lexical(t.col), t.col]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


__all__ = ["FUNCTIONS", "REGISTRY", "compile_expression", "order_keys", "register_function", "unify", "xsd_of"]
