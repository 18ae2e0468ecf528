"""Joins of solution tables on compatible values.

Variables that are bound on both sides are equi-join keys, so Spark can hash or sort them;
only variables that may be unbound add a null-aware condition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import truth_of, unify
from ..plans.relation import Relation, build, columns


def aligned(left: Relation, right: Relation) -> tuple[Relation, Relation, list[str]]:
    """Both sides with the same kind of column for each shared variable."""
    shared = [n for n in left.specs if n in right.specs]
    a, b = left.scope(), right.scope()
    changed = False
    for n in shared:
        x, y = unify([a[n], b[n]])
        changed |= x is not a[n] or y is not b[n]
        a[n], b[n] = x, y
    if changed:
        left, right = build(left.df, a, left.maybe), build(right.df, b, right.maybe)
    return left, right, shared


def _keys(relation: Relation, name: str) -> list[str]:
    return [c for c in columns(name, relation.specs[name]) if not c.endswith("_num")]


def _condition(left: Relation, right: Relation, shared: list[str]) -> Column:
    """Compatibility of left's columns with right's, which carry the suffix __r."""
    out = F.lit(True)
    for n in shared:
        same = F.lit(True)
        for c in _keys(left, n):
            same = same & (F.col(c) == F.col(c.replace(f"v_{n}", f"v_{n}__r", 1)))
        if n in left.maybe or n in right.maybe:
            same = same | F.col(f"v_{n}").isNull() | F.col(f"v_{n}__r").isNull()
        out = out & same
    return out


def _merged(left: Relation, right: Relation, shared: list[str], how: str, condition: Column | None = None) -> Relation:
    renamed = right.renamed("__r")
    on = _condition(left, right, shared)
    if condition is not None:
        on = on & condition
    df = left.df.join(renamed, on, how) if shared or condition is not None or how != "inner" else left.df.crossJoin(renamed)
    terms = {}
    for n in left.specs:
        t = left.term(n)
        if n in shared and n in left.maybe:
            r = right.term(n, "__r")
            t = type(t)(t.kind, F.coalesce(t.col, r.col), t.prefix, F.coalesce(t.lang, r.lang) if t.kind == "lang" else None, F.coalesce(t.num, r.num) if t.num is not None and r.num is not None else None, t.type)
        terms[n] = t
    terms |= {n: right.term(n, "__r") for n in right.specs if n not in shared}
    return build(df, terms)


def join(left: Relation, right: Relation) -> Relation:
    left, right, shared = aligned(left, right)
    unsure = [n for n in shared if n in left.maybe or n in right.maybe]
    if shared and not unsure:
        extra = [c for n in right.specs if n not in shared for c in columns(n, right.specs[n])]
        keys = [c for n in shared for c in _keys(left, n)]
        df = left.df.join(right.df.select(*keys, *extra), keys, "inner")
        out = Relation(df, left.specs | {n: s for n, s in right.specs.items() if n not in shared})
    elif 0 < sum((n in left.maybe) + (n in right.maybe) for n in unsure) <= 2:
        out = _by_boundness(left, right, shared, unsure)
    else:
        out = _merged(left, right, shared, "inner")
    out.maybe = {n for n in left.maybe | right.maybe if not (n in shared and (n not in left.maybe or n not in right.maybe))}
    return out


def _by_boundness(left: Relation, right: Relation, shared: list[str], unsure: list[str]) -> Relation:
    """The inner join in parts by which unsure variables are bound on either side, so that bound ones are equi-join keys."""

    def parts(side: Relation) -> list[tuple[set[str], Relation]]:
        some, out = [n for n in unsure if n in side.maybe], []
        for mask in range(1 << len(some)):
            free = {n for i, n in enumerate(some) if mask >> i & 1}
            df = side.df
            for n in some:
                df = df.where(F.col(f"v_{n}").isNull() if n in free else F.col(f"v_{n}").isNotNull())
            out.append((free, Relation(df, side.specs, side.maybe)))
        return out

    found = []
    for a, x in parts(left):
        for b, y in parts(right):
            keys = [n for n in shared if n not in a | b]
            renamed = y.renamed("__r")
            on = _condition(Relation(x.df, x.specs), Relation(y.df, y.specs), keys)
            df = x.df.join(renamed, on, "inner") if keys else x.df.crossJoin(renamed)
            terms = {n: y.term(n, "__r") if n in a else x.term(n) for n in left.specs}
            terms |= {n: y.term(n, "__r") for n in right.specs if n not in shared}
            found.append(build(df, terms))
    return union(found) if len(found) > 1 else found[0]


def flagged(left: Relation, right: Relation, name: str, negated: bool) -> Relation | None:
    """left with a column that tells whether a compatible solution of right exists, by one join; None if a shared variable may be unbound."""
    left, right, shared = aligned(left, right)
    if not shared or any(n in left.maybe or n in right.maybe for n in shared):
        return None
    keys = right.select(shared).renamed("__r").distinct().withColumn("__there", F.lit(True))
    there = F.coalesce(F.col("__there"), F.lit(False))
    df = left.df.join(keys, _condition(left, right, shared), "left")
    return Relation(df.select(*left.df.columns, (~there if negated else there).alias(name)), left.specs, left.maybe)


def left_join(left: Relation, right: Relation, condition=None) -> Relation:
    """OPTIONAL; condition(scope) is a list of Terms that must be true for a match."""
    left, right, shared = aligned(left, right)
    on = None
    if condition:
        scope = {n: right.term(n, "__r") for n in right.specs} | left.scope()
        for t in condition(scope):
            on = truth_of(t) if on is None else on & truth_of(t)
    out = _merged(left, right, shared, "left", on)
    out.maybe = left.maybe | {n for n in right.specs if n not in shared}
    return out


def minus(left: Relation, right: Relation) -> Relation:
    """MINUS: a solution goes if a compatible one shares a bound variable with it."""
    left, right, shared = aligned(left, right)
    if not shared:
        return left
    on = _condition(left, right, shared)
    if all(n in left.maybe or n in right.maybe for n in shared):
        both = F.lit(False)
        for n in shared:
            both = both | (F.col(f"v_{n}").isNotNull() & F.col(f"v_{n}__r").isNotNull())
        on = on & both
    return Relation(left.df.join(right.select(shared).renamed("__r"), on, "left_anti"), left.specs, left.maybe)


def exists(left: Relation, right: Relation, negated: bool, condition=None) -> Relation:
    left, right, shared = aligned(left, right)
    on = _condition(left, right, shared)
    if condition:
        scope = {n: right.term(n, "__r") for n in right.specs} | left.scope()
        for t in condition(scope):
            on = on & truth_of(t)
    elif right.specs:
        right = right.select(shared) if shared else right
    return Relation(left.df.join(right.renamed("__r") if right.specs else right.df.limit(1), on, "left_anti" if negated else "left_semi"), left.specs, left.maybe)


def _padded(parts: list[Relation]) -> tuple[list[Relation], set[str]]:
    """The parts with the same columns, and the variables that may be unbound: those that a part lacks are null in it."""
    names = list(dict.fromkeys(n for p in parts for n in p.specs))
    terms = [p.scope() for p in parts]
    for n in names:
        have = [i for i, p in enumerate(parts) if n in p.specs]
        for i, t in zip(have, unify([terms[i][n] for i in have]), strict=True):
            terms[i][n] = t
        like = terms[have[0]][n]
        numeric = all(terms[i][n].num is not None for i in have)
        for i, p in enumerate(parts):
            if n in p.specs:
                if not numeric:
                    terms[i][n] = type(like)(terms[i][n].kind, terms[i][n].col, terms[i][n].prefix, terms[i][n].lang, None, terms[i][n].type)
            else:
                null = F.lit(None).cast(parts[have[0]].df.select(like.col.alias("x")).schema["x"].dataType)
                terms[i][n] = type(like)(like.kind, null, like.prefix, F.lit(None).cast("string") if like.kind == "lang" else None, F.lit(None).cast("double") if numeric else None, like.type)
    built = [build(p.df, {n: t[n] for n in names}) for p, t in zip(parts, terms, strict=True)]
    return built, {n for n in names for p in parts if n not in p.specs or n in p.maybe}


def union(parts: list[Relation]) -> Relation:
    """UNION: bag union; variables that a part lacks are unbound in it."""
    built, maybe = _padded(parts)
    df = built[0].df
    for b in built[1:]:
        df = df.unionByName(b.df)
    return Relation(df, built[0].specs, maybe)


def intersect(parts: list[Relation]) -> Relation:
    """INTERSECT: the solutions that all parts have, each once; variables that a part lacks are unbound in it."""
    built, maybe = _padded(parts)
    names = [c for n, spec in built[0].specs.items() for c in columns(n, spec)]
    df = built[0].df.select(*names)
    for b in built[1:]:
        df = df.intersect(b.df.select(*names))
    return Relation(df, built[0].specs, maybe)
