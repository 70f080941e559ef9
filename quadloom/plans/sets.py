"""Quads as a set, told apart by what differs among them.

Statements that could give the same quad are of one class; what is known to be the same in a class (predicate, kind,
datatype, language, graph, how subjects and objects begin) is not hashed, kept or sent, but put to the rows behind the set.
Statements of several predicates that are the same otherwise are one, and their rows get the predicates behind the set too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.plans.terms import form, there
from quadloom.plans.triples import COLUMNS, DEFAULT, Statements

#: Of a quad, all but subject and object.
REST = ["predicate", "object_kind", "datatype", "lang", "graph"]
#: Beginnings are told apart by CASE up to so many, by position beyond.
CASES = 8


@dataclass
class Source:
    """Records, and the statements that each makes. joined: rows of a join, which make one statement."""

    df: DataFrame
    statements: list[Statements]
    joined: bool = False


@dataclass
class Piece:
    """A statement of a source. fixed: what is the same in all its quads; columns: makes the others of an element of its
    array (or of nothing). begins: how subject and object begin; follow: what comes then (none: nothing)."""

    source: int
    statement: Statements
    fixed: dict[str, str | None]
    columns: Callable[[Column | None], dict[str, Column]]
    begins: tuple[str, str]
    follow: Callable[[Column | None], tuple[Column | None, Column | None]]
    whole: tuple[bool, bool]
    key: object = field(default_factory=object)


@dataclass
class Class:
    pieces: list[Piece]
    predicates: list[str | None]
    fixed: dict[str, str | None]
    begins: tuple[str, str]


def _bound(c: Column | None) -> str | None:
    """The name of a bound column, which no other column has."""
    if c is None:
        return ""
    found = re.fullmatch(r"Column<'(__bound[0-9]+)'>", str(c))
    return found and found[1]


def piece(source: int, s: Statements) -> Piece:
    if s.terms is None:
        fixed = {} if s.predicate is None else {"predicate": s.predicate}
        whole = lambda x: s.one if x is None else x
        return Piece(source, s, fixed, lambda x: {n: whole(x)[n] for n in REST}, ("", ""), lambda x: (whole(x)["subject"], whole(x)["object"]), (False, False))
    subject, p, o, g = s.terms
    fixed, columns = {"object_kind": o.kind}, {}
    for name, c in (("predicate", p.value), ("datatype", o.datatype), ("lang", o.lang), ("graph", g.value)):
        text, rest = (None, None) if c is None else form(c)
        if rest is not None:
            columns[name] = F.when(c != DEFAULT, c) if name == "graph" else c
        else:
            fixed[name] = None if name == "graph" and text == DEFAULT else text
    (a, x), (b, y) = form(subject.value), form(o.value)
    made = Piece(source, s, fixed, lambda _: columns, (a, b), lambda _: (x, y), (x is None, y is None))
    names = [_bound(c) for c in (x, y, *columns.values(), *s.needs)]
    if all(n is not None for n in names):
        made.key = (source, tuple(sorted((k, v or "", v is None) for k, v in fixed.items() if k != "predicate")), (a, b), tuple(names), tuple(columns), "predicate" in fixed)
    return made


def apart(a: Piece, b: Piece) -> bool:
    """No quad can be of both."""
    if any(a.fixed[n] != b.fixed[n] for n in a.fixed.keys() & b.fixed.keys()):
        return True
    for p, q, all_p, all_q in zip(a.begins, b.begins, a.whole, b.whole, strict=True):
        if p != q if all_p and all_q else not p.startswith(q) if all_p else not q.startswith(p) if all_q else not (p.startswith(q) or q.startswith(p)):
            return True
    return False


def _joint(n: int, linked: Callable[[int, int], bool]) -> list[list[int]]:
    """0 to n - 1 in the groups that links join."""
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and linked(i, j):
                old = group[i]
                group = [group[j] if k == old else k for k in group]
    found: dict[int, list[int]] = {}
    for i, k in enumerate(group):
        found.setdefault(k, []).append(i)
    return list(found.values())


def classes(pieces: list[Piece]) -> list[Class]:
    found: dict[object, Class] = {}
    for members in _joint(len(pieces), lambda i, j: not apart(pieces[i], pieces[j])):
        own = [pieces[i] for i in members]
        fixed = {n: own[0].fixed[n] for n in REST if all(n in p.fixed and p.fixed[n] == own[0].fixed[n] for p in own)}
        begins = tuple(os.path.commonprefix([p.begins[k] for p in own]) for k in (0, 1))
        same = frozenset(p.key for p in own)
        if "predicate" not in fixed:
            found[object()] = Class(own, [None], fixed, begins)
        elif same in found:
            found[same].predicates.append(fixed["predicate"])
        else:
            # a statement that the mapping repeats is needed once
            found[same] = Class(list({p.key: p for p in own}.values()), [fixed["predicate"]], fixed, begins)
    return list(found.values())


def quads_of(sources: list[Source], layout: str) -> DataFrame:
    """The distinct quads. Sources whose statements share no class are told apart each for itself."""
    made = classes([piece(i, s) for i, source in enumerate(sources) for s in source.statements])
    holds = [{p.source for p in c.pieces} for c in made]
    out = None
    for members in _joint(len(made), lambda i, j: bool(holds[i] & holds[j])):
        part = _set([made[i] for i in members], sources, layout)
        out = part if out is None else out.unionByName(part)
    return out


def _set(made: list[Class], sources: list[Source], layout: str) -> DataFrame:
    sent = [n for n in REST if any(n not in c.fixed for c in made)]

    def row(c: int, p: Piece, x: Column | None) -> Column:
        k, own, columns = made[c], [], p.columns(x)
        for name, begin, common, rest in zip("so", p.begins, k.begins, p.follow(x), strict=True):
            more = F.lit(begin[len(common) :])
            own.append((more if rest is None else F.concat(more, rest) if begin != common else rest).alias(name))
        none = F.lit(None).cast("string")
        own += [(none if n in k.fixed else columns[n] if n in columns else none if p.fixed[n] is None else F.lit(p.fixed[n])).alias(n) for n in sent]
        return F.struct(*([F.lit(c).alias("c")] if len(made) > 1 else []), *own)

    out = None
    for i in sorted({p.source for c in made for p in c.pieces}):
        rows = _rows(sources[i].df, [(p.statement, partial(row, c, p)) for c, k in enumerate(made) for p in k.pieces if p.source == i], layout)
        out = rows if out is None else out.unionByName(rows)
    return _whole(out.distinct(), made, sent)


def _rows(df: DataFrame, statements: list[tuple[Statements, Callable]], layout: str) -> DataFrame:
    """As fused and branches of plans.triples, for rows of a set."""
    if layout == "union" or len(statements) == 1:
        out = None
        for s, row in statements:
            if s.array is not None:
                part = df.select(F.inline(F.transform(s.array, row)))
            else:
                part = (df.where(there(s.needs)) if s.needs else df).select(row(None).alias("r")).select("r.*")
            out = part if out is None else out.unionByName(part)
        return out
    ones = [F.when(there(s.needs), row(None)) if s.needs else row(None) for s, row in statements if s.array is None]
    arrays = [F.transform(s.array, row) for s, row in statements if s.array is not None]
    rows = ([F.array(*ones)] if ones else []) + arrays
    out = df.select(F.inline(F.concat(*rows) if len(rows) > 1 else rows[0]))
    return out.where("s IS NOT NULL") if any(s.needs for s, _ in statements) else out


def _whole(rows: DataFrame, made: list[Class], sent: list[str]) -> DataFrame:
    """The quads of the rows of a set."""

    def of_class(values: list) -> Column:
        lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast("string")
        return lit(values[0]) if all(v == values[0] for v in values) else F.element_at(F.array(*map(lit, values)), F.col("c") + 1)

    def text(k: int, name: str) -> Column:
        of: dict[tuple[str, bool], list[int]] = {}
        for i, c in enumerate(made):
            of.setdefault((c.begins[k], all(p.whole[k] and p.begins[k] == c.begins[k] for p in c.pieces)), []).append(i)
        if len(of) > CASES:
            return F.concat(of_class([c.begins[k] for c in made]), F.col(name))
        out = None
        for (begin, all_of_it), ids in of.items():
            one = F.lit(begin) if all_of_it else F.concat(F.lit(begin), F.col(name)) if begin else F.col(name)
            out = one if out is None else F.when(F.col("c").isin(*ids), one).otherwise(out)
        return out

    several = any(len(c.predicates) > 1 for c in made)
    if several:
        rows = rows.withColumn("p", F.explode(of_class([[p or "" for p in c.predicates] for c in made])))
    columns = {"subject": text(0, "s"), "object": text(1, "o")}
    for n in REST:
        known = F.col("p") if several and n == "predicate" else of_class([c.fixed.get(n) for c in made])
        varies = [i for i, c in enumerate(made) if n not in c.fixed]
        columns[n] = known if n not in sent else F.col(n) if len(varies) == len(made) else F.when(F.col("c").isin(*varies), F.col(n)).otherwise(known)
    return rows.select(*[columns[n].alias(n) for n in COLUMNS])
