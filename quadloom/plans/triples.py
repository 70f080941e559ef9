"""Triples maps as quads: the product of subjects, predicates, objects and graphs of each record.

Layout `fused`: one `inline` over all statements of a logical source's maps, so that a source is read once; the statements
hold columns that are bound below it, so that no value is made twice. Layout `union`: a branch for each statement pattern,
so that a filter on predicates drops whole branches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.mapping.model import ExpressionMap, RefObjectMap, TriplesMap
from quadloom.operators.joins import join_once, join_subjects, keyed, keyed_once
from quadloom.plans.terms import Compiler, Term, Terms, begun, fixed, form, there
from quadloom.rdf.terms import RDF_TYPE, RR

QUAD = "struct<subject:string,predicate:string,object:string,object_kind:string,datatype:string,lang:string,graph:string>"
COLUMNS = ["subject", "predicate", "object", "object_kind", "datatype", "lang", "graph"]
DEFAULT = RR + "defaultGraph"


@dataclass
class Statements:
    """Quads of a record: one (`one`, a struct, made of `terms`) if none of `needs` is null, or an array."""

    one: Column | None = None
    needs: tuple[Column, ...] = ()
    array: Column | None = None
    predicate: str | None = None
    terms: tuple[Term, Term, Term, Term] | None = None


def _quad(s, p, o, g) -> Column:
    """Of structs or Terms."""
    text = lambda x: F.lit(x) if isinstance(x, str) else F.lit(None).cast("string") if x is None else x
    graph = F.when(g.value != DEFAULT, g.value)
    return F.struct(s.value.alias("subject"), p.value.alias("predicate"), o.value.alias("object"), text(o.kind).alias("object_kind"), text(o.datatype).alias("datatype"), text(o.lang).alias("lang"), graph.alias("graph"))


def no_graph() -> Terms:
    return Terms(Term(fixed(DEFAULT), "iri"))


def union_of(terms: Iterable[Terms]) -> Terms:
    terms = list(terms)
    if len(terms) == 1:
        return terms[0]
    return Terms(array=F.array_distinct(F.concat(*[t.many for t in terms])))


def single(s: Term, p: Term, o: Term, g: Term) -> Statements:
    return Statements(_quad(s, p, o, g), tuple(c for t in (s, p, o, g) for c in t.needs), terms=(s, p, o, g))


def product(s: Terms, p: Terms, o: Terms, g: Terms) -> Statements:
    parts = (s, p, o, g)
    if all(t.one is not None for t in parts):
        return single(s.one, p.one, o.one, g.one)
    needs = tuple(c for t in parts if t.one is not None for c in t.one.needs)
    arrays = [i for i, t in enumerate(parts) if t.one is None]

    def over(left: list[int], chosen: dict[int, Column]) -> Column:
        """array of quads: the product over the arrays that are left; single terms stand in it as they are."""
        make = lambda i: lambda x: over(left[1:], {**chosen, i: x}) if len(left) > 1 else _quad(*[chosen.get(k, x) if t.one is None else t.one for k, t in enumerate(parts)])
        made = F.transform(parts[left[0]].array, make(left[0]))
        return F.flatten(made) if len(left) > 1 else made

    made = F.array_distinct(over(arrays, {}))
    return Statements(array=F.when(there(needs), made).otherwise(F.array().cast(f"array<{QUAD}>")) if needs else made)


@dataclass
class Planned:
    """What a triples map needs of its records: the statements of a record, and the joins."""

    statements: list[Statements]
    joins: list[tuple[RefObjectMap, list[Terms]]]


class MapPlan:
    def __init__(self, m: TriplesMap, compiler: Compiler, same_source):
        """same_source: of a parent map, whether it reads the records of this one."""
        if not m.subjects:
            raise MappingError(f"{m} has no subject map")
        self.m, self.c, self.same_source = m, compiler, same_source

    def subjects(self) -> list[tuple[Terms, Terms | None]]:
        """Subjects, and the graphs of the subject map (none: no graph map)."""
        out = []
        for s in self.m.subjects:
            graphs = [self.c.terms(g, "graph") for g in s.graphs]
            out.append((self.c.terms(s, "subject"), union_of(graphs) if graphs else None))
        return out

    def graphs(self, own: Terms | None, maps: list[ExpressionMap]) -> Terms:
        """Graphs of the subject and of the predicate-object map together; without any value, the default graph."""
        found = ([own] if own is not None else []) + [self.c.terms(g, "graph") for g in maps]
        if not found:
            return no_graph()
        g = union_of(found)
        if g.one is not None:
            return Terms(Term(F.coalesce(g.one.value, F.lit(DEFAULT)), "iri")) if g.one.needs else g
        return Terms(array=F.when(F.size(g.array) == 0, no_graph().many).otherwise(g.array))

    def plan(self) -> Planned:
        out = Planned([], [])
        for (s, own), subject_map in zip(self.subjects(), self.m.subjects, strict=True):
            for c in subject_map.classes:
                made = product(s, Terms(Term(fixed(RDF_TYPE), "iri")), Terms(Term(fixed(c), "iri")), self.graphs(own, []))
                made.predicate = RDF_TYPE
                out.statements.append(made)
            for pom in self.m.poms:
                g = self.graphs(own, pom.graphs)
                for p_map in pom.predicates:
                    p = self.c.terms(p_map, "predicate")
                    for o in pom.objects:
                        if not isinstance(o, RefObjectMap):
                            made = product(s, p, self.c.terms(o, "object"), g)
                        elif o.conditions:
                            out.joins.append((o, [s, p, g]))
                            continue
                        else:
                            made = product(s, p, self.parent_subjects(o.parent), g)
                        made.predicate = getattr(p_map.constant, "value", None)
                        out.statements.append(made)
        return out

    def parent_subjects(self, parent: TriplesMap) -> Terms:
        """Without conditions: the parent's subjects of the child's own record."""
        if parent.source is None or not self.same_source(parent):
            raise MappingError(f"{self.m} refers to {parent} without a join condition, and their logical sources differ")
        if not parent.subjects:
            raise MappingError(f"{parent} has no subject map")
        return union_of([self.c.terms(s, "subject") for s in parent.subjects])


def fused(df: DataFrame, statements: list[Statements]) -> DataFrame | None:
    """One pass over df. Statements that a record does not have are null in the array, and dropped behind `inline`."""
    if not statements:
        return None
    ones = [F.when(there(s.needs), s.one) if s.needs else s.one for s in statements if s.array is None]
    arrays = [s.array for s in statements if s.array is not None]
    quads = ([F.array(*ones)] if ones else []) + arrays
    out = df.select(F.inline(F.concat(*quads) if len(quads) > 1 else quads[0]))
    return out.where("subject IS NOT NULL") if any(s.needs for s in statements) else out


def branches(df: DataFrame, statements: list[Statements]) -> DataFrame | None:
    out = None
    for s in statements:
        if s.array is not None:
            part = df.select(F.inline(s.array))
        else:
            part = (df.where(there(s.needs)) if s.needs else df).select(s.one.alias("q")).select("q.*")
        out = part if out is None else out.unionByName(part)
    return out


def joined(child: Compiler, ref: RefObjectMap, parts: list[Terms], parent: Compiler) -> tuple[DataFrame, Statements]:
    """A reference with join conditions: the joined rows, and the statement that each of them makes."""
    if not ref.parent.subjects:
        raise MappingError(f"{ref.parent} has no subject map")
    subjects = union_of([parent.terms(x, "subject") for x in ref.parent.subjects])
    values = [child.reference(j.child) for j in ref.conditions]
    found_by = [parent.reference(j.parent) for j in ref.conditions]
    s, p, g = parts
    if len(values) == 1 and all(t.one is not None for t in (*parts, subjects, values[0], found_by[0])):
        df, made = _joined_once(child, parts, values[0].one, parent, subjects.one, found_by[0].one)
    else:
        rows = child.df.select(s.many.alias("s"), p.many.alias("p"), g.many.alias("g"), *[v.many.alias(f"v{i}") for i, v in enumerate(values)]).where((F.size("s") > 0) & (F.size("p") > 0))
        conditions = [(f"v{i}", keyed(parent.df, subjects.many, v.many)) for i, v in enumerate(found_by)]
        found = join_subjects(rows, ["s", "p", "g"], conditions)
        found = found.select(F.explode("s").alias("s"), "p", "g", "o").select("s", F.explode("p").alias("p"), "g", "o").select("s", "p", "o", F.explode("g").alias("g"))
        df, made = found, Statements(_quad(F.col("s"), F.col("p"), F.col("o"), F.col("g")))
    made.predicate = constant_of(p)
    return df, made


def constant_of(terms: Terms) -> str | None:
    """The text of a term that all records have."""
    text, rest = ("", True) if terms.one is None else form(terms.one.value)
    return text if rest is None else None


def _joined_once(child: Compiler, parts: list[Terms], value: Column, parent: Compiler, subject: Term, key: Column) -> tuple[DataFrame, Statements]:
    """One value, one subject, one predicate and one graph a record: no array crosses the join, and nothing that is the
    same for all records, nor how all subjects begin. A parent's subject crosses it even where it is the key itself: a set of
    subject and key would be left as the join deals it, by keys alone, and a key that most records have would be one task's."""
    needs = (value, *(c for t in parts for c in t.one.needs))
    own = {n: rest for n, t in zip("spg", parts, strict=True) if (rest := form(t.one.value)[1]) is not None}
    rows = child.df.where(there(needs)).select(*[c.alias(n) for n, c in own.items()], value.alias("k"))
    begin, rest = form(subject.value)
    found = join_once(rows, keyed_once(parent.df, subject.needs, key, rest))
    again = lambda t, n: Term(begun(form(t.value)[0], F.col(n)), t.kind)
    terms = [again(t.one, n) if n in own else t.one for n, t in zip("spg", parts, strict=True)]
    o = Term(fixed(begin), subject.kind) if rest is None else again(subject, "o")
    return found, single(terms[0], terms[1], o, terms[2])
