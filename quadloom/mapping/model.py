"""The query: plain dataclasses, known by node id, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from quadloom.expr.template import parse_template


@dataclass(frozen=True)
class Source:
    """Where records come from: a path or table name, a named stream, or both; namespaces for XML."""

    path: str | None = None
    stream: str | None = None
    is_stream: bool = False
    namespaces: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class LogicalSource:
    source: Source | None
    iterator: str | None
    formulation: str | None


@dataclass(eq=False)
class ExpressionMap:
    id: str
    constant: object | None = None
    reference: str | None = None
    template: str | None = None
    function: TriplesMap | None = None
    term_type: str | None = None


@dataclass(eq=False)
class SubjectMap(ExpressionMap):
    classes: list[str] = field(default_factory=list)
    graphs: list[ExpressionMap] = field(default_factory=list)


@dataclass(eq=False)
class ObjectMap(ExpressionMap):
    datatype: ExpressionMap | None = None
    language: ExpressionMap | None = None


@dataclass(frozen=True)
class JoinCondition:
    child: str
    parent: str


@dataclass(eq=False)
class RefObjectMap:
    id: str
    parent: TriplesMap
    conditions: list[JoinCondition]


@dataclass(eq=False)
class PredicateObjectMap:
    id: str
    predicates: list[ExpressionMap]
    objects: list[ObjectMap | RefObjectMap]
    graphs: list[ExpressionMap]


@dataclass(eq=False)
class TriplesMap:
    id: str
    source: LogicalSource | None = None
    subjects: list[SubjectMap] = field(default_factory=list)
    poms: list[PredicateObjectMap] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"TriplesMap({self.id})"


def references(maps: list[TriplesMap]) -> tuple[set[str], set[str]]:
    """Ids of the maps used as function calls, and of those used as parents."""
    functions, parents, seen = set(), set(), set()

    def visit(e: ExpressionMap | None) -> None:
        if e is None or e.id in seen:
            return
        seen.add(e.id)
        if e.function is not None:
            functions.add(e.function.id)
            walk(e.function)
        for inner in (getattr(e, "datatype", None), getattr(e, "language", None), *getattr(e, "graphs", ())):
            visit(inner)

    def walk(m: TriplesMap) -> None:
        for s in m.subjects:
            visit(s)
        for pom in m.poms:
            for e in (*pom.predicates, *pom.graphs):
                visit(e)
            for o in pom.objects:
                if isinstance(o, RefObjectMap):
                    parents.add(o.parent.id)
                else:
                    visit(o)

    for m in maps:
        walk(m)
    return functions, parents


def texts_read(maps: list[TriplesMap], source: LogicalSource | None) -> list[str]:
    """The references that maps make to the records of a logical source."""
    out: list[str] = []

    def visit(e: ExpressionMap | None) -> None:
        if e is None:
            return
        if e.reference is not None:
            out.append(e.reference)
        if e.template is not None:
            out.extend(v for k, v in parse_template(e.template) if k == "expr")
        if e.function is not None:
            walk(e.function)
        for inner in (getattr(e, "datatype", None), getattr(e, "language", None), *getattr(e, "graphs", ())):
            visit(inner)

    def walk(m: TriplesMap) -> None:
        for s in m.subjects:
            visit(s)
        for pom in m.poms:
            for e in (*pom.predicates, *pom.graphs, *(o for o in pom.objects if not isinstance(o, RefObjectMap))):
                visit(e)
            for o in pom.objects:
                if isinstance(o, RefObjectMap):
                    out.extend(j.child for j in o.conditions)
                    if not o.conditions:
                        for s in o.parent.subjects:
                            visit(s)

    for m in maps:
        if m.source == source:
            walk(m)
        for pom in m.poms:
            for o in pom.objects:
                if isinstance(o, RefObjectMap) and o.parent.source == source:
                    out.extend(j.parent for j in o.conditions)
    return list(dict.fromkeys(out))


def mappable(maps: list[TriplesMap]) -> list[TriplesMap]:
    """Without those that are only called as functions."""
    functions, parents = references(maps)
    return [m for m in maps if m.id not in functions or m.id in parents]
