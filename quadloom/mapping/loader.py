"""From an RDF graph to the mapping model."""

from __future__ import annotations

import os
from collections.abc import Iterable

from quadloom.errors import MappingError
from quadloom.mapping.model import ExpressionMap, JoinCondition, LogicalSource, ObjectMap, PredicateObjectMap, RefObjectMap, Source, SubjectMap, TriplesMap
from quadloom.rdf.terms import EXT, FNML, IRI, RDF_TYPE, RML, RR, BNode, Graph, Literal, local_name
from quadloom.rdf.turtle import parse

TERM_TYPES = {RR + "IRI": "iri", RR + "BlankNode": "bnode", RR + "Literal": "literal"}


def load_mapping(*documents: str | os.PathLike | Graph) -> list[TriplesMap]:
    """The triples maps of Turtle texts, paths and graphs, read as one mapping."""
    graph = Graph()
    for d in documents:
        if isinstance(d, Graph):
            graph.update(d)
        elif isinstance(d, os.PathLike) or "\n" not in d and os.path.exists(d):
            with open(d, encoding="utf-8") as f:
                graph.update(parse(f.read()))
        else:
            graph.update(parse(d))
    return _Loader(graph).load()


class _Loader:
    def __init__(self, graph: Graph):
        self.g = graph
        self.maps: dict[object, TriplesMap] = {}

    def load(self) -> list[TriplesMap]:
        return [self.triples_map(n) for n in self.g.subjects(RML + "logicalSource")]

    # -- values of properties

    def many(self, node, *properties: str) -> list:
        """Properties without a namespace are extension terms."""
        return [o for p in properties for o in (self.g.objects(node, p) if ":" in p else self.g.extended(node, p))]

    def one(self, node, *properties: str):
        found = self.many(node, *properties)
        if len(found) > 1:
            raise MappingError(f"{node} has {len(found)} values for {properties[0]}; one is allowed")
        return found[0] if found else None

    def text(self, node, *properties: str) -> str | None:
        value = self.one(node, *properties)
        if value is not None and not isinstance(value, Literal):
            raise MappingError(f"{properties[0]} of {node} must be a literal, not {value}")
        return None if value is None else value.value

    # -- the parts

    def triples_map(self, node) -> TriplesMap:
        if node in self.maps:
            return self.maps[node]
        m = self.maps[node] = TriplesMap(str(node))  # before its parts, which may refer to it
        source = self.one(node, RML + "logicalSource")
        m.source = self.logical_source(source) if source is not None else None
        m.subjects = [self.subject_map(n) for n in self.many(node, RR + "subjectMap")]
        m.subjects += [SubjectMap(f"{node} subject {s}", constant=s) for s in self.many(node, RR + "subject")]
        m.poms = [self.pom(n) for n in self.many(node, RR + "predicateObjectMap")]
        return m

    def logical_source(self, node) -> LogicalSource:
        if len(found := self.many(node, RML + "source")) > 1:
            raise MappingError(f"{node} has {len(found)} sources; one is allowed")
        formulation = self.one(node, RML + "referenceFormulation")
        return LogicalSource(self.source(found[0]) if found else None, self.text(node, RML + "iterator"), formulation.value if formulation is not None else None)

    def source(self, node) -> Source:
        if isinstance(node, Literal):
            return Source(path=node.value)
        types = {local_name(t.value) for t in self.many(node, RDF_TYPE)}
        name, url = self.text(node, "streamName"), self.text(node, "url")
        spaces = tuple(sorted((self.text(n, "namespacePrefix") or "", self.text(n, "namespaceName") or "") for n in self.many(node, "declaresNamespace")))
        if not types & {"Stream", "FileSource", "XmlDocument"} and name is None and url is None and not spaces:
            if isinstance(node, IRI):
                return Source(path=node.value)
            raise MappingError(f"the source {node} is of no known type")
        return Source(path=url, stream=name, is_stream=url is None, namespaces=spaces)

    def expression(self, node, cls=ExpressionMap, **more):
        term_type = self.one(node, RR + "termType")
        if term_type is not None and getattr(term_type, "value", None) not in TERM_TYPES:
            raise MappingError(f"{term_type} of {node} is no term type")
        function = self.one(node, FNML + "functionValue", "multiFunctionValue")
        return cls(
            str(node),
            constant=self.one(node, RR + "constant"),
            reference=self.text(node, RML + "reference", "multiReference"),
            template=self.text(node, RR + "template", "multiTemplate"),
            function=None if function is None else self.triples_map(function),
            term_type=None if term_type is None else TERM_TYPES[term_type.value],
            **more,
        )

    def listed(self, node, long: str, short: str) -> list[ExpressionMap]:
        out = []
        for n in self.many(node, RR + long):
            if isinstance(n, Literal):
                raise MappingError(f"{long} of {node} must be a map, not {n}")
            out.append(self.expression(n))
        return out + [ExpressionMap(f"{node} {short} {c}", constant=c) for c in self.many(node, RR + short)]

    def subject_map(self, node) -> SubjectMap:
        return self.expression(node, SubjectMap, classes=[c.value for c in self.many(node, RR + "class")], graphs=self.listed(node, "graphMap", "graph"))

    def pom(self, node) -> PredicateObjectMap:
        objects: list[ObjectMap | RefObjectMap] = [self.object_map(n) for n in self.many(node, RR + "objectMap")]
        objects += [ObjectMap(f"{node} object {c}", constant=c) for c in self.many(node, RR + "object")]
        return PredicateObjectMap(str(node), self.listed(node, "predicateMap", "predicate"), objects, self.listed(node, "graphMap", "graph"))

    def object_map(self, node) -> ObjectMap | RefObjectMap:
        if (parent := self.one(node, RR + "parentTriplesMap")) is not None:
            joins = [JoinCondition(self.text(n, RR + "child") or "", self.text(n, RR + "parent") or "") for n in self.many(node, RR + "joinCondition", "multiJoinCondition")]
            if any(not j.child or not j.parent for j in joins):
                raise MappingError(f"a join condition of {node} lacks its child or parent")
            return RefObjectMap(str(node), self.triples_map(parent), joins)
        return self.expression(node, ObjectMap, datatype=self.inner(node, RML + "datatypeMap", RR + "datatype"), language=self.inner(node, RML + "languageMap", RR + "language"))

    def inner(self, node, long: str, short: str) -> ExpressionMap | None:
        if (n := self.one(node, long)) is not None:
            return self.expression(n)
        c = self.one(node, short)
        return None if c is None else ExpressionMap(f"{node} {short} {c}", constant=c)


def to_turtle(maps: Iterable[TriplesMap]) -> str:
    """The mapping as Turtle; loading it gives an equal mapping."""
    lines: list[str] = [f"@prefix rr: <{RR}> .", f"@prefix rml: <{RML}> .", f"@prefix fnml: <{FNML}> .", f"@prefix ext: <{EXT}> .", f"@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> ."]
    names: dict[str, str] = {}
    todo: list[TriplesMap] = []

    def name(m: TriplesMap) -> str:
        if m.id not in names:
            names[m.id] = m.id if m.id.startswith("<") else f"_:m{len(names)}"
            todo.append(m)
        return names[m.id]

    def string(s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'

    def term(t) -> str:
        if isinstance(t, Literal):
            return string(t.value) + (f"@{t.lang}" if t.lang else f"^^<{t.datatype}>")
        return str(t) if isinstance(t, IRI) else f"_:c{t.value}" if isinstance(t, BNode) else string(str(t))

    def expression(e: ExpressionMap) -> list[str]:
        out = [f"rr:constant {term(e.constant)}"] if e.constant is not None else []
        out += [f"rml:reference {string(e.reference)}"] if e.reference is not None else []
        out += [f"rr:template {string(e.template)}"] if e.template is not None else []
        out += [f"fnml:functionValue {name(e.function)}"] if e.function is not None else []
        out += [f"rr:termType <{next(k for k, v in TERM_TYPES.items() if v == e.term_type)}>"] if e.term_type else []
        out += [f"rr:class <{c}>" for c in getattr(e, "classes", ())]
        out += [f"rr:graphMap {block(g)}" for g in getattr(e, "graphs", ())]
        for key in ("datatype", "language"):
            if (inner := getattr(e, key, None)) is not None:
                out.append(f"rml:{key}Map {block(inner)}")
        return out

    def block(e) -> str:
        if isinstance(e, RefObjectMap):
            joins = [f"rr:joinCondition [ rr:child {string(j.child)} ; rr:parent {string(j.parent)} ]" for j in e.conditions]
            return "[ " + " ; ".join([f"rr:parentTriplesMap {name(e.parent)}", *joins]) + " ]"
        return "[ " + " ; ".join(expression(e)) + " ]"

    def source(s: LogicalSource) -> str:
        parts = []
        if s.source is not None:
            src = s.source
            if src.is_stream or src.namespaces or src.stream:
                kinds = ["a ext:Stream" if src.is_stream else "a ext:FileSource"]
                kinds += [f"ext:streamName {string(src.stream)}"] if src.stream else []
                kinds += [f"ext:url {string(src.path)}"] if src.path else []
                kinds += [f"ext:declaresNamespace [ ext:namespacePrefix {string(a)} ; ext:namespaceName {string(b)} ]" for a, b in src.namespaces]
                parts.append("rml:source [ " + " ; ".join(kinds) + " ]")
            else:
                parts.append(f"rml:source {string(src.path or '')}")
        parts += [f"rml:iterator {string(s.iterator)}"] if s.iterator is not None else []
        parts += [f"rml:referenceFormulation <{s.formulation}>"] if s.formulation else []
        return "[ " + " ; ".join(parts) + " ]"

    for m in maps:
        name(m)
    while todo:
        m = todo.pop(0)
        parts = [f"rml:logicalSource {source(m.source)}"] if m.source is not None else []
        parts += [f"rr:subjectMap {block(s)}" for s in m.subjects]
        for pom in m.poms:
            inner = [f"rr:predicateMap {block(p)}" for p in pom.predicates] + [f"rr:objectMap {block(o)}" for o in pom.objects] + [f"rr:graphMap {block(g)}" for g in pom.graphs]
            parts.append("rr:predicateObjectMap [ " + " ; ".join(inner) + " ]")
        if parts:
            lines.append(f"{names[m.id]} " + " ;\n  ".join(parts) + " .")
    return "\n".join(lines) + "\n"
