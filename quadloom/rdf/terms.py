"""Terms and namespaces of the mapping language."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class IRI:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class BNode:
    value: str

    def __str__(self) -> str:
        return f"_:{self.value}"


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = "http://www.w3.org/2001/XMLSchema#string"
    lang: str | None = None

    def __str__(self) -> str:
        return f'"{self.value}"' + (f"@{self.lang}" if self.lang else "" if self.datatype == XSD + "string" else f"^^<{self.datatype}>")


# The vocabularies.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
QL = "http://semweb.mmlab.be/ns/ql#"
FNML = "http://semweb.mmlab.be/ns/fnml#"
FNO = "https://w3id.org/function/ontology#"
OLD_FNO = "http://semweb.datasciencelab.be/ns/function#"
#: Our own vocabulary; of extension terms in other namespaces the local name counts.
EXT = "http://quadloom.example/ns#"
RDF_TYPE = RDF + "type"
KNOWN = (XSD, RDF, RR, RML, QL, FNML, FNO, OLD_FNO)


def local_name(iri: str) -> str | None:
    """The name of an extension term: what stands behind the last # or / of an IRI that is of none of the vocabularies."""
    return None if iri.startswith(KNOWN) else re.split("[#/]", iri)[-1]


class Graph:
    """Triples by subject and predicate, in the order read."""

    def __init__(self) -> None:
        self.triples: list[tuple] = []
        self.by: dict[tuple, list] = {}
        self.named: dict[str, dict] = {}

    def add(self, s, p, o) -> None:
        if isinstance(p, IRI) and (name := local_name(p.value)) is not None:
            self.named.setdefault(name, {})[p] = None
        values = self.by.setdefault((s, p), [])
        if o not in values:
            values.append(o)
            self.triples.append((s, p, o))

    def objects(self, s, p: str) -> list:
        return self.by.get((s, IRI(p)), [])

    def extended(self, s, name: str) -> list:
        """Objects of the extension terms of that local name."""
        return [o for t in self.named.get(name, ()) for o in self.by.get((s, t), [])]

    def subjects(self, p: str) -> list:
        return list(dict.fromkeys(s for s, q, _ in self.triples if q == IRI(p)))

    def update(self, other: Graph) -> None:
        for t in other.triples:
            self.add(*t)
