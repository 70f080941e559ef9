"""A reader of Turtle (and so of N-Triples), and of N-Quads lines. Runs on the driver only."""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin

from quadloom.errors import MappingError
from quadloom.rdf.terms import RDF, RDF_TYPE, XSD, BNode, Graph, IRI, Literal

TOKEN = re.compile(
    r"""
    (?P<skip>(?:\s+|\#[^\n]*)+)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*|\\U[0-9A-Fa-f]{8}[^<>"{}|^`\\\x00-\x20]*)*>)
  | (?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
  | (?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<hat>\^\^)
  | (?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
  | (?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>[.;,\[\](){}])
    """,
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_fresh = itertools.count()
# Common prefixes that documents may use without declaring them.
COMMON = {
    "rdf": RDF,
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": XSD,
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "schema": "http://schema.org/",
}


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else PLAIN.get(m[3], m[0]), s)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise MappingError(f"cannot read Turtle at: {text[at : at + 40]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, base: str):
        self.tokens, self.at, self.base = tokens(text), 0, base
        self.prefixes: dict[str, str] = dict(COMMON)
        self.graph = Graph()
        self.scope = next(_fresh)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, mark: str) -> None:
        if (t := self.next())[1] != mark:
            raise MappingError(f"cannot read Turtle: {mark!r} expected, {t[1]!r} found")

    def resolve(self, raw: str) -> str:
        iri = unescape(raw)
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
            return iri
        return self.base.split("#")[0] + iri if iri.startswith("#") or not iri else urljoin(self.base, iri)

    def parse(self) -> Graph:
        while (token := self.peek())[0] != "end":
            word = token[1].lstrip("@").lower()
            if token[0] in ("at", "word") and word in ("prefix", "base"):
                self.next()
                if word == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.next()[1][1:-1])
                else:
                    self.base = self.resolve(self.next()[1][1:-1])
                if token[0] == "at":
                    self.expect(".")
                continue
            anonymous = token[1] == "["
            subject = self.term()
            if not (anonymous and self.peek()[1] == "."):
                self.properties(subject)
            self.expect(".")
        return self.graph

    def properties(self, subject) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.next()
                predicate = IRI(RDF_TYPE)
            else:
                predicate = self.term()
            while True:
                self.graph.add(subject, predicate, self.term())
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek() == ("mark", ";"):
                self.next()
            if self.peek()[1] in (".", "]", ""):
                return

    def bnode(self, label: str | None = None) -> BNode:
        return BNode(f"g{next(_fresh)}" if label is None else f"d{self.scope}-{label}")

    def term(self):
        kind, raw = self.next()
        if kind == "iri":
            return IRI(self.resolve(raw[1:-1]))
        if kind == "name":
            prefix, _, local = raw.partition(":")
            if prefix not in self.prefixes:
                raise MappingError(f"cannot read Turtle: no prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            return self.bnode(raw[2:])
        if kind in ("long", "short"):
            value = unescape(raw[3:-3] if kind == "long" else raw[1:-1])
            if self.peek()[0] == "at":
                return Literal(value, RDF + "langString", self.next()[1][1:])
            if self.peek()[0] == "hat":
                self.next()
                return Literal(value, self.term().value)
            return Literal(value)
        if kind == "number":
            return Literal(raw, XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"))
        if raw in ("true", "false"):
            return Literal(raw, XSD + "boolean")
        if raw == "[":
            node = self.bnode()
            if self.peek()[1] != "]":
                self.properties(node)
            self.expect("]")
            return node
        if raw == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.next()
            node = IRI(RDF + "nil")
            for item in reversed(items):
                rest, node = node, self.bnode()
                self.graph.add(node, IRI(RDF + "first"), item)
                self.graph.add(node, IRI(RDF + "rest"), rest)
            return node
        raise MappingError(f"cannot read Turtle: {raw!r}")


def parse(text: str, base: str = "http://none.com/") -> Graph:
    return _Parser(text, base).parse()


def parse_quads(text: str) -> set[tuple]:
    """(s, p, o, g or None) of N-Quads lines."""
    out = set()
    for line in text.splitlines():
        if not (line := line.strip()) or line.startswith("#"):
            continue
        p = _Parser(line, "")
        terms = []
        while p.peek()[1] != ".":
            terms.append(p.term())
        out.add((*terms, None)[:4])
    return out
