"""Quads as text: a column of N-Quads lines, and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.rdf.terms import RDF, XSD


def _resource(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _escaped(c: Column) -> Column:
    for sign, text in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(sign), F.lit(text))
    return c


def nquad_column() -> Column:
    """The line of a row of quads."""
    o = F.col("object")
    literal = F.concat(F.lit('"'), _escaped(o), F.lit('"'))
    tagged = F.when(F.col("lang").isNotNull(), F.concat(literal, F.lit("@"), "lang")).when(F.col("datatype").isin(XSD + "string", RDF + "langString"), literal).otherwise(F.concat(literal, F.lit("^^<"), "datatype", F.lit(">")))
    obj = F.when(F.col("object_kind") == "literal", tagged).otherwise(_resource(o))
    graph = F.when(F.col("graph").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), _resource(F.col("graph"))))
    return F.concat(_resource(F.col("subject")), F.lit(" <"), "predicate", F.lit("> "), obj, graph, F.lit(" ."))


def to_nquads(quads: DataFrame) -> DataFrame:
    return quads.select(nquad_column().alias("value"))


def write_nquads(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_nquads(quads).write.mode(mode).text(path)


def with_default_graph(quads: DataFrame, iri: str = "urn:x-arq:DefaultGraphNode") -> DataFrame:
    """Quads where the default graph has a name, as datasets of named graphs keep it."""
    return quads.withColumn("graph", F.coalesce("graph", F.lit(iri)))


def to_trig(quads: DataFrame, prefixes: Mapping[str, str] | None = None) -> str:
    """TriG of a small result, sorted, with prefixes applied; for reading, on the driver."""
    names = dict(prefixes or {})

    def short(iri: str) -> str:
        if iri.startswith("_:"):
            return iri
        for p, ns in names.items():
            local = iri[len(ns) :]
            if iri.startswith(ns) and local.replace("_", "").replace("-", "").isalnum():
                return f"{p}:{local}"
        return f"<{iri}>"

    def obj(r) -> str:
        if r.object_kind != "literal":
            return short(r.object)
        text = '"' + r.object.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
        return text + (f"@{r.lang}" if r.lang else "" if r.datatype == XSD + "string" else f"^^{short(r.datatype)}")

    lines = [f"@prefix {p}: <{ns}> ." for p, ns in names.items()]
    by: dict[str | None, dict[str, list]] = {}
    for r in sorted(quads.distinct().collect(), key=lambda r: (r.graph or "", r.subject, r.predicate, r.object)):
        by.setdefault(r.graph, {}).setdefault(r.subject, []).append(r)
    for graph, subjects in by.items():
        body = [f"{short(s)} " + " ;\n  ".join(f"{short(r.predicate)} {obj(r)}" for r in rows) + " ." for s, rows in subjects.items()]
        lines += body if graph is None else [f"{short(graph)} {{", *body, "}"]
    return "\n".join(lines) + "\n"
