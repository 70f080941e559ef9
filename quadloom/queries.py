"""Mappings over the test tables, one for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import fno_function, strings
from quadloom.mapper import Mapper
from quadloom.rdf.nquads import to_nquads, with_default_graph
from quadloom.rdf.terms import EXT
from quadloom.sources import TABLE, tables_resolver

EX = "http://example.com/"
HEAD = f"""@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix fnml: <http://semweb.mmlab.be/ns/fnml#> .
@prefix fno: <https://w3id.org/function/ontology#> .
@prefix stream: <{EXT}> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix f: <{strings.EX}> .
@prefix ex: <{EX}> .
@base <{EX}map/> .
"""
XSD = "http://www.w3.org/2001/XMLSchema#"
LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(name: str, source: str, *parts: str) -> str:
    """A triples map over a table."""
    return f'<{name}> rml:logicalSource [ rml:source "{source}" ; rml:referenceFormulation <{TABLE}> ] ; ' + " ; ".join(parts) + " ."


def streamed(name: str, stream: str, formulation: str, iterator: str, *parts: str) -> str:
    return f'<{name}> rml:logicalSource [ rml:source [ a stream:Stream ; stream:streamName "{stream}" ] ; rml:referenceFormulation {formulation} ; rml:iterator "{iterator}" ] ; ' + " ; ".join(parts) + " ."


def subject(template: str, more: str = "") -> str:
    return f'rr:subjectMap [ rr:template "{template}" {"; " + more if more else ""} ]'


def pom(predicate: str, obj: str, more: str = "") -> str:
    return f"rr:predicateObjectMap [ rr:predicate {predicate} ; rr:objectMap [ {obj} ] {'; ' + more if more else ''} ]"


def mapper(spark: SparkSession, sf_dir: str, *maps: str, **options) -> Mapper:
    return Mapper(HEAD + "\n".join(maps), spark=spark, resolvers=[tables_resolver(spark, sf_dir)], **options)


def quad(s: str, p: str, o: str, rest: str, *, kind: str = "literal", datatype: str | None = f"'{XSD}string'", lang: str = "NULL", graph: str = "NULL") -> str:
    """One SELECT of quads; s, o, datatype, lang, graph: SQL; p: an IRI; rest: FROM and so on."""
    datatype = "NULL" if kind != "literal" or datatype is None else datatype
    return f"SELECT {s} AS subject, '{p}' AS predicate, {o} AS object, '{kind}' AS object_kind, CAST({datatype} AS VARCHAR) AS datatype, CAST({lang} AS VARCHAR) AS lang, CAST({graph} AS VARCHAR) AS graph {rest}"


def union(*parts: str, all_: bool = False) -> str:
    return (" UNION ALL " if all_ else " UNION ").join(parts) if len(parts) > 1 or all_ else f"SELECT DISTINCT * FROM ({parts[0]})"


def iri(kind: str, column: str) -> str:
    return f"'{EX}{kind}/' || {column}"


def add(name: str, maps: list[str], sql: str, *, call: Callable[[Mapper, SparkSession, str], DataFrame] | None = None, **options) -> None:
    run = call or (lambda m, spark, sf_dir: m.map_to_model())
    QUERIES[name] = lambda spark, sf_dir: run(mapper(spark, sf_dir, *maps, **options), spark, sf_dir)
    SQL[name] = sql


CUSTOMER = subject("http://example.com/customer/{c_custkey}", "rr:class ex:Customer")
PART = subject("http://example.com/part/{p_partkey}")
NATION = subject("http://example.com/nation/{n_nationkey}")
SUPPLIER = subject("http://example.com/supplier/{s_suppkey}")
ORDER = subject("http://example.com/order/{o_orderkey}")

add("table_subject_class", [table("C", "customer", CUSTOMER)], union(quad(iri("customer", "c_custkey"), TYPE, f"'{EX}Customer'", "FROM customer", kind="iri")))
add("reference_literal", [table("P", "part", PART, pom("ex:name", 'rml:reference "p_name"'))], union(quad(iri("part", "p_partkey"), EX + "name", "p_name", "FROM part")))
add(
    "template_iri_safe",
    [table("P", "part", subject("http://example.com/named/{p_name}"), pom("ex:brand", 'rr:template "http://example.com/brand/{p_brand}"'))],
    union(quad(f"'{EX}named/' || replace(p_name, ' ', '%20')", EX + "brand", f"'{EX}brand/' || replace(p_brand, '#', '%23')", "FROM part", kind="iri")),
)
add("template_literal", [table("S", "supplier", SUPPLIER, pom("ex:label", 'rr:template "{s_name} \\\\{{s_nationkey}\\\\}" ; rr:termType rr:Literal'))], union(quad(iri("supplier", "s_suppkey"), EX + "label", "s_name || ' {' || s_nationkey || '}'", "FROM supplier")))
add(
    "template_bnode",
    [table("S", "supplier", subject("{s_name} {s_nationkey}", "rr:termType rr:BlankNode"), pom("ex:at", 'rr:template "n {s_nationkey}" ; rr:termType rr:BlankNode'))],
    union(quad("'_:' || regexp_replace(s_name || ' ' || s_nationkey, '[^a-zA-Z_0-9-]+', '', 'g')", EX + "at", "'_:n' || s_nationkey", "FROM supplier", kind="bnode")),
)
add(
    "constant_shorthand",
    [table("R", "region", "rr:subject ex:world", 'rr:predicateObjectMap [ rr:predicate ex:has ; rr:object "region", ex:region ]', pom("ex:name", 'rml:reference "r_name"'))],
    union(quad(f"'{EX}world'", EX + "has", "'region'", "FROM region"), quad(f"'{EX}world'", EX + "has", f"'{EX}region'", "FROM region", kind="iri"), quad(f"'{EX}world'", EX + "name", "r_name", "FROM region")),
)
add("datatype_const", [table("O", "orders", ORDER, pom("ex:customer", 'rml:reference "o_custkey" ; rr:datatype xsd:integer'))], union(quad(iri("order", "o_orderkey"), EX + "customer", "CAST(o_custkey AS VARCHAR)", "FROM orders", datatype=f"'{XSD}integer'")))
add(
    "datatype_map",
    [table("O", "orders", ORDER, pom("ex:priority", 'rml:reference "o_orderpriority" ; rml:datatypeMap [ rr:template "http://example.com/type/{o_orderstatus}" ]'))],
    union(quad(iri("order", "o_orderkey"), EX + "priority", "o_orderpriority", "FROM orders", datatype=f"'{EX}type/' || o_orderstatus")),
)
add(
    "language_map",
    [table("D", "documents", subject("http://example.com/document/{doc_id}"), pom("ex:source", 'rml:reference "source" ; rml:languageMap [ rml:reference "lang" ]'))],
    union(quad(iri("document", "doc_id"), EX + "source", "source", "FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL", datatype=f"'{LANG}'", lang="lang")),
)
add("language_const", [table("R", "region", subject("http://example.com/region/{r_regionkey}"), pom("ex:name", 'rml:reference "r_name" ; rr:language "en-us"'))], union(quad(iri("region", "r_regionkey"), EX + "name", "r_name", "FROM region", datatype=f"'{LANG}'", lang="'en-us'")))
IN_REGION = 'rr:graphMap [ rr:template "http://example.com/region/{n_regionkey}" ]'
add(
    "graph_subject",
    [table("N", "nation", subject("http://example.com/nation/{n_nationkey}", "rr:class ex:Nation ; " + IN_REGION), pom("ex:name", 'rml:reference "n_name"'))],
    union(
        quad(iri("nation", "n_nationkey"), TYPE, f"'{EX}Nation'", "FROM nation", kind="iri", graph=iri("region", "n_regionkey")),
        quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation", graph=iri("region", "n_regionkey")),
    ),
)
add(
    "graph_pom_union",
    [table("N", "nation", subject("http://example.com/nation/{n_nationkey}", "rr:class ex:Nation ; rr:graph ex:all"), pom("ex:name", 'rml:reference "n_name"', IN_REGION))],
    union(
        quad(iri("nation", "n_nationkey"), TYPE, f"'{EX}Nation'", "FROM nation", kind="iri", graph=f"'{EX}all'"),
        quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation", graph=f"'{EX}all'"),
        quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation", graph=iri("region", "n_regionkey")),
    ),
)
add(
    "default_graph",
    [table("N", "nation", NATION, pom("ex:name", 'rml:reference "n_name"', "rr:graph rr:defaultGraph, ex:all"))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation"), quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation", graph=f"'{EX}all'")),
)
add(
    "multi_predicate_object",
    [table("P", "part", PART, 'rr:predicateObjectMap [ rr:predicate ex:a, ex:b ; rr:objectMap [ rml:reference "p_name" ], [ rml:reference "p_type" ] ]')],
    union(*(quad(iri("part", "p_partkey"), EX + p, c, "FROM part") for p in "ab" for c in ("p_name", "p_type"))),
)
add(
    "multi_subject_map",
    [table("N", "nation", NATION, subject("http://example.com/land/{n_name}", "rr:graph ex:lands"), pom("ex:region", 'rml:reference "n_regionkey"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "region", "CAST(n_regionkey AS VARCHAR)", "FROM nation"), quad(f"'{EX}land/' || replace(n_name, ' ', '%20')", EX + "region", "CAST(n_regionkey AS VARCHAR)", "FROM nation", graph=f"'{EX}lands'")),
)
add(
    "joinless_ref",
    [table("C", "customer", CUSTOMER, pom("ex:segment", "rr:parentTriplesMap <G>")), table("G", "customer", subject("http://example.com/segment/{c_mktsegment}", "rr:class ex:Segment"))],
    union(
        quad(iri("customer", "c_custkey"), TYPE, f"'{EX}Customer'", "FROM customer", kind="iri"),
        quad(iri("customer", "c_custkey"), EX + "segment", iri("segment", "c_mktsegment"), "FROM customer", kind="iri"),
        quad(iri("segment", "c_mktsegment"), TYPE, f"'{EX}Segment'", "FROM customer", kind="iri"),
    ),
)
join = lambda *on: "; ".join(f'rr:joinCondition [ rr:child "{a}" ; rr:parent "{b}" ]' for a, b in on)
add(
    "join_single",
    [table("C", "customer", subject("http://example.com/customer/{c_custkey}"), pom("ex:nation", "rr:parentTriplesMap <N> ; " + join(("c_nationkey", "n_nationkey")))), table("N", "nation", NATION)],
    union(quad(iri("customer", "c_custkey"), EX + "nation", iri("nation", "n_nationkey"), "FROM customer JOIN nation ON c_nationkey = n_nationkey", kind="iri")),
)
add(
    "join_large",
    [table("L", "lineitem", subject("http://example.com/line/{l_orderkey}-{l_linenumber}"), pom("ex:order", "rr:parentTriplesMap <O> ; " + join(("l_orderkey", "o_orderkey")))), table("O", "orders", ORDER)],
    union(quad("'http://example.com/line/' || l_orderkey || '-' || l_linenumber", EX + "order", iri("order", "o_orderkey"), "FROM lineitem JOIN orders ON l_orderkey = o_orderkey", kind="iri")),
)
add(
    "join_multi_condition",
    [table("C", "customer", subject("http://example.com/customer/{c_custkey}"), pom("ex:near", "rr:parentTriplesMap <S> ; " + join(("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")))), table("S", "supplier", subject("http://example.com/nation/{s_nationkey}"))],
    union(quad(iri("customer", "c_custkey"), EX + "near", iri("nation", "a.s_nationkey"), "FROM customer JOIN supplier a ON c_nationkey = a.s_nationkey JOIN supplier b ON c_custkey = b.s_suppkey AND a.s_nationkey = b.s_nationkey", kind="iri")),
)


def _brands(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return m.map_to_model({"brands": parts.groupBy("p_brand").agg(F.collect_set("p_partkey").alias("parts"))})


add(
    "join_multivalued",
    [streamed("B", "brands", f"<{TABLE}>", "", subject("http://example.com/brand/{p_brand}"), pom("ex:by", "rr:parentTriplesMap <S> ; " + join(("parts", "s_suppkey")))), table("S", "supplier", SUPPLIER)],
    union(quad(f"'{EX}brand/' || replace(p_brand, '#', '%23')", EX + "by", iri("supplier", "s_suppkey"), "FROM part JOIN supplier ON p_partkey = s_suppkey", kind="iri")),
    call=_brands,
)


def _events(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return m.map_to_model({"events": events.select(F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props"))).alias("value"))})


add(
    "json_reference",
    [streamed("E", "events", "ql:JSONPath", "$", subject("http://example.com/event/{event_id}"), pom("ex:k", 'rml:reference "$.props.k" ; rr:datatype xsd:integer'), pom("ex:kind", 'rml:reference "event_type"'))],
    union(
        quad(iri("event", "event_id"), EX + "k", "props->>'$.k'", "FROM events WHERE props->>'$.k' IS NOT NULL", datatype=f"'{XSD}integer'"),
        quad(iri("event", "event_id"), EX + "kind", "event_type", "FROM events WHERE event_type IS NOT NULL"),
    ),
    call=_events,
)


def _talks(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    whole = F.struct("conv_id", "turns", F.col("turns.turn").alias("numbers"), F.col("turns.role").alias("roles"))
    return m.map_to_model({"talks": turns.select(F.to_json(whole).alias("value"))})


add(
    "json_iterator",
    [streamed("T", "talks", "ql:JSONPath", "$.turns[*]", subject("http://example.com/turn/{turn}"), pom("ex:role", 'rml:reference "role"'))],
    union(quad(iri("turn", "turn"), EX + "role", "role", "FROM conversations WHERE role IS NOT NULL")),
    call=_talks,
)
add(
    "multi_valued_template_zip",
    [streamed("T", "talks", "ql:JSONPath", "$", subject("http://example.com/talk/{conv_id}"), pom("ex:turn", 'rr:template "{numbers}:{roles}" ; rr:termType rr:Literal'))],
    union(quad(iri("talk", "conv_id"), EX + "turn", "turn || ':' || role", "FROM conversations")),
    call=_talks,
)
add(
    "multi_valued_reference",
    [streamed("T", "talks", "ql:JSONPath", "$", subject("http://example.com/talk/{conv_id}"), pom("ex:number", 'rml:reference "$.turns[*].turn" ; rr:datatype xsd:integer'))],
    union(quad(iri("talk", "conv_id"), EX + "number", "CAST(turn AS VARCHAR)", "FROM conversations", datatype=f"'{XSD}integer'")),
    call=_talks,
)


def _xml(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nations.groupBy("n_regionkey").agg(F.concat_ws("", F.collect_list(F.format_string('<nation id="%d"><name>%s</name><none/></nation>', "n_nationkey", "n_name"))).alias("x"))
    return m.map_to_model({"nations": rows.select(F.concat(F.lit("<region><list>"), "x", F.lit("</list></region>")).alias("value"))})


add(
    "xml_iterator",
    [streamed("N", "nations", "ql:XPath", "/region/list/nation", subject("http://example.com/nation/{@id}"), pom("ex:name", 'rml:reference "./name"'), pom("ex:lower", 'rml:reference "lower-case(name)"'), pom("ex:none", 'rml:reference "none"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation"), quad(iri("nation", "n_nationkey"), EX + "lower", "lower(n_name)", "FROM nation")),
    call=_xml,
)


def call(function: str, *params: tuple[str, str]) -> str:
    """A function value."""
    inner = "; ".join(f"rr:predicateObjectMap [ rr:predicate f:{p} ; rr:objectMap [ {o} ] ]" for p, o in params)
    return f"fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object f:{function} ] ; {inner} ]"


add("function_scalar", [table("P", "part", PART, pom("ex:upper", call("upper", ("value", 'rml:reference "p_name"')) + " ; rr:termType rr:Literal"))], union(quad(iri("part", "p_partkey"), EX + "upper", "upper(p_name)", "FROM part")), functions=[strings])
add(
    "function_list",
    [table("P", "part", PART, pom("ex:word", call("split", ("value", 'rml:reference "p_name"'), ("by", 'rr:constant " "')) + " ; rr:termType rr:Literal"))],
    union(quad(iri("part", "p_partkey"), EX + "word", "w", "FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")),
    functions=[strings],
)
add(
    "function_nested",
    [table("P", "part", PART, pom("ex:code", call("lower", ("value", call("latinOnly", ("value", 'rml:reference "p_brand"')) + " ; rr:termType rr:Literal")) + " ; rr:termType rr:Literal"))],
    union(quad(iri("part", "p_partkey"), EX + "code", "lower(replace(p_brand, '#', ''))", "FROM part")),
    functions=[strings],
)
add(
    "function_null",
    [table("P", "part", PART, pom("ex:total", call("sum", ("a", 'rml:reference "p_size"')) + " ; rr:termType rr:Literal"), pom("ex:twice", call("sum", ("a", 'rml:reference "p_size"'), ("b", 'rml:reference "p_size"')) + " ; rr:termType rr:Literal ; rr:datatype xsd:integer"))],
    union(quad(iri("part", "p_partkey"), EX + "twice", "CAST(2 * p_size AS VARCHAR)", "FROM part", datatype=f"'{XSD}integer'")),
    functions=[strings],
)


@fno_function(strings.EX + "initials", [strings.EX + "value"])
def initials(value: str) -> list:
    return None if value is None else [w[0] for w in value.split()]


add(
    "function_python",
    [table("P", "part", PART, pom("ex:initial", call("initials", ("value", 'rml:reference "p_name"')) + " ; rr:termType rr:Literal"))],
    union(quad(iri("part", "p_partkey"), EX + "initial", "w[1]", "FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")),
    functions=[initials],
)


def _labelled(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return m.map_to_model({"labelled": docs.select("doc_id").join(labels, "doc_id", "left")})


add(
    "null_propagation",
    [streamed("D", "labelled", f"<{TABLE}>", "", subject("http://example.com/document/{doc_id}"), pom("ex:quality", 'rml:reference "quality"'), pom("ex:toxic", 'rr:template "http://example.com/toxic/{toxic}"'))],
    union(
        quad(iri("document", "doc_id"), EX + "quality", "CAST(quality AS VARCHAR)", "FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"),
        quad(iri("document", "doc_id"), EX + "toxic", iri("toxic", "toxic"), "FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL", kind="iri"),
    ),
    call=_labelled,
)
add(
    "triples_map_filter",
    [table("N", "nation", NATION, pom("ex:name", 'rml:reference "n_name"'), pom("ex:region", "rr:parentTriplesMap <R> ; " + join(("n_regionkey", "r_regionkey")))), table("R", "region", subject("http://example.com/region/{r_regionkey}"), pom("ex:name", 'rml:reference "r_name"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation")),
    call=lambda m, spark, sf_dir: m.map_to_model(triples_maps=[EX + "map/N"]),
)
LINE = subject("http://example.com/flag/{l_returnflag}")
add("union_bag", [table("L", "lineitem", LINE, pom("ex:status", 'rml:reference "l_linestatus"'))], union(quad(iri("flag", "l_returnflag"), EX + "status", "l_linestatus", "FROM lineitem"), all_=True), call=lambda m, spark, sf_dir: m.map())
add("model_distinct", [table("L", "lineitem", LINE, pom("ex:status", 'rml:reference "l_linestatus"'))], union(quad(iri("flag", "l_returnflag"), EX + "status", "l_linestatus", "FROM lineitem")))
SHARED = [
    table("L", "lineitem", subject("http://example.com/line/{l_orderkey}-{l_linenumber}", "rr:class ex:Line"), pom("ex:part", 'rr:template "http://example.com/part/{l_partkey}"'), pom("ex:status", 'rml:reference "l_linestatus"')),
    table("P", "lineitem", subject("http://example.com/part/{l_partkey}"), pom("ex:supplier", 'rr:template "http://example.com/supplier/{l_suppkey}"')),
]
AT_LINE = "'http://example.com/line/' || l_orderkey || '-' || l_linenumber"
add(
    "shared_source_fused",
    SHARED,
    union(
        quad(AT_LINE, TYPE, f"'{EX}Line'", "FROM lineitem", kind="iri"),
        quad(AT_LINE, EX + "part", iri("part", "l_partkey"), "FROM lineitem", kind="iri"),
        quad(AT_LINE, EX + "status", "l_linestatus", "FROM lineitem"),
        quad(iri("part", "l_partkey"), EX + "supplier", iri("supplier", "l_suppkey"), "FROM lineitem", kind="iri"),
    ),
)
add("predicate_filter", SHARED, union(quad(iri("part", "l_partkey"), EX + "supplier", iri("supplier", "l_suppkey"), "FROM lineitem", kind="iri")), call=lambda m, spark, sf_dir: m.map_to_model(predicates=[EX + "supplier"]))
add("base_iri_relative", [table("S", "supplier", 'rr:subjectMap [ rml:reference "s_name" ]', pom("ex:key", 'rml:reference "s_suppkey"'))], union(quad("'http://base.example/' || s_name", EX + "key", "CAST(s_suppkey AS VARCHAR)", "FROM supplier")), base_iri="http://base.example/")
add("skip_invalid_iri", [table("P", "part", 'rr:subjectMap [ rml:reference "p_name" ]', pom("ex:brand", 'rml:reference "p_brand"')), table("B", "part", 'rr:subjectMap [ rml:reference "p_brand" ]', pom("ex:size", 'rml:reference "p_size"'))], union(quad("'http://example.com/base/' || p_brand", EX + "size", "CAST(p_size AS VARCHAR)", "FROM part"), quad("'http://example.com/base/' || p_name", EX + "brand", "p_brand", "FROM part WHERE p_name NOT LIKE '% %'")), on_error="skip")
add(
    "map_record",
    [table("N", "nation", NATION, pom("ex:name", 'rml:reference "n_name"'), pom("ex:none", 'rml:reference "n_none"'))],
    quad(f"'{EX}nation/7'", EX + "name", "'Given'", ""),
    call=lambda m, spark, sf_dir: m.map_record({"n_nationkey": 7, "n_name": "Given", "n_none": None}),
)
add(
    "nquads_lines",
    [table("N", "nation", subject("http://example.com/nation/{n_nationkey}", IN_REGION), pom("ex:name", 'rml:reference "n_name" ; rr:language "en"'))],
    f"SELECT '<{EX}nation/' || n_nationkey || '> <{EX}name> \"' || n_name || '\"@en <{EX}region/' || n_regionkey || '> .' AS value FROM nation",
    call=lambda m, spark, sf_dir: to_nquads(m.map_to_model()),
)
add(
    "dataset_default_graph",
    [table("N", "nation", NATION, pom("ex:name", 'rml:reference "n_name"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation", graph="'urn:x-arq:DefaultGraphNode'")),
    call=lambda m, spark, sf_dir: with_default_graph(m.map_to_model()),
)

FULL = [
    table("R", "region", subject("http://example.com/region/{r_regionkey}", "rr:class ex:Region"), pom("ex:name", 'rml:reference "r_name"')),
    table("N", "nation", subject("http://example.com/nation/{n_nationkey}", "rr:class ex:Nation"), pom("ex:name", 'rml:reference "n_name"'), pom("ex:region", "rr:parentTriplesMap <R> ; " + join(("n_regionkey", "r_regionkey")))),
    table("C", "customer", CUSTOMER, pom("ex:segment", 'rml:reference "c_mktsegment"'), pom("ex:nation", "rr:parentTriplesMap <N> ; " + join(("c_nationkey", "n_nationkey")))),
    table("O", "orders", subject("http://example.com/order/{o_orderkey}", "rr:class ex:Order"), pom("ex:status", 'rml:reference "o_orderstatus"'), pom("ex:customer", "rr:parentTriplesMap <C> ; " + join(("o_custkey", "c_custkey")))),
    table("L", "lineitem", subject("http://example.com/line/{l_orderkey}-{l_linenumber}", "rr:class ex:Line"), pom("ex:order", "rr:parentTriplesMap <O> ; " + join(("l_orderkey", "o_orderkey"))), pom("ex:part", 'rr:template "http://example.com/part/{l_partkey}"')),
]
add(
    "full_kg",
    FULL,
    union(
        quad(iri("region", "r_regionkey"), TYPE, f"'{EX}Region'", "FROM region", kind="iri"),
        quad(iri("region", "r_regionkey"), EX + "name", "r_name", "FROM region"),
        quad(iri("nation", "n_nationkey"), TYPE, f"'{EX}Nation'", "FROM nation", kind="iri"),
        quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation"),
        quad(iri("nation", "n_nationkey"), EX + "region", iri("region", "r_regionkey"), "FROM nation JOIN region ON n_regionkey = r_regionkey", kind="iri"),
        quad(iri("customer", "c_custkey"), TYPE, f"'{EX}Customer'", "FROM customer", kind="iri"),
        quad(iri("customer", "c_custkey"), EX + "segment", "c_mktsegment", "FROM customer"),
        quad(iri("customer", "c_custkey"), EX + "nation", iri("nation", "n_nationkey"), "FROM customer JOIN nation ON c_nationkey = n_nationkey", kind="iri"),
        quad(iri("order", "o_orderkey"), TYPE, f"'{EX}Order'", "FROM orders", kind="iri"),
        quad(iri("order", "o_orderkey"), EX + "status", "o_orderstatus", "FROM orders"),
        quad(iri("order", "o_orderkey"), EX + "customer", iri("customer", "c_custkey"), "FROM orders JOIN customer ON o_custkey = c_custkey", kind="iri"),
        quad(AT_LINE, TYPE, f"'{EX}Line'", "FROM lineitem", kind="iri"),
        quad(AT_LINE, EX + "order", iri("order", "o_orderkey"), "FROM lineitem JOIN orders ON l_orderkey = o_orderkey", kind="iri"),
        quad(AT_LINE, EX + "part", iri("part", "l_partkey"), "FROM lineitem", kind="iri"),
    ),
)
