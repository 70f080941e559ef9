"""More registered queries: files of every format, made from the test tables in the shared folder, and the options, errors
and aliases of the mapping language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.functions import strings
from quadloom.mapper import Mapper
from quadloom.mapping.loader import load_mapping, to_turtle
from quadloom.mapping.model import ExpressionMap
from quadloom.plans.terms import Compiler, Terms
from quadloom.queries import EX, HEAD, NATION, PART, QUERIES, SQL, SUPPLIER, TYPE, XSD, add, call, iri, join, pom, quad, streamed, subject, table, union
from quadloom.shared import new_path
from quadloom.sources import TABLE, file_resolver, first_of, package_resolver, tables_resolver
from quadloom.streaming import write_stream

Tables = Callable[[str], DataFrame]


def file(name: str, path: str, formulation: str, iterator: str, *parts: str, more: str = "") -> str:
    """A triples map over a file."""
    source = f'"{path}"' if not more else f'[ a stream:FileSource ; stream:url "{path}" ; {more} ]'
    it = f'; rml:iterator "{iterator}"' if iterator else ""
    return f"<{name}> rml:logicalSource [ rml:source {source} ; rml:referenceFormulation ql:{formulation} {it} ] ; " + " ; ".join(parts) + " ."


def add_files(name: str, write: Callable[[Tables, str], None], maps: list[str], sql: str, **options) -> None:
    """A query over files that `write` makes of the tables in a new folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = new_path(spark, "inputs")
        write(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), base)
        return Mapper(HEAD + "\n".join(maps), spark=spark, resolvers=[file_resolver(base), lambda path: f"{base}/{path}"], **options).map_to_model()

    QUERIES[name], SQL[name] = run, sql


def as_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(header=True, sep=sep, escape='"', nullValue="", emptyValue='""').csv(path)


def as_text(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.text(path)


def as_list(df: DataFrame, name: str) -> DataFrame:
    """One JSON document that lists the rows."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(name))).alias("value"))


def as_xml(nations: DataFrame) -> DataFrame:
    one = F.format_string('<nation id="%d"><!-- one --><name><![CDATA[%s]]></name><in>%d</in><none></none></nation>', "n_nationkey", "n_name", "n_regionkey")
    return nations.agg(F.concat_ws("", F.collect_list(one)).alias("x")).select(F.concat(F.lit("<world><list>"), "x", F.lit("</list></world>")).alias("value"))


# ---- CSV

add_files(
    "csv_scan",
    lambda t, base: as_csv(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), f"{base}/supplier.csv"),
    [file("S", "supplier.csv", "CSV", "", SUPPLIER, pom("ex:name", 'rml:reference "s_name"'), pom("ex:nation", 'rr:template "http://example.com/nation/{s_nationkey}"'))],
    union(quad(iri("supplier", "s_suppkey"), EX + "name", "s_name", "FROM supplier"), quad(iri("supplier", "s_suppkey"), EX + "nation", iri("nation", "s_nationkey"), "FROM supplier", kind="iri")),
)
add_files(
    "csv_delimiters",
    lambda t, base: (as_csv(t("region").select("r_regionkey", F.concat("r_name", F.lit(", "), "r_name").alias("both")), f"{base}/region.csv", ";"), as_csv(t("nation").select("n_nationkey", "n_name", "n_regionkey"), f"{base}/nation.csv", "|")),
    [file("R", "region.csv", "CSV", "", subject("http://example.com/region/{r_regionkey}"), pom("ex:both", 'rml:reference "both"')), file("N", "nation.csv", "CSV", "", NATION, pom("ex:region", 'rml:reference "n_regionkey"'))],
    union(quad(iri("region", "r_regionkey"), EX + "both", "r_name || ', ' || r_name", "FROM region"), quad(iri("nation", "n_nationkey"), EX + "region", "CAST(n_regionkey AS VARCHAR)", "FROM nation")),
)
QUOTED = "concat('say \"', p_name, '\", then\\nstop')"
add_files(
    "csv_quotes_and_lines",
    lambda t, base: as_csv(t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.expr(QUOTED)).otherwise(F.col("p_name")).alias("note")), f"{base}/part.csv"),
    [file("P", "part.csv", "CSV", "", PART, pom("ex:note", 'rml:reference "note"'))],
    union(quad(iri("part", "p_partkey"), EX + "note", "CASE WHEN p_size % 2 = 0 THEN 'say \"' || p_name || '\", then' || chr(10) || 'stop' ELSE p_name END", "FROM part")),
)
add_files(
    "csv_empty_cells",
    lambda t, base: as_csv(t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 2, F.col("p_brand")).alias("brand"), "p_type"), f"{base}/part.csv"),
    [file("P", "part.csv", "CSV", "", PART, pom("ex:brand", 'rml:reference "brand"'), pom("ex:type", 'rr:template "{p_type} {brand}" ; rr:termType rr:Literal'))],
    union(quad(iri("part", "p_partkey"), EX + "brand", "p_brand", "FROM part WHERE p_size % 3 = 2"), quad(iri("part", "p_partkey"), EX + "type", "p_type || ' ' || p_brand", "FROM part WHERE p_size % 3 = 2")),
    options={"multiline": False},
)

# ---- JSON files

add_files(
    "json_file_iterators",
    lambda t, base: as_text(t("nation").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nation"), F.collect_set("n_regionkey").alias("regions"))).alias("value")), f"{base}/world.json"),
    [file("N", "world.json", "JSONPath", "$.nation[*]", NATION, pom("ex:name", 'rml:reference "n_name"')), file("R", "world.json", "JSONPath", "$", subject("http://example.com/world"), pom("ex:region", 'rml:reference "regions"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation"), quad(f"'{EX}world'", EX + "region", "CAST(n_regionkey AS VARCHAR)", "FROM nation")),
)
add_files(
    "json_lines",
    lambda t, base: t("events").select("event_id", "event_type", F.from_json("props", "k int").alias("props")).write.json(f"{base}/events.json"),
    [file("E", "events.json", "JSONPath", "$", subject("http://example.com/event/{event_id}"), pom("ex:kind", 'rml:reference "event_type"'), pom("ex:k", 'rml:reference "props.k"'))],
    union(quad(iri("event", "event_id"), EX + "kind", "event_type", "FROM events WHERE event_type IS NOT NULL"), quad(iri("event", "event_id"), EX + "k", "props->>'$.k'", "FROM events WHERE props->>'$.k' IS NOT NULL")),
    options={"lines": True},
)
add_files(
    "json_filter",
    lambda t, base: as_text(as_list(t("nation"), "nation"), f"{base}/nation.json"),
    [file("N", "nation.json", "JSONPath", "$.nation[?(@.n_regionkey == 2)]", NATION, pom("ex:name", 'rml:reference "n_name"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation WHERE n_regionkey = 2")),
)

# ---- XML files

add_files(
    "xml_file",
    lambda t, base: as_text(as_xml(t("nation")), f"{base}/nation.xml"),
    [file("N", "nation.xml", "XPath", "/world/list/nation", subject("http://example.com/nation/{@id}"), pom("ex:name", 'rml:reference "name"'), pom("ex:none", 'rml:reference "none"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation")),
)
add_files(
    "xml_predicate",
    lambda t, base: as_text(as_xml(t("nation")), f"{base}/nation.xml"),
    [file("N", "nation.xml", "XPath", "//nation[in=3]", subject("http://example.com/nation/{@id}"), pom("ex:name", 'rml:reference "./name/text()"'))],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation WHERE n_regionkey = 3")),
)
add_files(
    "xml_namespaces",
    lambda t, base: as_text(t("region").agg(F.concat_ws("", F.collect_list(F.format_string('<r:region key="%d"><r:name>%s</r:name></r:region>', "r_regionkey", "r_name"))).alias("x")).select(F.concat(F.lit('<r:all xmlns:r="urn:regions">'), "x", F.lit("</r:all>")).alias("value")), f"{base}/region.xml"),
    [file("R", "region.xml", "XPath", "/n:all/n:region", subject("http://example.com/region/{@key}"), pom("ex:name", 'rml:reference "n:name"'), more='stream:declaresNamespace [ stream:namespacePrefix "n" ; stream:namespaceName "urn:regions" ]')],
    union(quad(iri("region", "r_regionkey"), EX + "name", "r_name", "FROM region")),
)

# ---- joins between formats

add_files(
    "join_cross_format",
    lambda t, base: (as_text(as_xml(t("nation")), f"{base}/nation.xml"), as_text(as_list(t("region"), "region"), f"{base}/region.json"), as_csv(t("customer").select("c_custkey", "c_nationkey"), f"{base}/customer.csv")),
    [
        file("N", "nation.xml", "XPath", "/world/list/nation", subject("http://example.com/nation/{@id}"), pom("ex:region", "rr:parentTriplesMap <R> ; " + join(("in", "r_regionkey")))),
        file("R", "region.json", "JSONPath", "$.region[*]", subject("http://example.com/region/{r_regionkey}")),
        file("C", "customer.csv", "CSV", "", subject("http://example.com/customer/{c_custkey}"), pom("ex:nation", "rr:parentTriplesMap <N> ; " + join(("c_nationkey", "@id")))),
    ],
    union(quad(iri("nation", "n_nationkey"), EX + "region", iri("region", "n_regionkey"), "FROM nation", kind="iri"), quad(iri("customer", "c_custkey"), EX + "nation", iri("nation", "c_nationkey"), "FROM customer JOIN nation ON c_nationkey = n_nationkey", kind="iri")),
)

# ---- records that are given, resolvers, streams

add(
    "json_record",
    [streamed("N", "given", "ql:JSONPath", "$.all", subject("http://example.com/nation/{n}"), pom("ex:name", 'rml:reference "name"'))],
    quad(f"'{EX}nation/' || n", EX + "name", "'N' || n", "FROM (SELECT unnest([1, 2]) AS n)"),
    call=lambda m, spark, sf_dir: m.map_record({"all": [{"n": 1, "name": "N1"}, {"n": 2, "name": "N2"}, None]}),
)
add(
    "xml_record",
    [streamed("N", "given", "ql:XPath", "/all/n", subject("http://example.com/nation/{@k}"), pom("ex:name", 'rml:reference "."'))],
    quad(f"'{EX}nation/' || n", EX + "name", "'N' || n", "FROM (SELECT unnest([1, 2]) AS n)"),
    call=lambda m, spark, sf_dir: m.map_record('<all><n k="1">N1</n><n k="2">N2</n></all>'),
)


def _chain(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    m.resolve = first_of([file_resolver("/none"), package_resolver("quadloom"), tables_resolver(spark, sf_dir)])
    return m.map_to_model()


add("resolver_chain", [table("N", "nation", NATION, pom("ex:name", 'rml:reference "n_name"'))], union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation")), call=_chain)
add(
    "unnamed_stream",
    [f"<N> rml:logicalSource [ rml:source [ a stream:Stream ] ; rml:referenceFormulation <{TABLE}> ] ; " + NATION + " ; " + pom("ex:name", 'rml:reference "n_name"') + " ."],
    union(quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation")),
    call=lambda m, spark, sf_dir: m.map_to_model(spark.read.parquet(f"{sf_dir}/nation.parquet")),
)


def _stream(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, base = spark.read.parquet(f"{sf_dir}/nation.parquet"), new_path(spark, "stream")
    nations.write.parquet(f"{base}/in")
    quads = m.map({"nations": spark.readStream.schema(nations.schema).parquet(f"{base}/in")})
    write_stream(quads, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.text(f"{base}/out")


add(
    "stream_nquads",
    [streamed("N", "nations", f"<{TABLE}>", "", NATION, pom("ex:name", 'rml:reference "n_name"'))],
    f"SELECT '<{EX}nation/' || n_nationkey || '> <{EX}name> \"' || n_name || '\" .' AS value FROM nation",
    call=_stream,
    normalization=None,
)

# ---- terms and templates


def _signs(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return m.map_to_model({"signs": nations.select("n_nationkey", F.concat("n_name", F.lit("éﬁ")).alias("marked"), F.concat_ws("/", "n_nationkey", "n_name").alias("path"), F.concat(F.lit("/?"), "n_name").alias("asked"))})


for form, sql in (("nfc", "nfc_normalize(n_name || 'e' || chr(769) || chr(64257))"), ("nfkc", "n_name || chr(233) || 'fi'")):
    add(f"iri_{form}", [streamed("N", "signs", f"<{TABLE}>", "", subject("http://example.com/marked/{marked}", "rr:class ex:Nation"))], union(quad(f"'{EX}marked/' || replace({sql}, ' ', '%20')", TYPE, f"'{EX}Nation'", "FROM nation", kind="iri")), call=_signs, normalization=form.upper())
for case, (slash, ask) in {"upper": ("%2F", "%3F"), "lower": ("%2f", "%3f")}.items():
    add(
        f"percent_{case}",
        [streamed("N", "signs", f"<{TABLE}>", "", subject("http://example.com/at/{path}"), pom("ex:asked", 'rr:template "http://example.com/ask{asked}"'))],
        union(quad(f"'{EX}at/' || n_nationkey || '{slash}' || replace(n_name, ' ', '%20')", EX + "asked", f"'{EX}ask{slash}{ask}' || replace(n_name, ' ', '%20')", "FROM nation", kind="iri")),
        call=_signs,
        upper_percent=case == "upper",
    )
add("template_constant", [table("N", "nation", 'rr:subjectMap [ rr:template "http://example.com/all" ]', pom("ex:key", 'rml:reference "n_nationkey"'), pom("ex:braces", 'rr:template "\\\\{\\\\}" ; rr:termType rr:Literal'))], union(quad(f"'{EX}all'", EX + "key", "CAST(n_nationkey AS VARCHAR)", "FROM nation"), quad(f"'{EX}all'", EX + "braces", "'{}'", "FROM nation")))


def _lists(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return m.map_to_model({"lists": nations.select(F.to_json(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), none).alias("keys"), F.array(none, "n_name").alias("names"))).alias("value"))})


add(
    "template_nulls_before_zip",
    [streamed("N", "lists", "ql:JSONPath", "$", NATION, pom("ex:pair", 'rr:template "{keys}:{names}" ; rr:termType rr:Literal'))],
    union(quad(iri("nation", "n_nationkey"), EX + "pair", "n_nationkey || ':' || n_name", "FROM nation")),
    call=_lists,
)


def _evens(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    even = F.col("n_nationkey") % 2 == 0
    return m.map_to_model({"evens": nations.select("*", F.when(even, F.lit("even")).alias("p"), F.when(~even, F.lit("odd")).alias("o"))})


add(
    "predicates_and_objects_missing",
    [
        streamed("N", "evens", f"<{TABLE}>", "", NATION, 'rr:predicateObjectMap [ rr:predicateMap [ rr:template "http://example.com/{p}" ] ; rr:objectMap [ rml:reference "n_name" ], [ rr:parentTriplesMap <R> ; ' + join(("n_regionkey", "r_regionkey")) + " ] ]", 'rr:predicateObjectMap [ rr:predicate ex:odd ; rr:objectMap [ rml:reference "o" ], [ rr:parentTriplesMap <R> ; ' + join(("n_regionkey", "r_regionkey")) + " ] ]"),
        table("R", "region", subject("http://example.com/region/{r_regionkey}")),
    ],
    union(
        quad(iri("nation", "n_nationkey"), EX + "even", "n_name", "FROM nation WHERE n_nationkey % 2 = 0"),
        quad(iri("nation", "n_nationkey"), EX + "even", iri("region", "n_regionkey"), "FROM nation WHERE n_nationkey % 2 = 0", kind="iri"),
        quad(iri("nation", "n_nationkey"), EX + "odd", "'odd'", "FROM nation WHERE n_nationkey % 2 = 1"),
        quad(iri("nation", "n_nationkey"), EX + "odd", iri("region", "n_regionkey"), "FROM nation", kind="iri"),
    ),
    call=_evens,
)
add("literals_validated", [table("O", "orders", subject("http://example.com/order/{o_orderkey}"), pom("ex:customer", 'rml:reference "o_custkey" ; rr:datatype xsd:integer'), pom("ex:status", 'rml:reference "o_orderstatus"'))], union(quad(iri("order", "o_orderkey"), EX + "customer", "CAST(o_custkey AS VARCHAR)", "FROM orders", datatype=f"'{XSD}integer'"), quad(iri("order", "o_orderkey"), EX + "status", "o_orderstatus", "FROM orders")), validate=True)


class Loud(Compiler):
    """Terms made in another way: literals in capitals."""

    def terms(self, e: ExpressionMap, place: str) -> Terms:
        made = super().terms(e, place)
        if place == "object" and made.one is not None and made.one.kind == "literal":
            return Terms(replace(made.one, value=F.upper(made.one.value)))
        return made


add("terms_of_own_compiler", [table("P", "part", PART, pom("ex:name", 'rml:reference "p_name"'))], union(quad(iri("part", "p_partkey"), EX + "name", "upper(p_name)", "FROM part")), compiler=Loud)

# ---- functions

CALLED = "rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object f:upper ] ; " + 'rr:predicateObjectMap [ rr:predicate f:value ; rr:objectMap [ rml:reference "n_name" ] ]'
add(
    "function_map_not_executed",
    [table("N", "nation", NATION, pom("ex:upper", "fnml:functionValue <F> ; rr:termType rr:Literal")), table("F", "nation", CALLED)],
    union(quad(iri("nation", "n_nationkey"), EX + "upper", "upper(n_name)", "FROM nation")),
    functions=[strings],
)


def _types(m: Mapper, spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.map_to_model({"brands": spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.collect_list("p_type").alias("types"))})


add(
    "function_collection",
    [streamed("B", "brands", f"<{TABLE}>", "", subject("http://example.com/brand/{p_brand}"), pom("ex:types", call("join", ("values", 'rml:reference "types"')) + " ; rr:termType rr:Literal"))],
    union(quad(f"'{EX}brand/' || replace(p_brand, '#', '%23')", EX + "types", "types", "FROM (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand)")),
    call=_types,
    functions=[strings],
)
add(
    "function_iri",
    [table("P", "part", PART, pom("ex:named", call("lower", ("value", 'rr:template "http://example.com/(x)/{p_name}" ; rr:termType rr:Literal'))))],
    union(quad(iri("part", "p_partkey"), EX + "named", "'http://example.com/(x)/' || replace(lower(p_name), ' ', '%20')", "FROM part", kind="iri")),
    functions=[strings],
)

# ---- loading

add(
    "deprecated_names",
    [
        table("N", "nation", NATION, pom("ex:name", 'stream:multiReference "n_name"'), pom("ex:pair", 'stream:multiTemplate "{n_nationkey}-{n_regionkey}" ; rr:termType rr:Literal'), pom("ex:upper", "stream:multiFunctionValue [ " + CALLED + " ] ; rr:termType rr:Literal"), pom("ex:region", 'rr:parentTriplesMap <R> ; stream:multiJoinCondition [ rr:child "n_regionkey" ; rr:parent "r_regionkey" ]')),
        table("R", "region", subject("http://example.com/region/{r_regionkey}")),
    ],
    union(
        quad(iri("nation", "n_nationkey"), EX + "name", "n_name", "FROM nation"),
        quad(iri("nation", "n_nationkey"), EX + "pair", "n_nationkey || '-' || n_regionkey", "FROM nation"),
        quad(iri("nation", "n_nationkey"), EX + "upper", "upper(n_name)", "FROM nation"),
        quad(iri("nation", "n_nationkey"), EX + "region", iri("region", "n_regionkey"), "FROM nation", kind="iri"),
    ),
    functions=[strings],
)
MERGED = [table("N", "nation", NATION, pom("ex:region", "rr:parentTriplesMap <R> ; " + join(("n_regionkey", "r_regionkey")))), table("R", "region", subject("http://example.com/region/{r_regionkey}"), pom("ex:name", 'rml:reference "r_name"'))]
MERGED_SQL = union(quad(iri("nation", "n_nationkey"), EX + "region", iri("region", "n_regionkey"), "FROM nation", kind="iri"), quad(iri("region", "r_regionkey"), EX + "name", "r_name", "FROM region"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents, written as one and read again."""
    maps = load_mapping(to_turtle(load_mapping(HEAD + MERGED[0], HEAD + MERGED[1])))
    return Mapper(maps, spark=spark, resolvers=[tables_resolver(spark, sf_dir)]).map_to_model()


QUERIES["documents_merged"], SQL["documents_merged"] = _merged, MERGED_SQL

CSV_MAP = '<M> rml:logicalSource [ rml:source "a.csv" ; rml:referenceFormulation ql:CSV ] ; '
WRONG = {
    "column unknown": table("M", "nation", subject("{none}")),
    "datatype text wrong": table("M", "nation", NATION, pom("ex:name", 'rml:reference "n_name" ; rr:datatype xsd:integer')),
    "csv read in two ways": CSV_MAP + 'rr:subject ex:s . <N> rml:logicalSource [ rml:source "a.csv" ; rml:iterator "x" ; rml:referenceFormulation ql:CSV ] ; rr:subject ex:s .',
    "formulation unknown": '<M> rml:logicalSource [ rml:source "a" ; rml:referenceFormulation ql:None ] ; rr:subject ex:s .',
    "function unknown": table("M", "nation", NATION, pom("ex:p", "fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object ex:none ] ]")),
    "iterator wrong (JSON)": file("M", "a.json", "JSONPath", "$.[", "rr:subject ex:s"),
    "iterator wrong (XML)": file("M", "a.xml", "XPath", "/a[", "rr:subject ex:s"),
    "literal as subject": table("M", "nation", 'rr:subjectMap [ rr:template "{n_name}" ; rr:termType rr:Literal ]'),
    "maps missing": "ex:a ex:b ex:c .",
    "objects missing": table("M", "nation", NATION, "rr:predicateObjectMap [ rr:predicate ex:p ]"),
    "parent without a source": table("M", "nation", NATION, pom("ex:p", "rr:parentTriplesMap <P> ; " + join(("a", "b")))) + ' <P> rr:subject ex:s .',
    "parent of another source": table("M", "nation", NATION, pom("ex:p", "rr:parentTriplesMap <P>")) + table("P", "region", "rr:subject ex:s"),
    "source missing": "<M> rml:logicalSource [ rml:referenceFormulation ql:CSV ] ; rr:subject ex:s .",
    "source named by two": '<M> rml:logicalSource [ rml:source "a", "b" ; rml:referenceFormulation ql:CSV ] ; rr:subject ex:s .',
    "stream missing": streamed("M", "none", "ql:JSONPath", "$", "rr:subject ex:s"),
    "subject missing": table("M", "nation", pom("ex:p", 'rml:reference "n_name"')),
    "term type unknown": table("M", "nation", 'rr:subjectMap [ rr:template "{n_name}" ; rr:termType ex:None ]'),
    "text expected": table("M", "nation", "rr:subjectMap [ rr:template ex:a ]"),
    "two expressions": table("M", "nation", 'rr:subjectMap [ rr:template "{n_name}" ; rml:reference "n_name" ]'),
    "two templates": table("M", "nation", 'rr:subjectMap [ rr:template "{n_name}", "{n_nationkey}" ]'),
}


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each wrong mapping raises: before any record is read, but for texts of records."""
    rows = []
    for name, text in WRONG.items():
        found = "none"
        try:
            made = Mapper(HEAD + text, spark=spark, resolvers=[tables_resolver(spark, sf_dir)], validate=True).map()
            if name == "datatype text wrong":
                made.collect()
        except MappingError:
            found = "mapping"
        except Exception as e:
            if "not a text of the type" not in str(e):
                raise
            found = "record"
        rows.append((name, found))
    return spark.createDataFrame(rows, "wrong string, found string")


QUERIES["mapping_errors"] = _errors
SQL["mapping_errors"] = " UNION ALL ".join(f"SELECT '{name}' AS wrong, '{'record' if name == 'datatype text wrong' else 'mapping'}' AS found" for name in WRONG)
