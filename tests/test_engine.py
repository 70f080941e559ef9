import json

import pytest
from pyspark.sql import functions as F

from quadloom import Mapper, MappingError, fno_function, load_mapping, to_nquads, to_trig, to_turtle, write_nquads
from quadloom import streaming
from quadloom.queries import HEAD
from quadloom.sources import file_resolver, first_of, package_resolver

EX = "http://example.com/"


def lines(df):
    return sorted(r.value for r in to_nquads(df.distinct()).collect())


def mapping(source, formulation, body, iterator=""):
    it = f'; rml:iterator "{iterator}"' if iterator else ""
    return HEAD + f'<M> rml:logicalSource [ rml:source "{source}" ; rml:referenceFormulation ql:{formulation} {it} ] ; {body} .'


THINGS = 'rr:subjectMap [ rr:template "http://example.com/{id}" ; rr:class ex:T ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rml:reference "v" ] ]'


@pytest.mark.parametrize(("name", "text"), [("a.csv", 'id,v\n1,"x, ""y""\nz"\n2,""\n3,\n'), ("b.csv", "id;v\n1;x, \"\"\n"), ("c.csv", "id|v\n 1 | a;b \n")])
def test_csv(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    got = lines(Mapper(mapping(name, "CSV", THINGS), spark=spark, resolvers=[file_resolver(tmp_path)]).map())
    typed = [x for x in got if "#type" in x]
    values = [x for x in got if "/p>" in x]
    if name == "a.csv":
        assert len(typed) == 3 and values == [f'<{EX}1> <{EX}p> "x, \\"y\\"\\nz" .']
    if name == "c.csv":
        assert values == [f'<{EX}1> <{EX}p> "a;b" .']


def test_unknown_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,w\n1,2\n")
    with pytest.raises(MappingError, match="no column"):
        Mapper(mapping("a.csv", "CSV", THINGS), spark=spark, resolvers=[file_resolver(tmp_path)]).map()


def test_json_and_empty_string(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"l": [{"id": 1, "v": ""}, {"id": 2, "v": None}, {"id": 3, "v": ["a", None, "b"]}, {"v": "no id"}]}))
    m = Mapper(mapping("a.json", "JSONPath", THINGS, "$.l[*]"), spark=spark, resolvers=[file_resolver(tmp_path)])
    assert [x for x in lines(m.map()) if "/p>" in x] == [f'<{EX}1> <{EX}p> "" .', f'<{EX}3> <{EX}p> "a" .', f'<{EX}3> <{EX}p> "b" .']
    assert m.map_record([{"l": [{"id": 9}]}][0]).count() == 1


def test_xml_namespaces_and_empty(spark):
    text = HEAD + """<M> rml:logicalSource [ rml:source [ a stream:Stream ; stream:declaresNamespace [ stream:namespacePrefix "n" ; stream:namespaceName "urn:n" ] ] ;
      rml:referenceFormulation ql:XPath ; rml:iterator "/n:r/n:b" ] ; """ + THINGS.replace("{id}", "{@id}").replace('"v"', '"n:v"') + " ."
    doc = spark.createDataFrame([("<r xmlns='urn:n'><b id='1'><v>x</v></b><b id='2'><v/></b></r>",)], "value string")
    assert [x for x in lines(Mapper(text, spark=spark).map(doc)) if "/p>" in x] == [f'<{EX}1> <{EX}p> "x" .']
    with pytest.raises(MappingError, match="no stream"):
        Mapper(text, spark=spark).map()


def test_multi_condition_join_meets_on_subjects(spark):
    """Two parent rows of one subject satisfy a condition each: that is a match."""
    text = HEAD + """<C> rml:logicalSource [ rml:source [ stream:streamName "c" ] ; rml:referenceFormulation <http://quadloom.example/ns#Table> ] ;
      rr:subjectMap [ rr:template "http://example.com/c/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:to ; rr:objectMap [ rr:parentTriplesMap <P> ;
        rr:joinCondition [ rr:child "a" ; rr:parent "a" ] ; rr:joinCondition [ rr:child "b" ; rr:parent "b" ] ] ] .
    <P> rml:logicalSource [ rml:source [ stream:streamName "p" ] ; rml:referenceFormulation <http://quadloom.example/ns#Table> ] ; rr:subjectMap [ rr:template "http://example.com/p/{s}" ] ."""
    child = spark.createDataFrame([(1, "x", "y"), (2, "x", None), (3, "q", "y")], "id int, a string, b string")
    parent = spark.createDataFrame([("s", "x", "other"), ("s", "no", "y"), ("t", "x", "z")], "s string, a string, b string")
    got = lines(Mapper(text, spark=spark).map({"c": child, "p": parent}))
    assert got == [f"<{EX}c/1> <{EX}to> <{EX}p/s> ."]


def test_zip_of_unequal_lists(spark):
    text = HEAD + 'ex:M rml:logicalSource [ rml:source [ stream:streamName "s" ] ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$" ] ; rr:subjectMap [ rr:template "http://example.com/{a}/{b}" ; rr:class ex:T ] .'
    m = Mapper(text, spark=spark)
    stream = lambda d: spark.createDataFrame([(json.dumps(d),)], "value string")
    assert [x.split()[0] for x in lines(m.map({"s": stream({"a": [1, 2], "b": ["x", "é f"]})}))] == [f"<{EX}1/x>", f"<{EX}2/é%20f>"]
    assert lines(m.map({"s": stream({"a": [1, 2], "b": []})})) == []
    with pytest.raises(Exception, match="differ in number"):
        lines(m.map({"s": stream({"a": [1, 2], "b": [1]})}))


def test_function_results(spark):
    @fno_function(EX + "f", [EX + "x", EX + "xs"])
    def f(x: int, xs: list) -> list:
        return None if x is None else [x + 1, ",".join(sorted(xs)), True]

    call = "fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object ex:f ] ; rr:predicateObjectMap [ rr:predicate ex:x ; rr:objectMap [ rml:reference \"x\" ] ] ; rr:predicateObjectMap [ rr:predicate ex:xs ; rr:objectMap [ rml:reference \"xs\" ] ] ]"
    text = HEAD + f'ex:M rml:logicalSource [ rml:source [ stream:streamName "s" ] ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$" ] ; rr:subject ex:s ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ {call} ; rr:termType rr:Literal ] ] .'
    stream = spark.createDataFrame([('{"x": 4, "xs": ["b", "a", "b"]}',), ('{"xs": []}',)], "value string")
    got = lines(Mapper(text, spark=spark, functions=[f]).map({"s": stream}))
    assert got == [f'<{EX}s> <{EX}p> "{v}" .' for v in ("5", "a,b", "true")]
    with pytest.raises(MappingError, match="no function"):
        Mapper(text, spark=spark)


@pytest.mark.parametrize(
    ("body", "match"),
    [
        ('rr:subjectMap [ rr:template "{id}" ; rr:termType rr:Literal ]', "term type"),
        ('rr:subjectMap [ rr:template "{id}" ; rml:reference "id" ]', "must have one"),
        ("rr:subjectMap [ rr:class ex:T ]", "must have one"),
        ("rr:predicateObjectMap [ rr:predicate ex:p ; rr:object ex:o ]", "no subject map"),
        ('rr:subject "text"', "cannot be a constant"),
        ('rr:subjectMap [ rr:template "{id}" ; rr:termType ex:What ]', "no term type"),
        ('rr:subject ex:s ; rr:predicateObjectMap [ rr:predicate "p" ; rr:object ex:o ]', "cannot be a constant"),
        ('rr:subject ex:s ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:parentTriplesMap <Other> ] ]', "differ"),
        ('rr:subject ex:s ; rr:predicateObjectMap [ rr:predicate ex:p ]', "lacks"),
        ('rr:subjectMap [ rr:template "{id" ]', "brace"),
    ],
)
def test_errors_before_any_record(spark, body, match):
    other = '\n<Other> rml:logicalSource [ rml:source "z.json" ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$" ] ; rr:subject ex:other .'
    with pytest.raises(MappingError, match=match):
        Mapper(mapping("a.json", "JSONPath", body, "$") + other, spark=spark)


def test_errors_of_sources(spark):
    body = "rr:subject ex:s"
    with pytest.raises(MappingError, match="not found"):
        Mapper(mapping("none.json", "JSONPath", body), spark=spark).map()
    with pytest.raises(MappingError, match="no reader"):
        Mapper(mapping("none.json", "Other", body), spark=spark)
    with pytest.raises(MappingError, match="no triples map"):
        Mapper(HEAD, spark=spark)
    with pytest.raises(MappingError, match="several logical sources"):
        Mapper(mapping("a.csv", "CSV", body) + f'\n<N> rml:logicalSource [ rml:source "a.csv" ; rml:iterator "x" ; rml:referenceFormulation ql:CSV ] ; {body} .', spark=spark)


def test_resolvers(tmp_path):
    (tmp_path / "x").write_text("")
    first = first_of([file_resolver(tmp_path / "none"), file_resolver(tmp_path), package_resolver("quadloom")])
    assert first("x") == str(tmp_path / "x") and first("mapper.py").endswith("mapper.py") and first("y") is None


def test_mapping_round_trip(spark):
    from quadloom.queries import FULL

    maps = load_mapping(HEAD + "\n".join(FULL))
    again = load_mapping(to_turtle(maps))
    assert sorted(m.id for m in again) == sorted(m.id for m in maps)
    assert to_turtle(load_mapping(to_turtle(again))).count("rr:joinCondition") == 4


def test_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    df = Mapper(mapping("a.csv", "CSV", THINGS), spark=spark, resolvers=[file_resolver(tmp_path)]).map()
    write_nquads(df, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == lines(df)
    assert 'ex:p "x"' in to_trig(df, {"ex": EX})


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "id int, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/in")
    text = HEAD + f'<M> rml:logicalSource [ rml:source [ stream:streamName "s" ] ; rml:referenceFormulation <http://quadloom.example/ns#Table> ] ; {THINGS} .'
    m = Mapper(text, spark=spark, normalization=None)
    streaming.write_stream(m.map({"s": stream}), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    static = spark.read.parquet(f"{tmp_path}/in")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == lines(m.map({"s": static}))
    seen = []
    streaming.map_batches(m, stream, "s", f"{tmp_path}/ck2", lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 3
    timed = m.map({"s": stream}).withColumn("at", F.current_timestamp())
    assert streaming.distinct_within(timed, "at", "1 hour").isStreaming
