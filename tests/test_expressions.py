import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.expr import iri, jsonpath, xpath
from quadloom.expr.template import parse_template
from quadloom.rdf.terms import IRI, XSD, BNode, Literal
from quadloom.rdf.turtle import parse, parse_quads


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("", []),
        ("plain", [("text", "plain")]),
        ("a{b}c{b}", [("text", "a"), ("expr", "b"), ("text", "c"), ("expr", "b")]),
        (r"\{{x}\} \\ }", [("text", "{"), ("expr", "x"), ("text", "} \\ }")]),
        (r"{a\}b}", [("expr", "a}b")]),
    ],
)
def test_template(template, want):
    assert parse_template(template) == want


@pytest.mark.parametrize("template", ["{a", "{a{b}}", r"a\b", "\\"])
def test_bad_template(template):
    with pytest.raises(MappingError):
        parse_template(template)


def test_iri_safe(spark):
    rows = [("a b/c#%",), ("é\u20ac",), ("\ue000\t",), ("A-z_~.9",), ("",), (None,), ("😀(",)]
    got = spark.createDataFrame(rows, "v string").select(iri.iri_safe(F.col("v")), iri.iri_safe(F.col("v"), upper=False)).collect()
    assert [r[0] for r in got] == ["a%20b%2Fc%23%25", "é\u20ac", "%E000%09", "A-z_~.9", "", None, "😀%28"]
    assert got[0][1] == "a%20b%2fc%23%25"


def test_to_iri(spark):
    df = spark.createDataFrame([("http://a/b",), ("x/../y",), (None,)], "v string")
    assert [r[0] for r in df.select(iri.to_iri(F.col("v"), "http://base/", "fail")).collect()] == ["http://a/b", "http://base/x/../y", None]
    bad = spark.createDataFrame([("a b",)], "v string")
    assert bad.select(iri.to_iri(F.col("v"), "http://base/", "skip")).first()[0] is None
    with pytest.raises(Exception, match="valid IRI"):
        bad.select(iri.to_iri(F.col("v"), "http://base/", "fail")).collect()


DOC = {"a": [{"b": 1, "c": "x"}, {"b": 2.5, "c": None}, {"b": 30}], "k y": {"z": True}, "e": [], "o": {"p": {"b": 9}}, "s": "[1]"}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("a[0].b", ["1"]), ("$.a[*].b", ["1", "2.5", "30"]), ("k y.z", ["true"]), ("$['k y']['z']", ["true"]), ("@.a[1].c", []), ("e", []), ("zz", []),
        ("$..b", ["1", "2.5", "30", "9"]), ("a[?(@.b > 2)].b", ["2.5", "30"]), ("a[-1].b", ["30"]), ("a[0:2].b", ["1", "2.5"]), ("a.*.b", ["1", "2.5", "30"]), ("s", ["[1]"]),
        ("a[?(@.c == 'x' && @.b < 2)].b", ["1"]), ("a[0,2].b", ["1", "30"]),
    ],
)
def test_json_path(spark, path, want):
    assert jsonpath.values(jsonpath.parse_path(path), DOC) == want
    df = spark.createDataFrame([(json.dumps(DOC),)], "r string")
    assert df.select(jsonpath.reference(F.col("r"), path)).first()[0] == want


@pytest.mark.parametrize("path", ["$.a[", "a[?(@.b == )]", "a[x]", ""])
def test_bad_json_path(path):
    if path:
        with pytest.raises(MappingError):
            jsonpath.parse_path(path)
    else:
        assert jsonpath.parse_path(path) == []


def test_json_records(spark):
    df = spark.createDataFrame([(json.dumps(DOC),)], "d string")
    get = lambda it, unnest=False: df.select(jsonpath.records(F.col("d"), it, unnest)).first()[0]
    assert [json.loads(x) for x in get("$.a[*]")] == DOC["a"]
    assert [json.loads(x) for x in get("$")] == [DOC]
    assert [json.loads(x) for x in get("$.a")] == [DOC["a"]] and len(get("$.a", True)) == 3
    assert get("$.none[*]") == [] and get("$.e[*]") == []


XML = "<r xmlns:n='urn:n'><b id='1'><t>One</t><t>Two</t><e/></b><b id='2'><t> Three </t><n:q>Q</n:q></b></r>"


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/r/b/@id", ["1", "2"]), ("//t", ["One", "Two", " Three "]), ("/r/b[2]/t", [" Three "]), ("/r/b[@id='1']/t[last()]", ["Two"]), ("/r/b/e", []), ("//n:q", ["Q"]),
        ("tokenize('a,b', ',')", ["a", "b"]), ("count(//t)", ["3"]), ("/r/b[not(e)]/normalize-space(t)", None), ("lower-case(/r/b[1]/t[1])", ["one"]), ("/r/*/t | /r/b/@id", ["One", "Two", " Three ", "1", "2"]),
        ("/r/b/t[. = 'Two']/../@id", ["1"]), ("string-join(//t, '-')", ["One-Two- Three "]), ("/r/b/t/text()", ["One", "Two", " Three "]),
    ],
)
def test_xml_path(path, want):
    if want is None:
        with pytest.raises(MappingError):
            xpath.compile_path(path, {"n": "urn:n"})
        return
    assert xpath.values(xpath.compile_path(path, {"n": "urn:n"})(xpath.parse_document(XML))) == want


@pytest.mark.parametrize("path", ["/r/[", "x:y", "nope(a)", "a ="])
def test_bad_xml_path(path):
    with pytest.raises(MappingError):
        xpath.compile_path(path, {})


def test_turtle():
    g = parse('''@prefix ex: <http://e/> . @base <http://b/c> . PREFIX f: <http://f/>
    <#x> a ex:T ; ex:p "a\\n\\"q\\"", """long "quoted" text"""@en-GB , 1, 1.5, 2e3, true ; # comment
      ex:list ( ex:a [ f:b ex:c ] ) ; .
    [] ex:p _:n . _:n ex:q 'single'^^ex:dt .''')
    x = IRI("http://b/c#x")
    assert g.objects(x, "http://e/p") == [Literal('a\n"q"'), Literal('long "quoted" text', "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-GB"), Literal("1", XSD + "integer"), Literal("1.5", XSD + "decimal"), Literal("2e3", XSD + "double"), Literal("true", XSD + "boolean")]
    assert len(g.triples) == 15 and any(isinstance(s, BNode) for s, _, _ in g.triples)
    for bad in ("<a> <b> .", "x:y <b> <c> .", "<a> <b> <c>", '<a> <b> "x .'):
        with pytest.raises(MappingError):
            parse(bad)


@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=20))
def test_quads_round_trip(text):
    line = '<http://s> <http://p> "' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '" <http://g> .'
    if len(line.splitlines()) == 1:
        assert parse_quads(line) == {(IRI("http://s"), IRI("http://p"), Literal(text), IRI("http://g"))}
