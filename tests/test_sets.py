"""Quads as a set: told apart by what differs among them, whatever statements they come from."""

import re

import pytest

from quadloom import queries
from quadloom.queries import HEAD, TABLE, pom, subject, table

DATA = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_set_hold_only_what_differs(spark):
    """One row for both predicates, without predicate, kind, datatype and graph."""
    made = plan(queries.QUERIES["multi_predicate_object"](spark, DATA))
    keys = re.findall(r"HashAggregate\(keys=\[([^]]*)\]", made)
    assert keys and all(len(k.split(",")) == 2 for k in keys)
    first = made[made.rindex("Generate inline(") :].split("\n")[0]
    assert first.count("p_name") + first.count("__bound") >= 2 and first.count("struct(") == 2


def _quads(spark, columns, rows, *parts, **options):
    streams = {f"s{i}": spark.createDataFrame(rows, columns) for i in range(len(parts))}
    maps = [f'<M{i}> rml:logicalSource [ rml:source [ a stream:Stream ; stream:streamName "s{0 if isinstance(p, str) else p[0]}" ] ; rml:referenceFormulation <{TABLE}> ] ; ' + (p if isinstance(p, str) else p[1]) + " ." for i, p in enumerate(parts)]
    m = queries.Mapper(HEAD + "\n".join(maps), spark=spark, **options)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    return key(m.map_to_model(streams)), sorted(set(key(m.map(streams)))), m.map_to_model(streams)


ROWS = [("1", "b1", "x", None), ("1", "b1", "x", "x"), ("b1", "1", "y", "x"), (None, "1", "x", "y"), ("", "", "", "")]
T = lambda t: f'rr:template "{t}"'


@pytest.mark.parametrize("layout", ["fused", "union"])
@pytest.mark.parametrize(
    "parts",
    [
        # templates that give the same subjects, beginning differently
        [subject("http://a/b{p}") + " ; " + pom("ex:p", 'rml:reference "r"'), subject("http://a/{q}") + " ; " + pom("ex:p", 'rml:reference "r"')],
        # in one source and in two, with equal and other predicates
        [subject("http://a/{p}") + " ; " + pom("ex:p", 'rml:reference "r"') + " ; " + pom("ex:q", 'rml:reference "r"') + " ; " + pom("ex:q", 'rml:reference "s"'), (1, subject("http://a/{p}") + " ; " + pom("ex:q", 'rml:reference "s"'))],
        # a constant that a template gives too; a class as an object
        [subject("http://a/{p}", "rr:class <http://a/x>") + " ; " + pom("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", T("http://a/{r}")), "rr:subject <http://a/1> ; " + pom("ex:p", 'rr:constant <http://a/x>') + " ; " + pom("ex:p", T("http://a/{s}"))],
        # predicates, datatypes, languages and graphs of the records
        [subject("http://a/{p}", f'rr:graphMap [ {T("http://g/{s}")} ]') + f' ; rr:predicateObjectMap [ rr:predicateMap [ {T("http://example.com/{s}")} ] ; rr:objectMap [ rml:reference "r" ] ] ; ' + pom("ex:x", 'rml:reference "r"'), subject("http://a/{p}") + " ; " + pom("ex:x", f'rml:reference "r" ; rml:datatypeMap [ {T("http://t/{s}")} ]') + " ; " + pom("ex:x", 'rml:reference "r" ; rr:language "en"') + " ; " + pom("ex:x", 'rml:reference "s" ; rr:language "en"')],
        # several subjects, graphs and predicates, repeated statements
        [subject("http://a/{p}") + " ; " + subject("http://a/{q}") + ' ; rr:predicateObjectMap [ rr:predicate ex:a, ex:b ; rr:objectMap [ rml:reference "r" ], [ rml:reference "s" ], [ rml:reference "r" ] ; rr:graph rr:defaultGraph, ex:all ]', subject("{p}", "rr:termType rr:BlankNode") + " ; " + pom("ex:a", 'rml:reference "r"')],
        # a join beside the same link without one
        [subject("http://a/{p}") + " ; rr:predicateObjectMap [ rr:predicate ex:to ; rr:objectMap [ rr:parentTriplesMap <M1> ; " + queries.join(("r", "r")) + " ] ] ; " + pom("ex:to", T("http://a/{q}")), (1, subject("http://a/{q}") + " ; " + pom("ex:is", 'rml:reference "r"'))],
    ],
)
def test_like_the_bag_without_repeats(spark, parts, layout):
    got, want, _ = _quads(spark, "p string, q string, r string, s string", ROWS, *parts, layout=layout)
    assert got == want and len(got) > 3


def test_more_beginnings_than_cases(spark):
    body = subject("http://a/{p}") + "".join(" ; " + pom(f"ex:p{i}", T(f"http://o{i}/{{r}}")) for i in range(20))
    got, want, _ = _quads(spark, "p string, q string, r string, s string", ROWS, body)
    assert got == want and len(got) == 60


def test_a_term_of_an_own_compiler_loses_its_beginning(spark):
    """A subclass that makes other values of terms is believed."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from quadloom.plans.terms import Compiler, Terms

    class Other(Compiler):
        def terms(self, e, place):
            made = super().terms(e, place)
            return Terms(replace(made.one, value=F.upper(made.one.value))) if place == "subject" else made

    got, want, _ = _quads(spark, "p string, q string, r string, s string", ROWS, subject("http://a/{p}") + " ; " + pom("ex:p", 'rml:reference "r"'), compiler=Other)
    assert got == want and "HTTP://A/B1" in "".join(got)


def test_predicates_are_filtered_in_sets(spark):
    m = queries.Mapper(HEAD + table("N", "nation", queries.NATION, pom("ex:name", 'rml:reference "n_name"'), 'rr:predicateObjectMap [ rr:predicateMap [ rr:template "http://example.com/{n_regionkey}" ] ; rr:objectMap [ rml:reference "n_name" ] ]'), spark=spark, resolvers=[queries.tables_resolver(spark, DATA)])
    for wanted, n in ((["http://example.com/name"], 25), (["http://example.com/3"], 5), (iter(["http://example.com/name", "http://example.com/3"]), 30), ([], 0)):
        assert m.map_to_model(predicates=wanted).count() == n


def test_files_are_dealt_over_even_pieces(spark, monkeypatch):
    """What a task gathers before the shuffle hangs on the piece, not on the blocks that the files have; one scan still."""
    for name in ("shared_source_fused", "full_kg"):
        assert "REPARTITION_BY_NUM" in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.1"))
        assert "REPARTITION_BY_NUM" not in plan(queries.QUERIES[name](spark, DATA))
    made = plan(queries.QUERIES["shared_source_fused"](spark, "/root/testdata/sf0.1"))
    scan = [line for line in made.split("\n") if "FileScan" in line]
    assert len(scan) == 1 and "l_comment" not in scan[0] and "Python" not in made

    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    whole = {name: key(queries.QUERIES[name](spark, DATA)) for name in ("multi_predicate_object", "full_kg")}
    monkeypatch.setattr("quadloom.plans.terms.PIECE", 2000)
    for name, want in whole.items():
        made = queries.QUERIES[name](spark, DATA)
        assert "REPARTITION_BY_NUM" in plan(made) and key(made) == want


def test_links_are_narrow_and_not_dealt_by_keys(spark):
    """Neither a join nor the set behind it holds what all its quads have; the set is dealt by subject and object, so that
    a key that most records have is not one task's."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, joins in (("full_kg", 4), ("join_large", 1)):
            made = plan(queries.QUERIES[name](spark, DATA))
            keys = [k.split(",") for k in re.findall(r"HashAggregate\(keys=\[([^]]*)\]", made)]
            assert keys and all(len(k) <= 3 for k in keys)
            assert made.count("SortMergeJoin") == joins
            above = [made[:at].split("Exchange hashpartitioning(")[-1].split(")")[0] for at in (m.start() for m in re.finditer("SortMergeJoin", made))]
            assert all(a.startswith("s#") and ", o#" in a for a in above)
            assert "http://" not in "".join(line for line in made.split("\n") if "Project [" in line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
