"""Every registered mapping query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quadloom import queries, queries_files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries_files.QUERIES))
def test_like_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in got.select(*want.columns).collect()) == key(want.fetchall())


def test_scans_and_plans(spark):
    plan = lambda name: queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    fused = plan("shared_source_fused")
    assert fused.count("FileScan") == 1 and "Python" not in fused and "ArrowEval" not in fused
    assert plan("predicate_filter").count("FileScan") == 1
    assert "l_comment" not in fused and "Cartesian" not in plan("join_multi_condition")


def test_values_are_bound_once(spark):
    """However many statements use a template or a reference, the plan makes it once."""
    for name in ("shared_source_fused", "full_kg"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(http://example.com/line/") == (1 if name == "shared_source_fused" else 2)  # scanned for its quads, and for its join
        assert "RLIKE" not in plan and "raise_error" not in plan


def test_json_keys_are_read_in_one_go(spark):
    body = queries.subject("http://example.com/{a}") + "".join(" ; " + queries.pom(f"ex:{k}", f'rml:reference "{k}"') for k in "abcd")
    m = queries.Mapper(queries.HEAD + queries.streamed("M", "s", "ql:JSONPath", "$", body), spark=spark)
    made = m.map({"s": spark.createDataFrame([('{"a": 1, "b": "x", "c": ["y", "z"], "d": null}',)], "value string")})
    assert made._jdf.queryExecution().optimizedPlan().toString().count("json_tuple(") == 1
    assert sorted(r.object for r in made.collect()) == ["1", "x", "y", "z"]
