import re
import tracemalloc

import pyarrow as pa
import pytest

from quadloom.llm import pii
from quadloom.llm.common import map_text


def test_runs_are_bounded_by_bytes(spark):
    texts = ["é" * 100_000] * 30 + [None, "", "b" * 1_500_000, "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    size = lambda texts: [len((t or "").encode()) for t in texts]
    got = map_text(df, ["i"], "text", "own long, run long", lambda texts: [size(texts), [sum(size(texts))] * len(texts)]).collect()
    assert {r.i: r.own for r in got} == dict(enumerate(size(texts))) and len(got) == len(texts)
    assert all(r.run <= max(1_000_000, r.own) for r in got)


def test_a_text_that_is_kept_goes_to_python_once(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i long, text string")
    made = map_text(df, ["text", "i"], "text", "n long", lambda texts: [[len(t or "") for t in texts]])
    assert sorted(map(tuple, made.collect()), key=lambda r: r[1]) == [("ab", 1, 2), (None, 2, 0)]
    assert "__text" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_memory_of_tagging():
    model, texts = pii.trained(), ["mail a.b at c dot org, call 555. " * 100] * 400
    tracemalloc.start()
    pii.tag(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6  # 1.3 million characters


def test_a_task_gives_its_memory_back(spark):
    df, pins = spark.createDataFrame([(1, "a")], "i long, text string"), []

    def fn(texts):
        held = [b"x" * 100_000 for _ in range(1500)]
        pins.append(b"x" * 100_000)  # stands behind them
        return [[len(held)] * len(texts)]

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
        run = map_text(df, ["i"], "text", "n long", fn)
    before = anonymous()
    (got,) = run(iter([pa.RecordBatch.from_pydict({"i": [1], "text": ["a"]})]))
    assert got.to_pydict() == {"i": [1], "n": [1500]} and anonymous() < before + 50
