import math
import random

import numpy as np
import pytest

from quadloom.llm import topk


def brute(rows, k=20):
    vs = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (q, v) in enumerate(vs):
        if q is not None and q % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(vs) if a != b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in topk.op9_topk(spark, str(tmp_path)).collect())


def test_like_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "PART", 40)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 700)
    monkeypatch.setattr(topk, "ROWS", 3)
    monkeypatch.setattr(topk, "PACKET", 7)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)] + [(20, [0.25] * 6), (40, None), (60, [1.0, None]), (80, [float("nan")]), (100, [float("inf")]), (120, []), (140, [1.0, 2.0])]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_few_and_none(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(20, [1.0]), (3, [2.0]), (5, [-1e6])]) == [(20, 1, 3, 8192), (20, 2, 5, -4096000000)]
    assert run(spark, tmp_path / "b", []) == []
    assert run(spark, tmp_path / "c", [(20, None)]) == []


def test_large_components(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-10**6, 10**6)) for _ in range(8)]) for i in range(400)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_scores_at_the_edge_of_a_long(spark):
    big = 3_037_000_499  # its square is just below 2^63
    rows = [(0, [big, 0]), (1, [big, 0]), (2, [-big, 0]), (3, [1, 5]), (4, [2**62, 0]), (5, [-(2**63), 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asks = lambda rows: [tuple(r) for r in topk.top_k(df.where(rows), topk.F.col("vec_id") == 0, 20).collect()]
    assert asks("vec_id < 4") == [(0, 1, 1, big * big), (0, 2, 3, big), (0, 3, 2, -big * big)]
    with pytest.raises(Exception, match="beyond a 64-bit integer"):
        asks("vec_id < 5")
    small = spark.createDataFrame([(0, [1, 0]), (1, [2**62, 0]), (2, [-(2**63), 0])], "vec_id long, v array<long>")
    assert [r.score for r in topk.top_k(small, topk.F.col("vec_id") == 0, 20).collect()] == [2**62, -(2**63)]
    with pytest.raises(Exception, match="beyond a 64-bit integer"):
        spark.createDataFrame([([1e300],)], "e array<double>").select(topk.F.transform("e", topk.whole)).collect()


def test_null_ids_and_ties(spark):
    df = spark.createDataFrame([(None, [1, 1], 9), (20, [1, 1], 9), (7, [1, 1], 9), (7, [1, 1], 9), (8, [0], 9)], "vec_id long, v array<long>, score long")
    got = [tuple(r) for r in topk.top_k(df, topk.F.col("vec_id") % 20 == 0, 3).collect()]
    assert got == [(20, 1, 7, 2), (20, 2, 7, 2), (20, 3, None, 2)]
    assert np.array_equal(topk.first_k(np.array([0, 0, 1]), np.array([5, 5, -1]), np.array([9, 3, 1]), 1), [1, 2])
