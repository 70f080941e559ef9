import math
import random

import numpy as np
import pytest

from quadloom.llm import resampling as res


def test_counts_and_threshold(spark):
    texts = ["abcabc", "", "ab", "xyz é", None, "abc" * 1000]
    df = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text string, target boolean")
    raw, target = res.counts(df)
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    every = [(t or "").encode() for t in texts]
    assert raw.sum() == sum(len(grams(t)) for t in every) and target.sum() == sum(len(grams(t)) for t in every[::2])
    code, owner = res.codes([b"abc", b"abcd"])
    assert owner.tolist() == [0, 1, 1] and code[0] == code[1] != code[2]
    values = [random.Random(1).gauss(0, 10) for _ in range(5000)] + [1.5] * 300
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 7, 2500, 5300):
        assert res.kth_highest(scores, k) == sorted(values, reverse=True)[k - 1]


def test_gumbel(spark):
    g = np.array([r.g for r in spark.range(20000).select(res.gumbel(res.F.col("id")).alias("g")).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.std() - 1.2825) < 0.03 and len(set(g.tolist())) == 20000


def test_like_brute_force(spark, tmp_path):
    """Weights, scores and verdicts again, document by document and gram by gram."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abc d" if i % 3 else "#$x?", k=rng.randint(0, 80)))) for i in range(120)] + [(200, None), (201, "é"), (3, "abc abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120) if i % 3 == 1], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bucket = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 18
    grams = lambda t: [bucket(t[i : i + 3]) for i in range(len(t) - 2)] if t else []
    of = {k: grams((t or "").encode()) for k, (_, t) in enumerate(rows)}
    is_target = [i % 3 == 1 and i < 120 for i, _ in rows]
    raw, target = [0] * res.BUCKETS, [0] * res.BUCKETS
    for k, found in of.items():
        for b in found:
            raw[b] += 1
            target[b] += is_target[k]
    ratio = lambda b: math.log((target[b] + 0.5) / (sum(target) + 0.5 * res.BUCKETS)) - math.log((raw[b] + 0.5) / (sum(raw) + 0.5 * res.BUCKETS))
    weights = [100 * sum(map(ratio, of[k])) / len(of[k]) if of[k] else -100.0 for k in of]
    least = min(0.0, sorted(w for w, t in zip(weights, is_target) if t)[0])
    noise = {r.doc_id: r.g for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", res.gumbel(res.F.col("doc_id")).alias("g")).collect()}
    scores = [w + noise[i] for w, (i, _) in zip(weights, rows)]
    cut = sorted(scores)[-sum(w >= least for w in weights)]
    want = sorted((i, round(w, 6), round(s, 6), s >= cut) for (i, _), w, s in zip(rows, weights, scores))
    got = sorted((r.doc_id, round(r.log_weight, 6), round(r.score, 6), r.kept) for r in res.op7_resampling(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("labels", [True, False])
def test_query(spark, tmp_path, labels):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "thing", "water"]) for _ in range(60))
    bad = lambda: "".join(rng.choice("#$%&*|@!") for _ in range(200))
    rows = [(i, good()) for i in range(200)] + [(i, bad()) for i in range(200, 260)] + [(300, None), (301, ""), (None, good()), (5, good()), (302, good() + " " + good()), (303, bad() * 400)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(i, int(i < 200), 0) for i in range(0, 260, 2)] * labels + [(None, 1, 0), (999, 1, 1)]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = res.op7_resampling(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    if not labels:
        assert len([r for r in got if r.kept]) == len(rows)
        return
    assert not kept & set(range(200, 260)) and not kept & {300, 301, 303} and len(kept & set(range(200))) > 180 and 302 in kept
    cut = min(r.score for r in got if r.kept)
    assert all(r.kept == (r.score >= cut) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert res.resample(df, df).collect() == []
