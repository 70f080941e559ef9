import math
import re
from collections import Counter, defaultdict

import pytest

from quadloom.llm import mixing


def make(spark, path, rows, limit=mixing.LIMIT, entropy=mixing.ENTROPY):
    spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, epoch int").write.parquet(f"{path}/documents.parquet")
    if (limit, entropy) == (mixing.LIMIT, mixing.ENTROPY):
        return mixing.op10_mixing(spark, str(path)).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("uid", mixing.F.monotonically_increasing_id())
    wanted = mixing.plan(docs.select("uid", mixing.F.col("source").alias("key"), mixing.n_tokens(mixing.F.col("text")).alias("n")), limit, entropy)
    return docs.drop("epoch").join(wanted, "uid").collect()


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("kind", ["many", "three"])
def test_weights_and_whole_passes(spark, tmp_path, kind):
    limit, entropy = (mixing.LIMIT, mixing.ENTROPY) if kind == "many" else (9.0, 0.8)
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)]
    rows += [(1000 + i, "w\x0bw " * 3, f"s{i % 5}") for i in range(200)] + [(3000, None, "big"), (3001, "", None), (3002, "x", None), (None, "x y", "empty?"), (3003, " ", "none")]
    if kind == "three":  # the target is below the entropy of the shares: an exponent over 1
        rows = [(i, "w " * (1 + i % 5), "abc"[i % 6 // 2 if i % 6 < 5 else 0]) for i in range(600)]
    got = make(spark, tmp_path, rows, limit, entropy)
    times = Counter(r.doc_id for r in got)
    assert set(times) == {i for i, _, _ in rows}
    for i, t, _ in rows:
        assert sorted(r.epoch for r in got if r.doc_id == i) == list(range(times[i]))
        assert words(t) or times[i] == 1
    tokens, made = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        tokens[s] += words(t)
        made[s] += words(t) * times[i]
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}
    # brute force: the smallest exponent on a fine grid that keeps to both limits
    for k in range(30001):
        w = {s: p ** (k / 10000) for s, p in shares.items()}
        z = sum(w.values())
        h = -sum(x / z * math.log(x / z) for x in w.values())
        passes = {s: w[s] / shares[s] for s in shares}
        if h <= entropy * math.log(len(shares)) and max(passes.values()) / min(passes.values()) <= limit:
            break
    assert abs(got[0].exponent - k / 10000) <= 1e-3 and got[0].target_met
    least = min(passes.values())
    for s in shares:
        want = passes[s] / least * tokens[s]
        assert want - 8 - 0.002 * want <= made[s] <= want + 1 + 0.002 * want, s


@pytest.mark.parametrize("rows", [[], [(1, "a b", "s")], [(1, None, None), (1, None, None)], [(1, "a", "s")] * 5 + [(2, "b", "t")]])
def test_edges(spark, tmp_path, rows):
    got = make(spark, tmp_path, rows)
    assert len(got) >= len(rows) and {r.doc_id for r in got} == {i for i, _, _ in rows}


def test_targets_out_of_reach(spark):
    sums = spark.createDataFrame([("a", 1000), ("b", 900), ("c", 800)], "key string, n long")
    t, met = mixing.exponent(sums, limit=1.05, entropy=0.5)
    assert not met and t == pytest.approx(1 + math.log(1.05) / math.log(1.25))
    t, met = mixing.exponent(sums, limit=1e6, entropy=0.5)  # only above 1
    assert met and t > 1


def test_very_long_texts(spark, tmp_path):
    got = make(spark, tmp_path, [(1, "word " * 400_000, "s"), (2, "w", "s"), (3, "w " * 50, "t")])
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 400_000), (2, 1), (3, 50)}
