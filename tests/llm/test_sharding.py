import random
import zlib
from collections import Counter, defaultdict

import pytest

from quadloom.llm import sharding


def check(got, rows):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    spread = defaultdict(set)
    for r in got:
        spread[(r.size, r.text_crc32)].add(r.shard)
    return {k: len(v) for k, v in spread.items()}


def run(spark, path, rows):
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").write.parquet(f"{path}/documents.parquet")
    return sharding.op3_sharding(spark, str(path)).collect()


def test_groups_stay_together(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"text {i}") for i in range(500)]
    for g in range(80):
        rows += [(1000 + 100 * g + k, f"group {g}") for k in range(rng.randint(2, 9))]
    spread = check(run(spark, tmp_path, rows), rows)
    assert sum(v > 1 for v in spread.values()) <= 2


def test_a_group_of_a_third(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(600)] + [(1000 + i, "copied") for i in range(400)] + [(2000 + i, f"twin {i // 2}") for i in range(200)]
    spread = check(run(spark, tmp_path, rows), rows)
    assert spread[(7, zlib.crc32(b"copied"))] <= 5
    assert sum(v > 1 for v in spread.values()) <= 12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (None, ""), (1, None), (2, "é" * 70_000)], [(i, "same") for i in range(100)]])
def test_edges(spark, tmp_path, rows):
    check(run(spark, tmp_path, rows), rows)
