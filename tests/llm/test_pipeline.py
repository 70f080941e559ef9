"""Each stage of the pipeline against what its parts say by brute force."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from quadloom.llm import pii
from tests.llm.test_near import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    base = " ".join(f"the word{i}" for i in range(40))
    rows = [(i, base + f" and end {i % 2}", "en", f"s{i % 3}", 1) for i in range(6)]
    rows += [(10 + i, " ".join(f"of t{i}x{k}" for k in range(30)) + " mail a@b.co", "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(50, None, "en", None, None), (51, "12", None, "s1", 2), (51, "12", None, "s1", 2), (None, "no id here", None, "s2", 3), (60, "", "de", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    stage = [f for _, f in cp.STAGES]

    one = stage[0](spark, docs, "")
    assert one.columns == cp.COLUMNS
    got = {r.doc_id for r in one.collect()}
    assert got == {r[0] for r in rows} - {50, 51, 60}

    two = stage[1](spark, one, "").collect()
    want = [r for r in brute([(r.doc_id, r.text) for r in one.collect()], percent=80, width=5) if r[3]]
    assert Counter(r.doc_id for r in two) == Counter(r[0] for r in want)

    three = stage[2](spark, one, "").collect()
    model = pii.trained()
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in three:
        (base_, _), = pii.find(model, [texts[r.doc_id]])
        assert all(texts[r.doc_id][a:b] not in r.text for _, a, b in base_) and r.n_chars == len(r.text)

    four = stage[3](spark, one, "").collect()
    assert {r.doc_id for r in four} == got and len(four) >= len(got)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stage[4](spark, one, "").collect():
        ids = np.array(exact.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_near_duplicates_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (None, None), (None, "")]  # nothing links these
    rows += [(1, text(3)), (2, text(3)), (2, text(4)), (3, text(4) + " more"), (4, text(5)), (4, text(6)), (5, text(7)), (5, text(7))]
    rows += [(6, text(8)), (6, text(8) + " end"), (7, text(2)), (8, None), (8, ""), (9, " \t\n"), (9, "\x85")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect())
    six = [k for k in got if k[0] == 6]
    assert len(six) == 1 and got.pop(six[0]) == 1 and six[0] in rows
    gone = [(2, text(3)), (3, text(4) + " more"), (5, text(7)), (6, text(8)), (6, text(8) + " end")]
    assert got == Counter(rows) - Counter(gone)


def test_run(spark, tmp_path):
    spark.createDataFrame([(1, "the thing and the other", "en", "s", 1), (2, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in cp.run(spark, str(tmp_path)).collect()] == [1]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/empty").collect() == []
