import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(bpe.codec(PATH, public_tokenizers.PATTERN).encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"])) | st.text("abeinst '1.\n\t\xa0é", max_size=80))
def test_like_library(exact, text):
    assert ids(text) == exact.encode_ordinary(text)
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    assert c.decode(c.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=" * 4001, " " * 3000 + "x", "thethethat" * 500, "中" * 700, "aab" * 999, "x1" * 50])
def test_long_pieces(exact, text):
    assert ids(text) == exact.encode_ordinary(text)


def test_query_edges(spark, exact, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "caf\xe9 au lait", None), (4, "word " * 40000, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op4_bpe(spark, str(tmp_path)).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        want = np.array(exact.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(bpe.encode_decode(df)).collect() == []
