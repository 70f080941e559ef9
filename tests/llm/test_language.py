import tracemalloc
import zlib

import numpy as np
import pytest

from quadloom.llm import language

DATA = "/root/testdata/sf0.01"


def test_accuracy_and_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r.doc_id: r.lang for r in docs}
    got = language.op8_language(spark, DATA).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97


def test_bundle_is_sum_of_trigrams():
    space = language.Space.get()
    (got, alone), letters = space.bundles(["ab, c", "12 --"])
    code = lambda *s: np.array([(s[0] << 12) | (s[1] << 6) | s[2]])
    want = sum(space.vectors(code(*t))[0] for t in ((0, 1, 2), (1, 2, 0), (0, 3, 0)))
    assert (got == want).all() and not alone.any() and letters.tolist() == [True, False]


@pytest.mark.parametrize("rows", [[], [(1, "the and of", None)]])
def test_nothing_to_learn(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.lang_pred, r.score) for r in language.op8_language(spark, str(tmp_path)).collect()] == [("und", 0.0)] * len(rows)


def test_edges(spark, tmp_path):
    rows = [(i, "der und die das ist nicht", "de") for i in range(40)] + [(i, "the and of that is not", "en") for i in range(40, 80)]
    rows += [(100, None, "de"), (101, "", "en"), (102, "123 ...", "en"), (103, "中文", "en"), (None, "the thing is that", None), (104, "nicht " * 50000, "de")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.op8_language(spark, str(tmp_path)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert got[103].lang_pred in ("de", "en") and got[None].lang_pred == "en" and got[104].lang_pred == "de"


def test_memory_of_bundling():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.choice([32, *range(97, 123), 0xE9, 0x4E2D], 2500))) for _ in range(400)]
    space = language.Space.get()
    tracemalloc.start()
    got, _ = space.bundles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a million symbols, 20,000 different trigrams
    assert all((got[i] == space.bundles([texts[i]])[0][0]).all() for i in (0, 255, 256, 399))


def test_short_texts_go_by_rows():
    made, bundles = [], language.Space.bundles

    def watched(self, texts):
        made.append(len(texts))
        return bundles(self, texts)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(language.Space, "bundles", watched)
        m.setattr(language, "map_text", lambda df, keep, text, fields, fn: fn)
        fn = language.identify(None, {"de": [1] * language.SIZE, "en": [-1] * language.SIZE})
        preds, scores = fn([None, "", "12", "the"] * 500)
    assert max(made) <= language.ROWS and len(preds) == len(scores) == 2000 and preds[1996:1999] == ["und"] * 3
