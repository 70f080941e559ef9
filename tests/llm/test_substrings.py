import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadloom.llm import substrings as sub


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]][: len(r)]).sum()) if len(r) else 0
        out.append((len(r), int(gone[:-1].sum()), spans, kept))
    return out


def made(rng):
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 30)) for _ in range(4)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng.randint(1, 25)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [prose(10) + passages[0] + prose(3) for _ in range(60)]
    texts += [None, "", "short", "a" * 300, "ab" * 200, texts[0], texts[0], passages[1][:21], "x\0\0\0" * 20, "\0" * 5]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("runs", "stretch"), [(256, 4_000_000), (4, 100)])
def test_like_brute_force(spark, monkeypatch, runs, stretch):
    monkeypatch.setattr(sub, "RUNS", runs)
    monkeypatch.setattr(sub, "STRETCH", stretch)
    monkeypatch.setattr(sub, "RANGE", 40 * runs)
    texts = made(random.Random(runs))
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sub.remove_repeats(df, length=20, gram=6).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 20)


@pytest.mark.parametrize("length", [8, 13, 20, 33])
def test_suffix_array(length):
    rng = random.Random(length)
    segments = ["".join(rng.choices("ab\0", k=rng.randint(1, 90))).encode() for _ in range(30)]
    segments += [segments[0] + b"ab", b"a" * 120]
    owner, offset, twice, first = sub.repeated(segments, length)
    windows = [segments[o][x : x + length] for o, x in zip(owner, offset, strict=True)]
    assert windows == sorted(windows) and len(windows) == sum(max(0, len(s) - length + 1) for s in segments)
    times = Counter(windows)
    assert twice.tolist() == [times[w] > 1 for w in windows]
    assert first.tolist() == [k == 0 or windows[k - 1] != w for k, w in enumerate(windows)]


def test_neighbours_that_share_nothing():
    rng = random.Random(9)
    shared = bytes(rng.choices(range(97, 123), k=600))
    owner, offset, twice, _ = sub.repeated([b"item 7 " + shared, b"item 8 " + shared], 400)
    assert sorted(zip(owner[twice].tolist(), offset[twice].tolist(), strict=True)) == [(o, x) for o in (0, 1) for x in range(6, 208)]
    some = lambda k: bytes(rng.choices(range(256), k=k))
    for _ in range(50):
        parts = [some(60) for _ in range(3)]
        segments = [some(rng.randint(1, 5)) + rng.choice(parts) + some(rng.randint(0, 5)) for _ in range(8)]
        owner, offset, twice, first = sub.repeated(segments, 20)
        windows = [segments[o][x : x + 20] for o, x in zip(owner, offset, strict=True)]
        times = Counter(windows)
        assert twice.tolist() == [times[w] > 1 for w in windows]
        assert first.tolist() == [k == 0 or windows[k - 1] != w for k, w in enumerate(windows)]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = prose(450)
    texts = [prose(300) + shared + prose(200), shared + prose(399), prose(900), None, "", prose(100) * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2])]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in sub.op5_substrings(spark, str(tmp_path)).collect()}
    want = brute([t for _, t in rows], 400)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, want, strict=True)}


def test_empty(spark):
    assert sub.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_anchor(spark, monkeypatch):
    """A passage shorter than LENGTH that most texts hold, between words of their own: one anchor, many shards and ranges."""
    monkeypatch.setattr(sub, "RUNS", 5)
    monkeypatch.setattr(sub, "RANGE", 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(6))
    texts = [f"{word()} {passage} {word()}" for _ in range(150)] + [f"{word()} {passage} {w}" for w in ("abcde fghab", "abcde ggggg")] + ["same " + passage + " same"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sub.remove_repeats(df, length=38, gram=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 38)


def test_strings_that_weak_hashes_confuse(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    texts = [bits, bits.translate(str.maketrans("ab", "ba")), "a" * 500 + bits[:100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sub.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_memory_of_scanning():
    """A batch of 4 million bytes, half of them in one text: each window in one run, in memory that does not follow the batch."""

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in [100_000] * 20 + [2_000_000]]
    batch = pa.record_batch([pa.array([b"%d" % i for i in range(len(texts))]), pa.array(texts)], ["h", "text"])
    sub._powers.cache_clear()
    tracemalloc.start()
    got = [r for made in sub.scanned(Docs(), 400, 32)(iter([batch])) for r in zip(*(made.column(i).to_pylist() for i in range(3)), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i, t in enumerate(texts):
        runs = sorted((s, s + m) for h, s, m in got if h == b"%d" % i)
        assert [0, *(e for _, e in runs)] == [*(s for s, _ in runs), len(t) - 399]
    assert peak < 100e6
