import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import repetition as rep


def brute(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    in_windows = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    in_repeats, longest = set(), 0
    for size in range(least, n):
        runs = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        for i in range(n - size + 1):
            if runs[tuple(words[i : i + size])] > 1:
                in_repeats |= set(range(i, i + size))
                longest = size
    return [n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(in_windows), len(in_repeats), longest]


word = st.sampled_from(["a", "b", "c", "\n", "a\n", "#x", "é", "\x85"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(word, max_size=40).map(" ".join) | st.text(max_size=30), max_size=4), st.integers(3, 6))
def test_measure(texts, least):
    got = rep.measure(texts, least)
    assert [list(r) for r in zip(*got, strict=True)] == [brute(t, least) for t in texts]


def test_maximal_only():
    ids, bounds = rep.word_ids(["x a b c d y a b c d z"])
    place, size, _ = rep.repeats(ids, bounds, 3)
    assert sorted(zip(place.tolist(), size.tolist(), strict=True)) == [(1, 4), (6, 4)]


def test_many_equal_words_quickly():
    got = rep.measure(["w " * 60_000, "a b " * 40_000])
    assert got[5] == [60_000, 80_000] and got[6] == [59_999, 79_998]


def test_wide_ids():
    ids = np.arange(30, dtype=np.int64) % 7 + (1 << 30)
    ends = np.full(30, 30)
    small = rep.three_ranks(ids - (1 << 30), ends)
    assert (rep.three_ranks(ids, ends) == small).all()


def test_query_edges(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, (long + "\n") * 3), (None, " ".join(f"v{i % 29}x{i}" for i in range(90)))]
    spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rep.op2_repetition(spark, str(tmp_path)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        want = brute(text, rep.LEAST)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat] == want
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        assert not (r.kept and r.base_failed)
    assert {r.doc_id for r in got if r.kept} == {3, None}
    assert rep.rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_neighbours_that_share_nothing():
    p, q = "p0 p1 p2 p3", "p4 p5 p6 p7 p8"
    text = f"x2 {p} z2 x2 {p} z1 x1 {p} {q} z1 x1 {p} {q} z2 x1 {p} {q} z2 x1 {p} z2 x0 {p} {q} z1"
    assert [c[0] for c in rep.measure([text], 8)] == brute(text, 8)
