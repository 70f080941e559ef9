import random
import re

import pytest

from quadloom.llm import near


def brute(rows, percent=85, width=3):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(words))
        sets.append({tuple(words[a : a + k]) for a in range(len(words) - k + 1)} if k else set())
    n, root = len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a in range(n):
        own = rows[a][0]
        ids = [rows[b][0] for b in range(n) if find(b) == find(a)] if own is not None else [None]
        c = min(ids) if own is not None else None
        out.append((own, len(sets[a]), c, own is None or own == c))
    return sorted(out, key=str)


def made(rng):
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    rows, i = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 60])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    return rows + [(i, None), (i + 1, ""), (i + 2, "Two words"), (i + 3, "two WORDS"), (i + 4, "x"), (i + 5, "\x85 é É"), (i + 6, "\x85 é É"), (None, rows[0][1]), (3, "a repeated id with text of its own"), (3, "a repeated id with text of its own")]


@pytest.mark.parametrize("small", [24, 3])
def test_like_brute_force(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL", small)
    rows = made(random.Random(small))
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in near.op6_near(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(df).collect() == []


def test_chain_of_links(spark):
    ids = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(100, 101)], "x long, y long")
    assert {tuple(r) for r in near.components(ids).collect()} == {(i, 0) for i in range(26)} | {(100, 100), (101, 100)}


def test_pairs_at_the_threshold(spark):
    # 17 of 20 shingles are shared; a sampled sketch of 128 bits held these pairs for less alike than 0.85
    rows = []
    for k in (5758, 7116, 9294, 33125, 56282, 60462, 66282, 67617):
        w = [f"w{k}x{i}" for i in range(22)]
        rows += [(2 * k, " ".join(w[:20])), (2 * k + 1, " ".join(w[:19] + w[20:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=str)
    assert got == brute(rows) and sum(r[3] for r in got) == 8


def test_one_large_node_below_the_threshold(spark, monkeypatch):
    """Pages of one template, of similarity 0.5 to 0.9 with each other: nodes branch on, and what is left goes block by block."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "FEW", 3)
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = rng.choice([6, 10, 14, 18, 30, 40])
        at = rng.randrange(20) * 4  # some change much the same part
        words = base[:at] + [f"o{rng.randrange(3)}x{k}" if rng.random() < 0.8 else f"o{i}x{k}" for k in range(own)] + base[at + own :]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=str)
    want = brute(rows)
    assert len({r[2] for r in want}) > 20
    assert got == want


def test_large_nodes_that_branch_and_links_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(near, "WORK", 0)
    monkeypatch.setattr(near, "AT_ONCE", -1)
    test_one_large_node_below_the_threshold(spark, monkeypatch)
    test_chain_of_links(spark)


def test_nodes_of_medium_size_do_not_branch(spark, monkeypatch):
    """Branching such nodes wrote more of a small table with one large group to disk than the table's own size allows."""
    monkeypatch.setattr(near, "children", lambda at: pytest.fail("a node went on that could be compared whole"))
    test_one_large_node_below_the_threshold(spark, monkeypatch)


def test_few_links_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(near, "staged", lambda df, to=near.staged: written.append(df) or to(df))
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)})
    edges = spark.createDataFrame(pairs, "x long, y long")
    got = {tuple(r) for r in near.components(edges).collect()}
    assert len(written) == 1
    monkeypatch.setattr(near, "AT_ONCE", -1)
    assert got == {tuple(r) for r in near.components(edges).collect()}


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    changed = list(words)
    for k in range(0, 60_000, 50):
        changed[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(words[:30_000] + other[:30_000]))]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n long, mark int")
    assert sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=str) == brute(rows)
