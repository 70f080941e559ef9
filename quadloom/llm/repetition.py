"""Quality rules on repetition, by a suffix array of each text's words.

The words of many texts stand in one array, with ids of their own for each text, so that equal runs of words never
cross texts. Suffixes are first grouped by three words; groups of two or more are refined by the rank of the suffix
as far ahead as is already compared, each round twice as far, until every group has one member. Common prefixes of
neighbours come by Kasai's rule for all texts at once; the deepest common-prefix intervals whose repeats can be
extended neither way are the maximal repeats. A text is refused when the union of their spans covers too much of it
or the longest is too long.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 50 words); repeated rows and null
ids are rows like any other, as each text is judged by itself; texts of any length are worked on whole; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import documents, map_text

#: Limits of the verdict: share of words inside maximal repeats of at least LEAST words, and words of the longest one.
#: Of 8,884 documents (sf0.1) that pass the base rule, 23 are over the first limit and none is over the second: 99.9 % are
#: covered to 0.25 at most, the longest repeat has 13 words.
LEAST, MOST_COVERED, MOST_LONG = 8, 0.2, 40
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as integers, no id in two texts, and where each text begins (and the last ends)."""
    ids, bounds, base = [], [0], 0
    for t in texts:
        seen: dict[bytes, int] = {}
        words = t.encode("utf-8", "surrogatepass").split()
        ids += [base + seen.setdefault(w, len(seen)) for w in words]
        base += len(seen)
        bounds.append(bounds[-1] + len(words))
    return np.array(ids, np.int64), np.array(bounds, np.int64)


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]]) if len(keys) else 0
    return out


def three_ranks(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the three words from each place on; words past the end of a text count as none (below all)."""
    n, at = len(ids), np.arange(len(ids))
    second = np.where(at + 1 < ends, ids[np.minimum(at + 1, n - 1)] + 1, 0)
    third = np.where(at + 2 < ends, ids[np.minimum(at + 2, n - 1)] + 1, 0)
    bits = int(ids.max() + 2).bit_length() if n else 1
    if 3 * bits <= 63:
        return ranks_of((ids << (2 * bits)) | (second << bits) | third)
    return ranks_of((ranks_of((ids << 31) | second) << 31) | third)


def repeats(ids: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least `least` words: where each occurrence begins, its length; and, per place, whether its
    three words occur elsewhere in the text."""
    n = len(ids)
    none = np.empty(0, np.int64)
    if n == 0:
        return none, none, np.empty(0, np.bool_)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    rank = three_ranks(ids, ends)
    count = np.bincount(rank)
    whole = np.arange(n) + 3 <= ends
    again = (count[rank] > 1) & whole
    # suffixes that share three words with another: only these can begin a repeat of three words or more
    start = np.cumsum(np.r_[0, count[:-1]])  # a group's first place in the suffix array
    rank = start[rank]
    todo, h = np.flatnonzero(again), 3
    while len(todo):
        ahead = todo + h
        key = np.where(ahead < ends[todo], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort((rank[todo] << 32) | key, kind="stable")
        todo, key = todo[order], key[order]
        group = rank[todo]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(todo)), 0))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
        rank[todo] = group + (begin - first)
        size = np.diff(np.r_[np.flatnonzero(new), len(todo)])
        todo = todo[np.repeat(size > 1, size)]
        h *= 2
    # the suffix array of the suffixes that share three words; neighbours of one group of three are neighbours here
    some = np.flatnonzero(again)
    if not len(some):
        return none, none, again
    sa = some[np.argsort(rank[some], kind="stable")]
    lcp = common(ids, ends, sa)
    return *intervals(n, sa, lcp, least), again


def common(ids, ends, sa, within: bool = True) -> np.ndarray:
    """lcp[k]: words that suffixes sa[k-1] and sa[k] share (0 for k = 0; if within, 0 across texts). Kasai: where place p and the suffix before it
    are both one further than those of place p-1, they share one less. Only the first places of such runs are compared,
    all at once, over stretches that double."""
    n = len(ids)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    has = np.zeros(n, np.bool_)
    has[sa[1:]] = (ends[sa[1:]] == ends[sa[:-1]]) | (not within)
    # (the texts do not change on the way either, lest a shared part end with its text)
    along = np.r_[False, has[1:] & has[:-1] & (before[1:] == before[:-1] + 1) & (ends[1:] == ends[:-1])]
    along[1:] &= ends[before[1:]] == ends[before[:-1]]
    # (and the place p-1 shares its first word at least: neighbours that share nothing say nothing of those one further)
    along[1:] &= ids[:-1] == ids[before[:-1]]
    heads = np.flatnonzero(has & ~along)
    a, b = heads, before[heads]
    most = np.minimum(ends[a] - a, ends[b] - b)
    got, todo, step = np.zeros(len(heads), np.int64), np.arange(len(heads)), 8
    while len(todo):
        left = []
        for part in np.array_split(todo, max(1, len(todo) * step >> 21)):
            far = got[part][:, None] + np.arange(step)
            ok = far < most[part][:, None]
            ok &= ids[np.minimum(a[part][:, None] + far, n - 1)] == ids[np.minimum(b[part][:, None] + far, n - 1)]
            shared = np.where(ok.all(1), step, ok.argmin(1))
            got[part] += shared
            left.append(part[shared == step])
        todo, step = np.concatenate(left), step * 2
    length = np.zeros(n, np.int64)
    length[heads] = got
    run = np.maximum.accumulate(np.where(has & ~along, np.arange(n), -1))
    inside = np.flatnonzero(along)
    length[inside] = length[run[inside]] - (inside - run[inside])
    return length[sa]


def intervals(n, sa, lcp, least):
    """Occurrences of maximal repeats. The deepest common-prefix interval that holds a suffix gives the longest repeat
    that begins there; those inside the one that begins a place before can be extended to the left, and go."""
    deep = np.maximum(lcp, np.r_[lcp[1:], 0])
    reach = np.zeros(n + 1, np.int64)
    tall = deep >= least
    reach[sa[tall]] = sa[tall] + deep[tall]
    place = np.flatnonzero((reach[:-1] > 0) & (reach[:-1] > np.r_[0, reach[:-2]]))
    return place, reach[place] - place


def covered(place: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], least: int = LEAST) -> list[list[int]]:
    """Columns: words, word characters, symbols, repeated lines, words in repeated 3-word windows, words in maximal
    repeats, words of the longest repeat."""
    ids, bounds = word_ids(texts)
    n = len(ids)
    place, size, again = repeats(ids, bounds, least)
    in_windows = covered(at := np.flatnonzero(again), np.full(len(at), 3), n)
    in_repeats = covered(place, size, n)
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(bounds, place, "right") - 1, size)
    lines = []
    for t in texts:
        k = 0
        if "\n" in t:
            parts = [x for x in t.split("\n") if x and x.strip(BLANKS)]
            k = len(parts) - len(set(parts))
        lines.append(k)
    return [
        np.diff(bounds).tolist(),
        [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        lines,
        total(in_windows).tolist(),
        total(in_repeats).tolist(),
        longest.tolist(),
    ]


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"


def rules(df: DataFrame, keep=("doc_id",), text: str = "text", least: int = LEAST, most_covered: float = MOST_COVERED, most_long: int = MOST_LONG) -> DataFrame:
    """`keep`, the measures, base_failed and kept."""
    made = map_text(df, keep, text, FIELDS, lambda texts: measure([t or "" for t in texts], least))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_long)
    return made.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"
    )
