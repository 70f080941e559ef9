"""Byte-level BPE over padded matrices of equal-length buckets.

A text is split by the tokenizer's pattern. A piece that is a token is that token; the others go, by length, into
matrices with a row for each piece. Every round finds each row's leftmost pair of minimum rank, merges it, closes the
gap, and drops the rows that have no pair left. Pairs are looked up in an open-addressing hash table.

A round also merges the further pairs of the same rank in the row, where that is what the next rounds would do. One at a
time, from the left, is the order of the rule: after a merge the leftmost pair of minimum rank is the next one of that rank
to the right, unless it shared a token with the one just merged (such a pair is gone, so of overlapping ones every other
counts from the left), or one of the two pairs that the merge has made, with the token before (itself merged, if the merge
before it ended there) and with the token behind as it still stands, has a lower rank. So exactly these pairs are looked up
for every merge of the round; where one has a lower rank, the row merges its leftmost pair only. A pair made by a merge cannot
be of the same rank, as its token is longer than the token of that rank.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows and null ids are rows like any other;
texts of any length are worked on whole, and pieces of any length by the same rule; an empty table gives no rows; extra
columns are ignored, whatever their names. Code points that are newer than Unicode 15 may be taken for letters or numbers
here and not by the library, whose tables are older, and then end other pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import documents, map_text

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Cells of one matrix, and pieces remembered by one worker.
CELLS, REMEMBERED = 1 << 20, 300_000

# The pattern's classes among the first 256 code points.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"


class PairTable:
    """(left id, right id) -> merged id, in open addressing with linear probing; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            at = slot[left]
            free = self.keys[at] < 0
            got, cand = at[free], left[free]
            self.keys[got] = keys[cand]  # of several that want a slot, the last one written has it
            won = cand[self.keys[got] == keys[cand]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[at] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0) & (keys >= 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            open_, at = open_[go], at[go]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.narrow = _narrow(pattern)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.vocab[i] = t
        self.byte_id = np.full(256, -1, np.int32)
        left, right, made = [], [], []
        for token, i in ranks.items():
            if len(token) == 1:
                self.byte_id[token[0]] = i
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("a byte-level vocabulary has a token for every byte")
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.pairs = PairTable(keys, np.array(made, np.int32))
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, ps)) for ps in split]

    def learn(self, pieces: Iterable[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (i := self.ranks.get(raw)) is not None:
                self.known[p] = i.to_bytes(4, "little")
            else:
                buckets.setdefault(_width(len(raw)), []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for (p, _), ids in zip(part, self.merge([r for _, r in part], width), strict=True):
                    self.known[p] = ids

    def merge(self, raws: list[bytes], width: int) -> list[bytes]:
        """The ids of each of raws, which have 2 to width bytes."""
        m = len(raws)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(m, width)
        size = np.fromiter(map(len, raws), np.int64, m)
        ids = self.byte_id[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width - 1)
        rows, out = np.arange(m), [b""] * m
        while len(rows):
            pos = rank.argmin(1)
            best = rank[np.arange(len(rows)), pos]
            if len(ended := np.flatnonzero(best == NONE)):
                flat = ids[ended].astype("<u4")
                for k, n, r in zip(range(len(ended)), size[ended], rows[ended], strict=True):
                    out[r] = flat[k, :n].tobytes()
                live = np.flatnonzero(best != NONE)
                rows, ids, rank, size, pos, best = rows[live], ids[live], rank[live], size[live], pos[live], best[live]
                if not len(rows):
                    break
                if (most := int(size.max())) < ids.shape[1]:
                    ids, rank = ids[:, :most], rank[:, : most - 1]
            ids, rank, size = self._merge(ids, rank, size, pos, best)
        return out

    def _merge(self, ids, rank, size, pos, best):
        """Each row's leftmost pair of minimum rank, and those of the same rank that the next rounds would merge."""
        n, width = ids.shape
        each = np.arange(n)
        hit = rank == best[:, None]
        row, col = np.nonzero(hit)
        if len(row) > n:
            # of pairs that overlap, every other from the left
            start = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)]
            place = np.arange(len(row))
            chosen = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
            row, col = row[chosen], col[chosen]
            token = best[row]
            after = np.where(col + 2 < width, ids[row, np.minimum(col + 2, width - 1)], -1)
            before = np.where(col > 0, ids[row, np.maximum(col - 1, 0)], -1)
            joined = np.r_[False, (row[1:] == row[:-1]) & (col[1:] == col[:-1] + 2)]
            before[joined] = token[joined]
            lower = (self.pairs.get(token, after) < token) | (self.pairs.get(before, token) < token)
            if lower.any():
                alone = np.zeros(n, np.bool_)
                alone[row[lower]] = True
                keep = ~alone[row] | (col == pos[row])
                row, col = row[keep], col[keep]
        else:
            row, col = each, pos
        ids[row, col] = best[row]
        gone = np.zeros((n, width), np.bool_)
        gone[row, col + 1] = True
        # the gaps closed: where each column of the shorter rows comes from
        merges = np.bincount(row, minlength=n)
        size = size - merges
        most = width - int(merges.min())
        if int(merges.max()) == 1:
            moved = np.arange(most) + (np.arange(most) > col[:, None]) if len(row) == n else None
        else:
            moved = None
        if moved is None:
            to = np.cumsum(~gone, 1) - 1
            r, c = np.nonzero(~gone)
            new, new_rank = np.full((n, most), -1, np.int32), np.full((n, most), NONE, np.int32)
            new[r, to[r, c]] = ids[r, c]
            new_rank[r, to[r, c]] = np.concatenate([rank, np.full((n, 1), NONE, np.int32)], 1)[r, c]
            at = to[row, col]
        else:
            new = np.take_along_axis(ids, moved, 1)
            new_rank = np.take_along_axis(np.concatenate([rank, np.full((n, 1), NONE, np.int32)], 1), moved, 1)
            at = col
        # pairs with a token that is new
        right = np.where(at + 1 < most, new[row, np.minimum(at + 1, most - 1)], -1)
        new_rank[row, at] = self.pairs.get(new[row, at], right)
        has = at > 0
        r, a = row[has], at[has]
        new_rank[r, a - 1] = self.pairs.get(new[r, a - 1], new[r, a])
        return new, np.ascontiguousarray(new_rank[:, : most - 1]), size

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _width(n: int) -> int:
    return n if n <= 24 else 1 << (n - 1).bit_length()


def _narrow(pattern: str):
    """The pattern for texts of the first 256 code points, with its classes spelt out for the faster re module."""
    import re

    if pattern != public_tokenizers.PATTERN:
        return None
    text = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    return re.compile(text.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encode_decode(df: DataFrame, keep=("doc_id",), text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`keep`, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary: the bytes of the ids)."""
    path = path or public_tokenizers.path(RANKS)

    def fn(texts):
        c = codec(path, pattern)
        ids = c.encode([t or "" for t in texts])
        return [ids, [c.decode(i) for i in ids]]

    return map_text(df, keep, text, "ids binary, decoded binary", fn)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(documents(spark, sf_dir)))


def digest(made: DataFrame) -> DataFrame:
    return made.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
