"""Exact substring deduplication with suffix arrays in shards.

Bytes covered by a string of LENGTH bytes that also starts elsewhere are removed. Work is dealt so that equal strings
meet whatever shard they come from:

1. Each LENGTH-byte window belongs to the least hashed GRAM-byte string in it (its anchor), so equal windows have equal
   anchors. Windows next to each other with one anchor form a run: the unit of work. Runs of equal bytes are one content,
   known by a 128-bit BLAKE2 digest of the bytes; the polynomial hashes only deal work out.
2. Runs whose anchor occurs once hold no repeated window and go. Contents found twice are repeated throughout.
3. Of anchors with several contents, one copy of each content goes to the anchor's shard. There a suffix array of the
   bytes is refined by Larsson-Sadakane doubling, Kasai's rule gives common prefixes, and neighbours that share LENGTH
   bytes mark repeated windows. Anchors with many contents are dealt over several shards. Of these, the first of each
   kind of window in suffix order is known by a BLAKE2 digest of its bytes, and the shards' sorted digests are merged by
   binary search, in as many ranges as the windows need.
4. Marks go back to every run of the content, and from there to the texts.

Texts are known by their SHA-256, so equal texts are looked at once but counted as often as they occur. Defined cases: a
null text counts as empty; texts shorter than LENGTH lose nothing; repeated rows repeat each other; null ids are
allowed; an empty table gives no rows; texts are worked on whole, long ones in stretches that overlap; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadloom.llm.common import documents, partitions, staged, text_runs
from quadloom.llm.near import mix
from quadloom.llm.repetition import common

LENGTH, GRAM = 400, 32
#: Runs that one shard of an anchor gets, about; bytes of one suffix array; windows of a text, and bytes of texts, that are dealt
#: with at once. Scanning takes about 130 bytes of a worker's memory for each of these.
RUNS, BYTES, STRETCH = 256, 500_000, 500_000
#: Bytes that one task sorts, about, in one suffix array after another.
SHARD = 8_000_000
#: Windows that one range of an anchor merges, about.
RANGE = 500_000
POSITION = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    n = 1 << bits
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Hashes of any stretch of some bytes, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        bits = max(16, int(len(data) + 1).bit_length())
        up, self.down = _powers(bits)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Of texts that stand one after another in data: text, first window (in the text), windows, anchor and first byte (in
    data) of each run."""
    n, width = len(data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none
    h = Hashes(data)
    at = np.arange(n - gram + 1)
    grams = h.of(at, at + gram)
    packed = (grams & ~POSITION) | at.astype(np.uint64)
    pad = -len(packed) % width
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    anchor = (np.minimum(behind[p], ahead[p + width - 1]) & POSITION).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = owner[p] == owner[p + length - 1]
    new = ok & np.r_[True, (anchor[1:] != anchor[:-1]) | ~ok[:-1]]
    first = np.flatnonzero(new)
    last = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True])
    return owner[first], first - bounds[owner[first]], last - first + 1, grams[anchor[first]].view(np.int64), first


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each stretch of data."""
    view, digest = memoryview(data), hashlib.blake2b
    return [digest(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def scanned(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: h, text. A row for each run of each text: h, s (first window), m (windows), anchor, content."""
    schema = "h binary, s int, m int, anchor long, content binary"

    def stretches(h, raw):
        for at in range(0, max(1, len(raw) - length + 1), STRETCH):
            yield h, at, raw[at : at + STRETCH + length - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (x for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if len(raw := t.as_py().encode()) >= length for x in stretches(h, raw))
            part, size = [], 0
            for row in rows:
                if part and size + len(row[2]) > STRETCH:
                    yield made(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[2])
            if part:
                yield made(part)

    def made(part):
        joined = b"".join(raw for _, _, raw in part)
        bounds = np.cumsum([0, *(len(raw) for _, _, raw in part)])
        owner, s, m, anchor, first = runs(np.frombuffer(joined, np.uint8), bounds, length, gram)
        s = s + np.array([at for _, at, _ in part], np.int64)[owner]
        keys = pa.array([h for h, _, _ in part], pa.binary()).take(pa.array(owner))
        content = pa.array(digests(joined, first, first + m + length - 1), pa.binary())
        return pa.RecordBatch.from_arrays([keys, pa.array(s, pa.int32(), safe=False), pa.array(m, pa.int32(), safe=False), pa.array(anchor, pa.int64()), content], ["h", "s", "m", "anchor", "content"])

    return docs.mapInArrow(run, schema)


def suffix_array(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """starts, in the order of their `length` bytes. Larsson-Sadakane: groups of equal first bytes are refined by the
    rank that far ahead, which doubles; places with too few bytes left are not needed any more and stay behind."""
    n = len(data)
    h = 1
    while h * 2 <= min(8, length):
        h *= 2
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key[: n - i] |= data[i:].astype(np.uint64) << np.uint64(8 * (h - 1 - i))
    left = ends - np.arange(n)
    rank = np.zeros(n, np.int64)
    todo = np.flatnonzero(left >= h)
    rank, todo = _refined(rank, todo, key[todo])
    while h < length:
        step = min(h, length - h)  # the last round overlaps
        todo = todo[left[todo] >= h + step]
        todo = todo[np.argsort(rank[todo], kind="stable")]
        rank, todo = _refined(rank, todo, rank[todo + step], rank[todo])
        h += step
    return starts[np.argsort(rank[starts], kind="stable")]


def _refined(rank, todo, key, group=None):
    """Ranks where each group is sorted by key; and the places that still share a rank."""
    if not len(todo):
        return rank, todo
    if group is None:
        order = np.argsort(key, kind="stable")
        group = np.zeros(len(todo), np.int64)
    else:
        order = np.argsort((group << 32) | key, kind="stable")
    todo, key, group = todo[order], key[order], group[order]
    new_group = np.r_[True, group[1:] != group[:-1]]
    new = new_group | np.r_[True, key[1:] != key[:-1]]
    place = np.arange(len(todo))
    begin = np.maximum.accumulate(np.where(new, place, 0))
    rank = rank.copy()
    rank[todo] = group + begin - np.maximum.accumulate(np.where(new_group, place, 0))
    size = np.diff(np.r_[np.flatnonzero(new), len(todo)])
    return rank, todo[np.repeat(size > 1, size)]


def repeated(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the windows of all segments: segment, offset, whether the window occurs twice among them, and whether it is
    the first of its kind in suffix order."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    bounds = np.r_[0, np.cumsum(size)]
    ends = np.repeat(bounds[1:], size)
    starts = np.flatnonzero(ends - np.arange(len(data)) >= length)
    sa = suffix_array(data, ends, starts, length)
    same = common(data, ends, sa, within=False) >= length
    twice = same | np.r_[same[1:], False]
    owner = np.searchsorted(bounds, sa, "right") - 1
    return owner, sa - bounds[owner], twice, ~same


NAMES = ("anchor", "content", "lo", "hi", "part", "keys", "owners", "contents")


def intervals(owner: np.ndarray, offset: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
    """Of each owner, the first and the last of the offsets that adjoin."""
    if not len(owner):
        return []
    order = np.lexsort((offset, owner))
    o, x = owner[order], offset[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (x[1:] != x[:-1] + 1)]
    lo, hi, of = x[new], x[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]], o[new]
    edge = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
    return [(int(of[a]), lo[a:b].tolist(), hi[a:b].tolist()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def marks(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """rows: anchor, content, sub, subs, ranges, bytes; sorted by anchor and sub in each partition. Repeated windows within
    a shard: anchor, content, lo, hi (arrays of first and last offsets); and of anchors with several shards, the sorted
    digests of their windows by range."""
    schema = "anchor long, content binary, lo array<int>, hi array<int>, part int, keys binary, owners binary, contents array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size > BYTES and (row[0], row[2]) != last:
                    yield made(held)
                    held, size = [], 0
                last = (row[0], row[2])
                held.append(row)
                size += len(row[5])
        if held:
            yield made(held)

    def made(held):
        owner, offset, twice, first = repeated([r[5] for r in held], length)
        out = []
        out += [(held[k][0], held[k][1], lo, hi, None, None, None, None) for k, lo, hi in intervals(owner[twice], offset[twice])]
        subs = np.array([r[3] for r in held])
        many = np.flatnonzero((subs[owner] > 1) & first)
        if len(many):
            out += windows(held, owner[many], offset[many], twice[many])
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema=arrow)

    def windows(held, owner, offset, twice):
        """One row for each anchor and range: sorted digests, and whose window each is (-1: already marked)."""
        data = b"".join(r[5] for r in held)
        at = np.cumsum([0, *(len(r[5]) for r in held)])[owner] + offset
        key = np.frombuffer(b"".join(digests(data, at, at + length)), "<u8").reshape(-1, 2)
        anchor, ranges = np.array([r[0] for r in held], np.int64)[owner], np.array([r[4] for r in held])[owner]
        part = ((key[:, 0] >> np.uint64(33)) % ranges.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((key[:, 1], key[:, 0], part, anchor))
        edge = np.flatnonzero(np.r_[True, (np.diff(anchor[order]) != 0) | (np.diff(part[order]) != 0)])
        rows = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            k = order[a:b]
            names, own = np.unique(owner[k], return_inverse=True)
            owners = np.stack([own, np.where(twice[k], -1, offset[k])], 1).astype("<i4")
            rows.append((int(anchor[k[0]]), None, None, None, int(part[k[0]]), key[k].tobytes(), owners.tobytes(), [held[i][1] for i in names.tolist()]))
        return rows

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    got = staged(rows.mapInArrow(run, schema))
    return got.where("part IS NULL").select("anchor", "content", "lo", "hi"), got.where("part IS NOT NULL").select("anchor", "part", "keys", "owners", "contents")


def merged(ranges: DataFrame) -> DataFrame:
    """Windows that two shards of an anchor have: anchor, content, lo, hi. Each shard's sorted digests are looked up in
    those of all by binary search."""
    schema = "anchor long, content binary, lo array<int>, hi array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, keys, owners, contents in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shards = [np.frombuffer(k, "<u8").reshape(-1, 2) for k in keys]
                every = np.concatenate(shards)
                every = every[np.lexsort((every[:, 1], every[:, 0]))]
                new = np.r_[True, (every[1:] != every[:-1]).any(1)]
                kinds, times = every[new], np.diff(np.r_[np.flatnonzero(new), len(every)])
                for key, own, names in zip(shards, owners, contents, strict=True):
                    own = np.frombuffer(own, "<i4").reshape(-1, 2)
                    at = np.searchsorted(kinds[:, 0], key[:, 0])
                    while len(off := np.flatnonzero(kinds[at, 1] != key[:, 1])):  # digests that share their first half
                        at[off] += 1
                    found = own[(times[at] > 1) & (own[:, 1] >= 0)].astype(np.int64)
                    out += [{"anchor": anchor, "content": names[k], "lo": lo, "hi": hi} for k, lo, hi in intervals(found[:, 0], found[:, 1])]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    lists = [F.collect_list(c).alias(c) for c in ("keys", "owners", "contents")]
    return ranges.groupBy("anchor", "part").agg(*lists).select("anchor", "keys", "owners", "contents").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: h, text. spans (array of s, e: first and last window that is repeated) of each text that has any, by h."""
    spark = docs.sparkSession
    occ = staged(scanned(docs, length, gram).groupBy("h", "s", "m", "anchor", "content").agg(F.count("*").alias("n")))
    anchors = staged(occ.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), (F.min("content") == F.max("content")).alias("alone")).where("total > 1").select("anchor", "rows", "alone"))
    some = staged(occ.join(anchors, "anchor"))
    contents = staged(some.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(F.struct("h", "s", "m")).alias("r"), F.max("rows").alias("rows"), F.first("alone").alias("alone")).select("anchor", "content", "n", "r.*", "rows", "alone"))
    everywhere = contents.where("n > 1").select("anchor", "content", F.array(F.lit(0)).alias("lo"), F.array(F.col("m") - 1).alias("hi"))
    asked = contents.where("NOT alone")
    total = asked.agg(F.sum(F.col("m") + length)).first()[0] or 0
    lists = asked.groupBy("h").agg(F.collect_list(F.struct("anchor", "content", "s", "m", "rows")).alias("asked"))
    texts = docs.groupBy("h").agg(F.any_value("text").alias("text"))
    schema = "anchor long, content binary, sub int, subs int, ranges int, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs_ in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                for r in runs_.as_py():
                    subs = -(-r["rows"] // RUNS)
                    ranges = max(1, r["rows"] * (length - gram) // (2 * RANGE))
                    out.append((r["anchor"], r["content"], int.from_bytes(r["content"][:6], "little") % subs, subs, ranges, raw[r["s"] : r["s"] + r["m"] + length - 1]))
                if len(out) > 5000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(rows):
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "content", "sub", "subs", "ranges", "bytes"])

    shards = max(partitions(spark), int(total // SHARD) + 1)
    pieces = texts.join(lists, "h").select("text", "asked").mapInArrow(cut, schema)
    dealt = pieces.repartition(shards, "anchor", "sub").sortWithinPartitions("anchor", "sub")
    within, ranges = marks(dealt, length)
    found = within.where("content IS NOT NULL").union(everywhere).union(merged(ranges))
    found = staged(found.groupBy("anchor", "content").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi")))
    back = some.select("h", "s", "anchor", "content").join(found, ["anchor", "content"])
    spans = back.select("h", F.explode(F.arrays_zip("lo", "hi")).alias("x"), "s").select("h", F.struct((F.col("s") + F.col("x.lo")).alias("s"), (F.col("s") + F.col("x.hi")).alias("e")).alias("x"))
    return staged(spans.groupBy("h").agg(F.collect_list("x").alias("spans")))


def remove_repeats(df: DataFrame, keep=("doc_id",), text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`keep`, kept (binary: the remaining bytes), n_bytes, n_removed and n_spans."""
    src = df.select(*[df[c] for c in keep], F.coalesce(df[text].cast("string"), F.lit("")).alias("__text"))
    src = src.withColumn("__h", F.unhex(F.sha2("__text", 256)))
    spans = repeated_spans(src.select(F.col("__h").alias("h"), F.col("__text").alias("text")), length, gram)
    joined = src.join(spans.withColumnRenamed("h", "__h"), "__h", "left").select(*keep, "__text", "spans")
    n = len(keep)
    names = [*keep, "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, end in text_runs(whole.column(n)):
                yield made(whole.slice(at, end - at))

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, removed, parts = [], [], [], []
        for t, found in zip(batch.column(n), batch.column(n + 1), strict=True):
            raw, left, at, gone, k = t.as_py().encode(), [], 0, 0, 0
            end = -1  # of the removed run so far
            for x in sorted(found.as_py() or (), key=lambda x: x["s"]):
                s, e = x["s"], x["e"] + length
                if s > end:
                    left.append(raw[at:s])
                    k += 1
                    gone += e - s
                    at = end = e
                elif e > end:
                    gone += e - end
                    at = end = e
            left.append(raw[at:])
            kept.append(b"".join(left))
            total.append(len(raw))
            removed.append(gone)
            parts.append(k)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (total, removed, parts))], names)

    schema = T.StructType([*(src.schema[c] for c in keep), *T.StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long").fields])
    return joined.mapInArrow(run, schema)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

