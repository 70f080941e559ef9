"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Candidates are dealt to blocks of bounded size, whatever their contents; a block stays in its task, and packets of query
rows stream past it. Of a part of the block, every term (component) has a posting list of the candidates that have it, with
weights; the query rows that have the term scatter the weighted postings into a dense array of scores. A part's best are
selected by partition and merged with those of the parts before; the blocks' best are merged at the end. Vectors travel
as the narrowest integers that hold the table's components, and sums are as wide as the largest possible score; where that
may exceed a long, sums modulo 2^64 go with sums in floating point, and a score that a long cannot hold is an error.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a component beyond a long is an
error; shorter vectors count as zero beyond their end; equal scores go to the smaller id; a null id asks nothing, and is a
candidate behind the others of its score; a repeated row is a candidate like any other, also for its twin; with fewer
than k candidates all are returned; an empty table gives no rows; very long vectors make blocks of fewer rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import staged

#: Bytes of the vectors of one block at most; candidates and query rows that are scored at once; query rows of a packet.
BLOCK_BYTES, PART, ROWS, PACKET = 32_000_000, 4096, 64, 1024
NO_ID = np.iinfo(np.int64).max


def usable(df: DataFrame, vector: str) -> DataFrame:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vector).isNotNull() & ok)


def largest(x: np.ndarray) -> int:
    """The largest absolute value (of the least integer too)."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Part:
    """Some candidates, with a posting list for each term."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, dense: np.ndarray):
        self.uid, self.ids, self.dense, self.largest = uid, ids, dense, largest(dense)
        self.postings = []  # the candidates that have the term (None: so many that the weights of all are kept), weights
        for column in dense.T:
            has = np.flatnonzero(column)
            full = 4 * len(has) > len(column)
            self.postings.append((None if full else has, np.ascontiguousarray(column if full else column[has])))

    def scores(self, asked: np.ndarray, kind) -> np.ndarray:
        acc = np.zeros((len(asked), len(self.ids)), kind)
        for t, (ids, weights) in enumerate(self.postings):
            has = np.flatnonzero(asked[:, t])
            if not len(has) or not len(weights):
                continue
            added = np.multiply.outer(asked[has, t].astype(kind), weights.astype(kind))
            if ids is not None:
                acc[np.ix_(has, ids)] += added
            elif len(has) == len(asked):
                acc += added
            else:
                acc[has] += added
        return acc

    def best(self, q_uid: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, score and place of each query's best k candidates other than its own row (ties: more than k)."""
        bound = self.largest * largest(asked) * max(1, asked.shape[1])
        with np.errstate(over="ignore"):
            acc = self.scores(asked, np.int32 if bound < 2**31 else np.int64)
        if bound >= 2**63:
            for row, place in zip(*np.nonzero(np.abs(self.scores(asked, np.float64)) >= 2.0**63 * (1 - 1e-9)), strict=True):
                if not -(2**63) <= sum(map(int.__mul__, asked[row].tolist(), self.dense[place].tolist())) < 2**63:
                    raise OverflowError("a score is beyond a 64-bit integer")
        n = acc.shape[1]
        if n > k + 1:  # one more, as the query's own row may be among them
            least = np.partition(acc, n - k - 1, axis=1)[:, n - k - 1]
            row, place = np.nonzero(acc >= least[:, None])
        else:
            row, place = np.nonzero(np.ones(acc.shape, np.bool_))
        other = self.uid[place] != q_uid[row]
        row, place = row[other], place[other]
        return row, acc[row, place].astype(np.int64), place


def first_k(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row, by score (highest first) and id."""
    order = np.lexsort((ids, ~score, row))
    new = np.r_[True, np.diff(row[order]) != 0][: len(row)]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else np.empty(0, np.int64)
    return order[np.arange(len(row)) - begin < k]


def best_of(parts: list[Part], q_uid: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, score and id of the best k over all parts."""
    out = []
    for at in range(0, len(asked), ROWS):
        held = [np.empty(0, np.int64)] * 3
        for part in parts:
            row, score, place = part.best(q_uid[at : at + ROWS], asked[at : at + ROWS], k)
            held = [np.concatenate(x) for x in zip(held, (row, score, part.ids[place]), strict=True)]
            kept = first_k(*held, k)
            held = [x[kept] for x in held]
        out.append((held[0] + at, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: F.Column, k: int, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score of each query's best k; vectors: `key` (long), `vector` (array of whole numbers)."""
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    # (two bounds in place of an absolute value, which the least long does not have)
    total, depth, high, low = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    high, depth = max(high or 0, -(low or 0) - 1, 1), max(1, depth or 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if high <= np.iinfo(t).max)
    wide = np.dtype(kind).itemsize * depth
    # blocks as large as memory allows, but enough of them for every core to have some
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(min(max(PART, -(-total // (4 * cores))), max(1, BLOCK_BYTES // wide)))
    blocks = max(1, -(-total // size))
    schema = "b int, turn int, uid binary, id binary, v binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as packets of plain numbers: candidates to the blocks by their number, so that equal vectors do not meet in
        one; query rows to all blocks."""
        cands: dict[int, list] = {}
        asks: list = []

        def packet(b, turn, part):
            uid, ids, v = zip(*part, strict=True)
            dense = np.zeros((len(v), depth), kind)
            for x, row in zip(v, dense, strict=True):
                row[: len(x)] = x
            return {"b": b, "turn": turn, "uid": np.array(uid, np.int64).tobytes(), "id": np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(), "v": dense.tobytes()}

        def table(found):
            return pa.RecordBatch.from_pylist(found, schema=arrow)

        few = max(1, min(PACKET, 4_000_000 // wide))
        for batch in batches:
            found = []
            v = batch.column(2)
            at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            for i, (uid, id_, ask) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                row = (uid, id_, flat[at[i] : at[i + 1]])
                b = ((uid * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32) % blocks
                cands.setdefault(b, []).append(row)
                if len(cands[b]) == few:
                    found.append(packet(b, 0, cands.pop(b)))
                if ask:
                    asks.append(row)
                if len(asks) == few:
                    found += [packet(b, 1, asks) for b in range(blocks)]
                    asks = []
            if found:
                yield table(found)
        for b, part in cands.items():
            yield table([packet(b, 0, part)])
        if asks:
            for b in range(blocks):
                yield table([packet(b, 1, asks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packets of one block after another; a block's candidates come first."""
        b, held, parts = None, [], None
        for batch in batches:
            for now, turn, *packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                uid, ids = (np.frombuffer(x, np.int64) for x in packed[:2])
                dense = np.frombuffer(packed[2], kind).reshape(-1, depth)
                if now != b:
                    b, held, parts = now, [], None
                if turn == 0:
                    held.append((uid, ids, dense))
                    continue
                if parts is None:
                    uids, every, matrix = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, depth), kind))
                    order = np.argsort(every, kind="stable")
                    parts = [Part(uids[o], every[o], matrix[o]) for o in np.array_split(order, max(1, -(-len(order) // PART)))]
                    held = []
                row, score, found = best_of(parts, uid, dense, k)
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(ids[row]), pa.array(found), pa.array(score)], ["q_uid", "query_id", "vec_id", "score"])

    arrow = pa.schema([("b", pa.int32()), ("turn", pa.int32()), ("uid", pa.binary()), ("id", pa.binary()), ("v", pa.binary())])
    packets = rows.mapInArrow(pack, schema).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "turn")
    best = packets.mapInArrow(run, "q_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id"))
    id_ = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(id_("query_id"), "rank", id_("vec_id"), "score")


def whole(x: F.Column) -> F.Column:
    """floor(64 x) as a long; an error where a long cannot hold it."""
    y = F.lit(64.0) * x.cast("double")
    return F.when((y >= -(2.0**63)) & (y < 2.0**63), F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond a 64-bit integer")).cast("long"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return top_k(vectors.select("vec_id", F.transform("embedding", whole).alias("v")), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
