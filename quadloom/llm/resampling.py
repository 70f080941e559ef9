"""Quality by importance resampling: hashed n-gram models of good text and of all text, and a Gumbel top-k sample.

Bytes are taken in n-grams, hashed to BUCKETS. The model of the target is fitted on a bounded sample of documents
labelled good and not toxic (TARGETS of them, those of smallest id hash); the raw model counts every document. A
document's log weight is the mean log ratio of its n-grams, times LENGTH (so that long texts weigh no more than short
ones). To that a Gumbel variate from the document's id is added, and the k highest are sampled. k is the number of
documents that are more likely in the target than among all (a weight of 0 or more); where the corpus is so much like the
target that more than LOSS of the target documents are below 0, of those not below that quantile.

Defined cases: null and empty texts, and those shorter than an n-gram, have the weight -LENGTH and are ranked like
others; scores equal to the k-th are all kept; rows that repeat an id share its variate, and so do those without an id;
without target documents nothing tells good from bad and all are kept; texts of any length are worked on whole; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import documents, map_text, staged

GRAM, BUCKETS, LENGTH, LOSS, TARGETS, SEED = 3, 1 << 14, 100.0, 0.01, 20_000, 29
BINS = 1024


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and the text it is in."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), size)
    if len(data) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(data) - GRAM + 1
    code = np.zeros(n, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | data[i : i + n]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    inside = owner[:n] == owner[GRAM - 1 :]
    return code[inside].astype(np.int64), owner[:n][inside]


def counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """df: text, target. N-grams of all texts, and of the target's, by bucket; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = [(t.as_py() or "").encode() for t in batch.column(0)]
            for at in range(0, len(texts), 500):
                code, owner = codes(texts[at : at + 500])
                sums[0] += np.bincount(code, minlength=BUCKETS)
                sums[1] += np.bincount(code[target[at : at + 500][owner]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(BUCKETS)), pa.int32()), *(pa.array(s) for s in sums)], ["b", "raw", "target"])

    total = df.mapInArrow(run, "b int, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS))
    for r in total.collect():
        out[:, r.b] = r.raw, r.target
    return out[0], out[1]


def gumbel(id_: F.Column) -> F.Column:
    """A Gumbel variate from the id: -log(-log(u)), u from 52 bits of its hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(SEED)), 12) + F.lit(0.5)) / F.lit(2.0**52)
    return -F.log(-F.log(u))


def kth_highest(scores: DataFrame, k: int) -> float:
    """The k-th highest value of column score: the bin that holds it is divided again until it is one value."""
    low, high, _ = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        if low + width == low or width == 0:
            break
        part = scores.where((F.col("score") >= low) & (F.col("score") <= high))
        b = F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1))
        found = part.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
    return low


def resample(df: DataFrame, targets: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_`, log_weight, score and kept. targets: `id_` of documents to resemble."""
    some = targets.select(id_).where(F.col(id_).isNotNull()).distinct().orderBy(F.xxhash64(id_), id_).limit(TARGETS)
    flagged = df.select(df[id_], df[text].cast("string").alias("text")).join(F.broadcast(some.withColumn("target", F.lit(True))), id_, "left").withColumn("target", F.coalesce("target", F.lit(False)))
    raw, target = counts(flagged.select("text", "target"))
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))

    def fn(texts):
        code, owner = codes([(t or "").encode() for t in texts])
        n = np.bincount(owner, minlength=len(texts))
        s = np.bincount(owner, ratio[code], minlength=len(texts))
        return [np.where(n > 0, LENGTH * s / np.maximum(1, n), -LENGTH).tolist()]

    weighed = map_text(flagged, [id_, "target"], "text", "log_weight double", fn)
    numbered = staged(weighed.withColumn("score", F.col("log_weight") + gumbel(F.col(id_))))
    good = numbered.where("target").agg(F.percentile_approx("log_weight", LOSS, 10_000)).first()[0]
    k = numbered.where(F.col("log_weight") >= min(0.0, good)).count() if good is not None else 0
    least = kth_highest(numbered, k) if k else float("-inf")
    return numbered.select(id_, "log_weight", "score", (F.col("score") >= least).alias("kept"))


def op7_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(documents(spark, sf_dir), labels.where("quality = 1 AND toxic = 0"))
