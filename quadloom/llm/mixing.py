"""Mixing sources to target weights, in DataFrame operations only.

A source's weight is its share of all tokens to the power t, normalised: t = 1 keeps the shares, t = 0 makes sources
equal, t > 1 favours the large. The exponent is found by bisection: the smallest t at which the entropy of the weights
is at most the target, among those at which no source repeats more than the limit allows (these lie around 1 on either
side; the budget of tokens is the least at which no source goes below one pass). If none of them meets the target, the
largest is taken, which comes nearest, and target_met is false. Then each source's budget is realised: whole passes of all
its documents, and in a last pass a permutation of blocks (buckets of documents by hash, as many as the rows need), each
block in an order of its own, as far as the budget goes.

Tokens are runs of characters other than the blanks \\t to \\r and space. Defined cases: a null source is a source of its
own; a null or empty text has no tokens and comes once; a source without tokens comes once; repeated rows are documents
of their own; texts of any length are counted whole; ties go by hash and row; extra columns are ignored (kept by `mixed`);
an empty table gives no rows, and one source, or sources of one size, meet any target with 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import documents, staged

#: Most passes over a source; target entropy as a share of the greatest (log of the number of sources).
LIMIT, ENTROPY = 2.0, 0.97
STEPS, BLOCKS, BLOCK_ROWS, SEED = 40, 256, 1 << 16, 23


def n_tokens(text) -> F.Column:
    """Words of the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def totals(docs: DataFrame) -> DataFrame:
    """key, n: tokens of each source that has any."""
    return staged(docs.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"))


def exponent(sums: DataFrame, limit: float = LIMIT, entropy: float = ENTROPY) -> tuple[float, bool]:
    """The exponent, and whether the target is met. One small row a step comes to the driver; the sources stay where they
    are."""
    all_, sources, most, least = sums.agg(F.sum("n"), F.count("*"), F.max("n"), F.min("n")).first()
    if not sources or most == least:
        return 1.0, True
    p = F.col("n") / F.lit(float(all_))

    def fine(t: float) -> bool:
        """The entropy of w / sum(w) is at most the target."""
        w = F.pow(p, F.lit(t))
        z, log = sums.agg(F.sum(w), F.sum(w * F.log(w))).first()
        return _log(z) - log / z <= entropy * _log(sources) + 1e-12

    # passes of the largest and the smallest source differ by (most / least) ^ |t - 1|
    reach = _log(limit) / _log(most / least)
    low, high = max(0.0, 1.0 - reach), 1.0 + reach
    if fine(low):
        return low, True
    if not fine(high):
        return high, False
    for _ in range(STEPS):
        t = (low + high) / 2
        low, high = (low, t) if fine(t) else (t, high)
    return high, True


def _log(x: float) -> float:
    return math.log(x) if x > 0 else 0.0


def plan(docs: DataFrame, limit: float = LIMIT, entropy: float = ENTROPY) -> DataFrame:
    """docs: uid, key, n. A row for each pass over each document: uid, epoch (from 0), exponent, target_met."""
    sums = totals(docs)
    t, met = exponent(sums, limit, entropy)
    largest, smallest = sums.agg(F.max("n"), F.min("n")).first()
    # passes of a source: (share ^ t / share) over that of the largest or, if t favours that, of the smallest, passed over once
    passes = F.pow(F.col("n") / F.lit(float((largest if t < 1 else smallest) or 1)), F.lit(t - 1.0))
    budget = sums.select("key", F.floor(passes + 1e-9).cast("int").alias("whole"), F.floor((passes - F.floor(passes + 1e-9)) * F.col("n") + 1e-6).cast("long").alias("rest"))
    budget = staged(budget)
    at = docs.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.lit(max(BLOCKS, -(-docs.count() // BLOCK_ROWS)))).cast("int"))
    # tokens before each block in the permutation of the source's blocks, and before each document in its block
    blocks = at.groupBy("key", "block").agg(F.sum("n").alias("m"))
    turn = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(SEED)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged(blocks.withColumn("before", F.coalesce(F.sum("m").over(turn), F.lit(0))))
    blocks = blocks.join(budget, blocks.key.eqNullSafe(budget.key), "left").select(blocks.key, "block", "before", "m", "whole", "rest")
    blocks = staged(blocks.select(F.coalesce(F.concat(F.lit("s"), "key"), F.lit("n")).alias("k"), "block", "before", F.coalesce("whole", F.lit(1)).alias("whole"), F.coalesce("rest", F.lit(0)).alias("rest")))
    own = Window.partitionBy("k", "block").orderBy(F.xxhash64("uid", F.lit(SEED + 1)), "uid")
    at = at.select("uid", "n", "block", F.coalesce(F.concat(F.lit("s"), "key"), F.lit("n")).alias("k")).withColumn("upto", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.join(blocks, ["k", "block"])
    once_more = (F.col("n") > 0) & (F.col("before") + F.col("upto") <= F.col("rest"))
    times = F.when(F.col("n") > 0, F.col("whole") + once_more.cast("int")).otherwise(1)
    return at.select("uid", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"), F.lit(t).alias("exponent"), F.lit(met).alias("target_met"))


def mixed(df: DataFrame, source: str = "source", text: str = "text", limit: float = LIMIT, entropy: float = ENTROPY) -> DataFrame:
    """The rows of df, each as often as the mixture wants it, and __epoch, __tokens."""
    src = staged(df.withColumn("__uid", F.monotonically_increasing_id()).withColumn("__tokens", n_tokens(df[text])))
    wanted = plan(src.select(F.col("__uid").alias("uid"), F.col(source).cast("string").alias("key"), F.col("__tokens").alias("n")), limit, entropy)
    return src.join(wanted.select(F.col("uid").alias("__uid"), F.col("epoch").alias("__epoch")), "__uid").drop("__uid")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    src = staged(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("uid")))
    wanted = plan(src.select("uid", F.col("source").cast("string").alias("key"), F.col("n_tokens").alias("n")))
    return src.join(wanted, "uid").select("doc_id", "source", "n_tokens", "epoch", "exponent", "target_met")
