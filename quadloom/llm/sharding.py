"""Sharding by balanced label propagation over groups of linked documents.

Documents that share a group are linked (a group stands for the links among all its members, which are never listed).
Every document begins in a shard by its hash. In each round every group prefers, of the shards with room for all of it,
the one that holds most of it, or else the one that can take in most; members elsewhere ask to move there. Moves are admitted up to the
shard's quota, groups in the order of their hash, the group at the quota's edge split by its members' hashes. A group
larger than a shard fills one shard after another. Documents without links are moved last, to make counts even.

Law: `rows`. Counts of the shards differ by one at most.

Defined cases: a null text has size 1 and checksum 0, and equals the empty text; null ids and repeated rows have a
place of their own each; ties go by hash and row; texts of any length count whole; extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import documents, staged

SHARDS, ROUNDS = 8, 8
#: Buckets by hash in which quotas are counted; and for the numbering of places, at least, and rows of a bucket, about.
QUOTA, PLACES, PLACE_ROWS = 1024, 256, 1 << 17


def bucket(*cols, seed: int, n: int) -> F.Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n)).cast("int")


def _quotas(asked: list[tuple[int, int, int]], room: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """asked: (shard, bucket, rows). Of each shard, the first bucket that is not admitted whole, and what it may still take."""
    edge, rest = {}, {}
    for shard in range(len(room)):
        left, edge[shard] = room[shard], QUOTA
        for _, b, n in sorted(x for x in asked if x[0] == shard):
            if n > left:
                edge[shard] = b
                break
            left -= n
        rest[shard] = left
    return edge, rest


def _of(shard: str, values: dict[int, int]) -> F.Column:
    return F.element_at(F.array(*[F.lit(values[s]) for s in sorted(values)]), F.col(shard) + 1)


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes: uid, group (null: no links). Adds shard and linked. Linked documents of no shard exceed an even share, but
    for the slack that lets groups trade places where few documents have no links."""
    at = staged(nodes.withColumn("shard", bucket("uid", seed=1, n=shards)))
    total, loose = at.agg(F.count("*"), F.count_if(F.col("group").isNull())).first()
    share = -(-total // shards)
    most = share + max(0, share // 16 - loose // shards)
    alone = at.where("group IS NULL").withColumn("linked", F.lit(False))
    at = at.where("group IS NOT NULL")
    for _ in range(rounds):
        cells = staged(at.groupBy("group", "shard").agg(F.count("*").alias("n")))
        held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {s: max(0, most - held.get(s, 0)) for s in range(shards)}
        each = cells.groupBy("group").agg(F.sum("n").alias("m"), F.count("*").alias("spread"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by"))
        count = lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0))
        options = [F.struct(count(F.lit(s)).alias("n"), F.lit(-s).alias("s"), F.lit(r).alias("room")) for s, r in room.items()]
        gain = [F.struct(F.least(F.lit(r), F.col("m") - count(F.lit(s))).alias("gain"), x.alias("x")) for (s, r), x in zip(room.items(), options, strict=True)]
        whole = F.array_max(F.filter(F.array(*options), lambda x: x.n + x.room >= F.col("m")))
        part = F.array_max(F.filter(F.array(*gain), lambda x: x.gain > 0)).x
        each = each.where("spread > 1").withColumn("all", whole).withColumn("some", part)
        want = staged(each.select("group", (-F.coalesce("all.s", "some.s")).alias("to"), F.col("all").isNotNull().alias("whole")).where("to IS NOT NULL"))
        # members of shards that are full stay, unless the whole group fits elsewhere
        asks = (F.col("shard") != F.col("to")) & (F.col("whole") | (_of("shard", room) > 0))
        ask = cells.join(want, "group").where(asks).select("to", "n", bucket("group", seed=2, n=QUOTA).alias("b"))
        asked = [tuple(r) for r in ask.groupBy("to", "b").agg(F.sum("n").alias("n")).collect()]
        if not asked:
            break
        edge, rest = _quotas(asked, list(room.values()))
        moving = at.join(want, "group", "left").withColumn("b", bucket("group", seed=2, n=QUOTA)).withColumn("asks", F.coalesce(asks, F.lit(False)))
        at_edge = moving.where("asks").where(F.col("b") == _of("to", edge)).withColumn("c", bucket("uid", seed=3, n=QUOTA))
        split, _ = _quotas([tuple(r) for r in at_edge.groupBy("to", "c").agg(F.count("*").alias("n")).collect()], list(rest.values()))
        inside = (F.col("b") < _of("to", edge)) | (F.col("b") == _of("to", edge)) & (bucket("uid", seed=3, n=QUOTA) < _of("to", split))
        at = staged(moving.select("uid", "group", F.when(F.col("asks") & inside, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return at.withColumn("linked", F.lit(True)).unionByName(alone)


def place(at: DataFrame, shards: int = SHARDS) -> DataFrame:
    """at: uid, shard, linked. uid, shard and slot: counts of shards at most one apart, slots without gaps; what is over
    in a shard, documents without links first, fills the others."""
    cell = ["shard", "linked", "p"]
    places = max(PLACES, -(-at.count() // (shards * PLACE_ROWS)))
    at = staged(at.select("uid", "shard", "linked", bucket("uid", seed=4, n=places).alias("p")))
    sizes = {(r.shard, r.linked, r.p): r.n for r in at.groupBy(*cell).agg(F.count("*").alias("n")).collect()}
    held = [sum(n for (s, _, _), n in sizes.items() if s == shard) for shard in range(shards)]
    total = sum(held)
    # the larger shards of the even division go to those that hold most
    order = sorted(range(shards), key=lambda s: (-held[s], s))
    share = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    begin, so_far = [], dict.fromkeys(range(shards), 0)
    for key in sorted(sizes, key=lambda k: (k[0], not k[1], k[2])):
        begin.append((*key, so_far[key[0]]))
        so_far[key[0]] += sizes[key]
    over, lack, n_over, n_lack = {}, [], 0, 0
    for s in range(shards):
        over[s] = n_over - share[s]
        n_over += max(0, held[s] - share[s])
        if held[s] < share[s]:
            lack.append((n_lack, s, held[s]))
            n_lack += share[s] - held[s]
    spark = at.sparkSession
    begins = spark.createDataFrame(begin, "shard int, linked boolean, p int, begin long")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("uid")) - 1
    ranked = at.withColumn("k", rank).join(F.broadcast(begins), cell).select("uid", "shard", (F.col("begin") + F.col("k")).alias("slot"))
    moved = F.col("slot") + _of("shard", over)  # the how manieth of all that are over
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, n in lack:
        to = F.when(moved >= first, F.lit(s)).otherwise(to)
        slot = F.when(moved >= first, moved - first + n).otherwise(slot)
    # evaluated from the last lacking shard on, as each `when` overrides the ones before it
    is_over = F.col("slot") >= _of("shard", share)
    return ranked.select("uid", F.when(is_over, to).otherwise(F.col("shard")).alias("shard"), F.when(is_over, slot).otherwise(F.col("slot")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = staged(documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"), F.monotonically_increasing_id().alias("uid")))
    groups = staged(docs.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.lit(True).alias("many")))
    nodes = staged(docs.join(groups, "group", "left").select("uid", F.when(F.col("many"), F.col("group")).alias("group")))
    placed = staged(place(propagate(nodes)))
    return docs.join(placed, "uid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
