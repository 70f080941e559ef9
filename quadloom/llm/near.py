"""MinHash near-duplicates by a chosen-path set similarity join, confirmed on whole sets.

1. Of each document: the set of its word shingles (64-bit hashes), a 128-bit mark of the set, REPEATS x DEPTH minwise
   tokens, a sketch of 128 bits (one of a minwise token each) and an odd sketch (parities of the set's elements by hash).
   Equal sets collapse to their smallest id at once.
2. Trees: at the root a document goes to one node for each of REPEATS minwise tokens. Nodes with few documents are
   compared exhaustively by sketch and size; the others branch by the next minwise token, to DEPTH. The members of nodes
   that are still large are compared with two leaders.
3. Candidate links are confirmed on whole sets, in rounds: first a link or two of each document, then what still joins
   different groups. Groups are connected components, found by iterated joins.
4. Large nodes whose members are of several groups by then are compared whole, if that takes WORK pairs at most. The
   others go on branching, by BRANCHES choices of DEPTH more tokens each, up to STRIDES times, until that holds, or they are
   small, of one group, or have few members outside the main group. Those few are compared with each other, and with the
   main group once for all nodes that they share. This goes in blocks of both sides, each pair of blocks under a key of its own: first a member is linked with the nearest of each other group, then with all that still
   are of different groups.

A pair at the threshold s is missed by one tree with probability 1 - s^DEPTH at most, so by all trees with (1 - s^DEPTH)^
REPEATS (4e-7 at 0.85, 2.6e-5 at 0.80); small nodes that stop early only lower it. The sketch rejects such a pair with
probability 7e-8 at most (SIGMAS); the odd sketch loses no pair. Between members of the large nodes of step 4 that need
all strides, a pair at 0.85 is missed with probability 1e-3 about. Nothing else loses a pair.

Defined cases: null and empty texts have empty sets, are linked with nothing and are kept; rows that repeat an id are
documents of their own; texts with fewer words than a shingle have one shingle of all their words; null ids take no part
in links and are kept; texts of any length are worked on whole, and equal ones once; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import documents, map_text, staged

REPEATS, DEPTH = 20, 4
#: Nodes of at most so many documents are compared pair by pair.
SMALL = 24
#: Of the 128 sketch bits a pair at similarity s agrees on (1 + s) / 2 in the mean; this many standard deviations are allowed.
SIGMAS = 6.5
#: Further branching of large nodes: times, and children a member has each time; nodes with so few members outside the
#: main group are compared at once; members of a block. A node of so few pairs with a member outside the main group is compared
#: whole, however its members are grouped (these pairs are no more than WORK ** 0.5 for each member).
STRIDES, BRANCHES, FEW, BLOCK, WORK = 3, 2, 64, 512, 1 << 22
#: Bits of the odd sketch: the parity of a set's elements by hash.
ODD = 1024
#: So many links at most are brought to the driver for their components, or sent to all executors; more are worked on by
#: shuffled joins.
AT_ONCE = 50_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, known: dict[bytes, int], width: int) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    words = word_hashes(text, known)
    if not len(words):
        return words
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        h = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            h = mix(h) * MIX + words[i : len(words) - k + 1 + i]
    return np.unique(mix(h))


def mark(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _known(cache: dict[bytes, int]) -> dict[bytes, int]:
    if len(cache) > 200_000:
        cache.clear()
    return cache


def profiles(df: DataFrame, keep, text: str, width: int) -> DataFrame:
    """`keep`, n (set size), mark (128 bits of the set), a and b (64-bit halves of the sketch), tokens (minwise), odd
    (the odd sketch)."""
    rng = np.random.default_rng(5)
    n_tokens = REPEATS * DEPTH
    seeds = rng.integers(1, 2**63, n_tokens + 128, dtype=np.uint64) | np.uint64(1)
    cache: dict[bytes, int] = {}

    def fn(texts):
        known = _known(cache)
        n, marks, first, second, tokens, odd = [], [], [], [], [], []
        for t in texts:
            s = shingles(t or "", known, width)
            n.append(len(s))
            if not len(s):
                marks.append(mark(s))
                first.append(0)
                second.append(0)
                tokens.append([])
                odd.append([])
                continue
            marks.append(mark(s))
            low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
            with np.errstate(over="ignore"):
                for at in range(0, len(s), 1024):  # multiply-xorshift of each seed; the upper bits order the tokens
                    x = s[None, at : at + 1024] * seeds[:, None]
                    x ^= x >> np.uint64(32)
                    x *= MIX
                    np.minimum(low, x.min(1), out=low)
            mixed = mix(low)
            parity = (np.bincount((s >> np.uint64(7)).astype(np.int64) & (ODD - 1), minlength=ODD) & 1).astype(np.uint8)
            odd.append(np.packbits(parity).view("<i8").tolist())
            halves = np.packbits((mixed[n_tokens:] & np.uint64(1)).astype(np.uint8)).view("<i8")
            first.append(int(halves[0]))
            second.append(int(halves[1]))
            tokens.append(mixed[:n_tokens].view(np.int64).tolist())
        return [n, marks, first, second, tokens, odd]

    return map_text(df, keep, text, "n long, mark binary, a long, b long, tokens array<long>, odd array<long>", fn)


def alike(x: str, y: str, percent: int) -> F.Column:
    """Sizes and sketches allow the similarity."""
    p = (1 + percent / 100) / 2
    most = int(128 * (1 - p) + SIGMAS * (128 * p * (1 - p)) ** 0.5)
    differ = F.bit_count(F.col(f"{x}.a").bitwiseXOR(F.col(f"{y}.a"))) + F.bit_count(F.col(f"{x}.b").bitwiseXOR(F.col(f"{y}.b")))
    return (100 * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= percent * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))) & (differ <= most)


def near_enough(x: F.Column, y: F.Column, n: F.Column, percent: int) -> F.Column:
    """Odd sketches x and y do not rule the similarity out. Bits that differ are no more than the elements that one set
    only has, so no pair is lost. n: elements of both."""
    differ = F.lit(0)
    for i in range(1, ODD // 64 + 1):
        differ = differ + F.bit_count(F.element_at(x, i).bitwiseXOR(F.element_at(y, i)))
    return (100 + percent) * differ <= (100 - percent) * n


def alike_odd(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (x, y) whose odd sketches allow the similarity."""
    both = pairs
    for c in ("x", "y"):
        both = both.join(reps.select(F.col("id").alias(c), F.col("odd").alias(f"o{c}"), F.col("n").alias(f"n{c}")), c)
    return both.where(near_enough(F.col("ox"), F.col("oy"), F.col("nx") + F.col("ny"), percent)).select("x", "y")


def trees(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """x < y: pairs that small nodes hold and sketches allow; and what the largest nodes hold (node, id, n, a, b).
    sets: id, n, a, b, tokens."""
    brief = ["id", "n", "a", "b"]
    rest = F.transform(F.sequence(F.lit(1), F.lit(DEPTH - 1)), lambda d: F.element_at("tokens", d * REPEATS + F.col("tree") + 1))
    at = sets.select(*brief, "tokens", F.posexplode(F.slice("tokens", 1, REPEATS)).alias("tree", "token")).select(*brief, F.xxhash64("tree", "token").alias("node"), rest.alias("rest"))
    found = None
    for depth in range(1, DEPTH + 1):
        sizes = staged(at.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"))
        at = staged(at.join(sizes, "node"))
        small = at.where(F.col("m") <= SMALL).select("node", *brief)
        pairs = small.alias("x").join(small.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.id") < F.col("y.id")) & alike("x", "y", percent))
        pairs = pairs.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
        found = pairs if found is None else found.union(pairs)
        at = at.where(F.col("m") > SMALL).drop("m")
        if depth < DEPTH:
            at = at.withColumn("node", F.xxhash64("node", F.element_at("rest", depth)))
    return found, at.select("node", *brief)


def small(df: DataFrame) -> DataFrame:
    """df (staged), sent to all executors where it is joined, if it has few rows."""
    return F.broadcast(df) if df.count() <= AT_ONCE else df


def few_components(edges: list[tuple]) -> list[tuple]:
    """Each id in edges with the smallest id that links reach."""
    up: dict = {}

    def find(a):
        while (b := up.setdefault(a, a)) != a:
            up[a] = a = up[b]
        return a

    for x, y in edges:
        a, b = find(x), find(y)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(a, find(a)) for a in list(up)]


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id in edges (staged; x < y): the smallest id that links reach. Up to AT_ONCE links the driver finds it.
    Of more, each round an id takes the smallest root next to it or to a member of its root, and then that root's root, until
    nothing changes. An id is next to itself, so one join gives its own root too."""
    if edges.count() <= AT_ONCE:
        found = few_components([tuple(r) for r in edges.select("x", "y").collect()])
        kind = edges.schema["x"].dataType
        return staged(edges.sparkSession.createDataFrame(found, T.StructType([T.StructField("id", kind), T.StructField("root", kind)])).coalesce(1))
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    state = staged(both.groupBy(F.col("x").alias("id")).agg(F.min(F.least("x", "y")).alias("root")))
    both = staged(both.union(state.select(F.col("id").alias("x"), F.col("id").alias("y"))))
    while True:
        near = both.join(state.select(F.col("id").alias("y"), F.col("root").alias("r")), "y").groupBy(F.col("x").alias("id"))
        moved = staged(near.agg(F.max(F.when(F.col("x") == F.col("y"), F.col("r"))).alias("root"), F.min("r").alias("r")))
        hooks = staged(moved.groupBy("root").agg(F.min("r").alias("to")))
        step = moved.join(hooks, "root").select("id", "root", F.least("r", "to").alias("r"))
        jump = hooks.select(F.col("root").alias("r"), F.col("to").alias("next"))
        new = step.join(jump, "r", "left").select("id", F.least("r", F.coalesce("next", "r")).alias("to"), "root")
        new = staged(new.select("id", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("changed")))
        if not new.where("changed").take(1):
            return new.select("id", "root")
        state = new.select("id", "root")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after more links (x, y). Only the roots that the links reach are worked on."""
    ends, known = links, small(roots)
    for c in ("x", "y"):
        ends = ends.join(known.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    ends = ends.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")).where("x != y")
    up = components(staged(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()))
    ids = links.select(F.col("x").alias("id")).union(links.select(F.col("y").alias("id"))).distinct().join(known, "id", "left_anti")
    every = roots.union(ids.select("id", F.col("id").alias("root"))).join(small(up).select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
    return staged(every.select("id", F.coalesce("to", "root").alias("root")))


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (x, y: marks) whose whole sets are similar enough. docs: id, text; reps: id (mark), rep (a struct
    with the doc id)."""
    cache: dict[bytes, int] = {}

    def fn(texts):
        sets = [shingles(t or "", _known(cache), width) for t in texts]
        return [[mark(s) for s in sets], [s.view(np.int64) for s in sets]]

    pairs = staged(pairs)
    if not pairs.take(1):
        return pairs
    ids = staged(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    own = staged(reps.join(small(ids), "id", "left_semi").select(F.col("rep.id").alias("id")).distinct())
    some = docs.join(small(own), "id", "left_semi")
    sets = staged(map_text(some, [], "text", "id binary, s array<long>", fn).dropDuplicates(["id"]))
    both = small(pairs).join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy")).cast("long")
    both = both.select("x", "y", shared.alias("i"), (F.size("sx") + F.size("sy")).cast("long").alias("t"))
    return staged(both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("x", "y"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends have different roots so far."""
    end = lambda c: F.coalesce(f"r{c}", c)
    both, known = pairs, small(roots)
    for c in ("x", "y"):
        both = both.join(known.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return both.where(end("x") != end("y")).select("x", "y")


def compared(asks: DataFrame, others: DataFrame, percent: int, every: bool) -> DataFrame:
    """x < y: pairs of an asking and another document of one key, of different groups, that both sketches allow; of each
    asking document and each other group in a block the nearest by sketch, or `every` pair. asks, others: key, id, n, a, b,
    root, odd, and how many of a key ask (k) and are asked (m), or these are counted. Both sides are dealt to blocks, and
    what is compared at once is a pair of blocks."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", "key"), blocks(n)).cast("int")
    if "k" not in asks.columns:
        sizes = asks.groupBy("key").agg(F.count("*").alias("k")).join(others.groupBy("key").agg(F.count("*").alias("m")), "key")
        asks, others = asks.join(sizes, "key"), others.join(sizes, "key")
    brief = ["key", "id", "n", "a", "b", "root", "odd"]
    both = others.select(*brief, F.lit(False).alias("asks"), own("m").alias("p"), each("k").alias("q"))
    both = both.union(asks.select(*brief, F.lit(True), each("m"), own("k")))
    p = (1 + percent / 100) / 2
    most = int(128 * (1 - p) + SIGMAS * (128 * p * (1 - p)) ** 0.5)

    def pairs(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        n = group["n"].to_numpy()
        ab = np.stack([group["a"].to_numpy(), group["b"].to_numpy()], 1).view(np.uint64)
        odd = np.array(group["odd"].to_pylist(), np.int64).reshape(len(n), -1).view(np.uint64)
        ids, roots = group["id"].to_pylist(), np.unique(np.array(group["root"].to_pylist(), object), return_inverse=True)[1]
        others = np.flatnonzero(~asks)
        x, y = [], []  # (an asking document that stands on the other side too is of its own group)
        for i in np.flatnonzero(asks).tolist():
            differ = np.bitwise_count(ab[others] ^ ab[i]).sum(1, dtype=np.int64)
            ok = (differ <= most) & (roots[others] != roots[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
            found = others[ok]
            near = (100 + percent) * np.bitwise_count(odd[found] ^ odd[i]).sum(1, dtype=np.int64) <= (100 - percent) * (n[found] + n[i])
            found, differ = found[near], differ[ok][near]
            if not every and len(found):
                order = np.lexsort((found, differ, roots[found]))
                found = found[order[np.r_[True, np.diff(roots[found][order]) != 0]]]
            for j in found.tolist():
                x.append(min(ids[i], ids[j]))
                y.append(max(ids[i], ids[j]))
        return pa.table({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    return both.groupBy("key", "p", "q").applyInArrow(pairs, "x binary, y binary").distinct()


def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df (id) with the root of each id."""
    return df.join(small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))


def mixed(large: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """What large nodes (node, id, n, a, b) of several groups hold, with root, odd and tokens."""
    at = staged(rooted(large, roots))
    several = at.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("node")
    return staged(at.join(several, "node", "left_semi").join(reps.select("id", "odd", "tokens"), "id"))


def children(at: DataFrame) -> DataFrame:
    """The next level below nodes (node, id, n, a, b, root, odd, tokens, main): BRANCHES children of each member, with the
    node above. A child that members of the main group only would be in holds one group, so it is not made: members outside the
    main group branch first, and the main group follows to where they went."""
    n_tokens = REPEATS * DEPTH
    chosen = lambda c, i: F.element_at("tokens", (F.pmod(F.xxhash64("node", F.lit(c), F.lit(i)), F.lit(n_tokens)) + 1).cast("int"))
    child = lambda c: F.xxhash64("node", F.lit(c), *[chosen(c, i) for i in range(DEPTH)])
    rest = ["id", "n", "a", "b", "root", "odd", "tokens"]
    outside = at.where(F.col("root") != F.col("main"))
    found = staged(outside.select(F.col("node").alias("above"), F.explode(F.array(*[child(c) for c in range(BRANCHES)])).alias("node"), *rest))
    reached = found.select("node").distinct()
    inside = at.where(F.col("root") == F.col("main"))
    for c in range(BRANCHES):
        made = inside.select(F.col("node").alias("above"), child(c).alias("node"), *rest)
        found = found.union(made.join(reached, "node", "left_semi").select("above", "node", *rest))
    return staged(found)


def deeper(levels: list[DataFrame], roots: DataFrame | None, percent: int, every: bool) -> DataFrame | None:
    """x < y: pairs of different groups that large nodes hold, as `compared` gives them. levels: the members (node, id, n, a,
    b, root, odd, tokens) of the large nodes, then of their children, as far as they are made; those missing are added.
    roots: where the groups have grown since the levels were made (a node that stops branching then needs no more levels, and
    none goes on that stopped before, as the members outside its main group only become fewer)."""
    found, going = None, None
    for stride in range(STRIDES + 1):
        at = levels[stride]
        if roots is not None:  # a child has the root that its row above was given
            at = at.drop("root")
            at = staged(at.join(going, ["above", "id"]) if stride else rooted(at, roots))
        counts = at.groupBy("node", "root").agg(F.count("*").alias("c")).groupBy("node")
        sizes = counts.agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
        at = staged(at.join(sizes.select("node", "m", (F.col("m") - F.col("top.c")).alias("k"), F.col("top.root").alias("main")), "node"))
        if not at.take(1):
            break
        whole = (F.col("k") > FEW) & (F.col("k") * F.col("m") <= WORK)
        now = (F.col("m") <= SMALL) | (F.col("k") <= FEW) | whole | F.lit(stride == STRIDES)
        # members outside the main group by node, with each other or with the whole node; with the main groups of the other
        # nodes once, whatever nodes they share
        outside = F.col("root") != F.col("main")
        node = at.where(now).select("id", "n", "a", "b", "root", "odd", "main", "k", F.when(whole, F.col("m")).otherwise(F.col("k")).alias("m"), whole.alias("whole"), F.col("node").alias("key"))
        pairs = compared(node.where(outside), node.where(outside | F.col("whole")), percent, every)
        keyed = [F.col("main").alias("key"), "id", "n", "a", "b", "root", "odd"]
        rest = at.where(now & ~whole)
        pairs = pairs.union(compared(rest.where(outside).select(*keyed).distinct(), rest.where(~outside).select(*keyed).distinct(), percent, every))
        pairs = staged(pairs)
        found = pairs if found is None else found.union(pairs)
        if stride < STRIDES:
            if not at.where(~now).take(1):
                break
            if len(levels) == stride + 1:
                levels.append(children(at.where(~now)))
            going = at.where(~now).select(F.col("node").alias("above"), "id", "root")
    return found


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: id, text, and what else tells its rows apart. Of each row: id, the other columns, n and mark; and of each set:
    id (its mark), rep (struct of the least id and the other columns) and root (one mark for each component)."""
    own = [c for c in docs.columns if c != "text"]
    made = staged(profiles(docs, own, "text", width))
    # equal sets are one node, known by the mark of the set
    some = made.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = staged(some.groupBy(F.col("mark").alias("id")).agg(F.min(F.struct(*own)).alias("rep"), F.any_value(F.struct("n", "a", "b", "tokens", "odd")).alias("p")).select("id", "rep", "p.*"))
    pairs, large = trees(reps, percent)
    brief = ["id", "n", "a", "b"]
    large = staged(large)
    # the members of large nodes are compared with two leaders
    chosen = F.struct(F.xxhash64("node", "id").alias("h"), *brief)
    both = large.groupBy("node").agg(F.array(F.min(chosen), F.max(chosen)).alias("l"))
    lead = staged(both.select("node", F.posexplode("l").alias("k", "l")).select("node", "k", *[F.col(f"l.{c}").alias(c) for c in brief]))
    ordered = [F.least("x.id", "y.id").alias("x"), F.greatest("x.id", "y.id").alias("y")]
    stars = large.alias("x").join(lead.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.id") != F.col("y.id")) & alike("x", "y", percent)).select(*ordered)
    links = staged(alike_odd(pairs.union(stars).distinct(), reps, percent))
    hooks = links.groupBy("y").agg(F.min("x").alias("x")).select("x", "y").union(links.groupBy("x").agg(F.max("y").alias("y")).select("x", "y")).distinct()
    sure = confirm(hooks, docs, reps, width, percent)
    roots = components(sure)
    more = confirm(apart(links.join(hooks, ["x", "y"], "left_anti"), roots), docs, reps, width, percent)
    levels = []
    # members of large nodes and other groups there: first the nearest, then what still is of different groups
    for every in (False, True):
        if more.take(1):
            roots = joined(roots, more)
        again = bool(levels)
        if not again:
            levels.append(mixed(large, reps, roots))
        rest = deeper(levels, roots if again else None, percent, every)
        if rest is None:
            break
        more = confirm(rest.distinct(), docs, reps, width, percent)
    else:
        if more.take(1):
            roots = joined(roots, more)
    return made, reps.select("id", "rep").join(roots, "id", "left").select("id", "rep", F.coalesce("root", "id").alias("root"))


def one_of_each(df: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """Rows of df: one of each component, with its smallest id (and of that id's texts there, the one of the least MD5), and
    all that take no part in links."""
    words = df[text].cast("string").rlike(r"[^ \t\n\x0b\f\r]")
    linked = df[id_].isNotNull() & F.coalesce(words, F.lit(False))
    # rows are told apart by id and text, as an id may be repeated with another text
    some = df.where(linked).withColumn("__h", F.unhex(F.md5(df[text].cast("string"))))
    _, named = grouped(some.select(F.col(id_).alias("id"), F.col("__h").alias("h"), F.col(text).cast("string").alias("text")), width, percent)
    chosen = named.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("__id"), F.col("rep.h").alias("__key"))
    one = some.join(chosen, (F.col(id_) == F.col("__id")) & (F.col("__h") == F.col("__key")), "left_semi").dropDuplicates([id_, "__h"])
    return df.where(~linked).unionByName(one.drop("__h"))


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """`id_`, n_shingles, component_id (the smallest id that links reach) and kept, a row for each row of df."""
    made, named = grouped(df.select(F.col(id_).alias("id"), df[text].cast("string").alias("text")), width, percent)
    # of each group of sets, the smallest document id
    named = named.select("id", "rep.id", "root").toDF("id", "rep", "root")
    smallest = staged(named.groupBy("root").agg(F.min("rep").alias("component")))
    named = staged(named.join(smallest, "root").select(F.col("id").alias("mark"), "component"))
    rows = made.select("id", "n", "mark").join(named, "mark", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    rows = rows.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(id_) == F.col("component_id"), F.lit(True)))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
