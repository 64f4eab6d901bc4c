"""Groups of near-duplicates from bucket members, without pairing a bucket with itself.

A bucket (a band of a signature, a block of a hash) holds nodes that may be alike. Comparing all of
them grows with the square of a bucket, so links are found in rounds:

1. each node with its bucket's smallest node,
2. in buckets whose nodes are still in more than one component, each node with a hub picked by hash,
3. in what is still open, every pair of different components, except inside the bucket's largest one.

Round 3 tests every pair that could still join two components and was not tested before, so the components
are exactly those of the graph of all confirmed pairs that share a bucket. The number of pairs follows the
number of nodes unless a large bucket really holds many separate components: then the tests of round 3 grow
with the square of their number. Where a link can be judged from two rows, that is done inside of the join:
rows cross the network by bucket, not by pair, and no pair is written unless it is a link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_broadcast

#: Members of a bucket that one part of round 3 compares with all of it.
PART = 256


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for every node in an edge.

    Large-star and small-star contraction in turn: each round is two shuffles with map-side minimums,
    and the rounds grow with the logarithm of the longest chain. No group is held in memory.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = scratch.keep(small, "small")
        sums = total(following)
        scratch.drop(now, large)
        now = following
        if sums == before:
            break
        before = sums
    else:
        if before[0]:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def multiple(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (key, node) of keys that hold two different nodes or more, with their smallest as hub and their number n; written.

    members is computed twice, but crosses the network only once where few keys are left.
    """
    keys = scratch.keep(members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).where("hub < last").select("key", "hub", "n"), "keys")
    out = scratch.keep(members.join(few_broadcast(keys), "key"), "members")
    scratch.drop(keys)
    return out


def _candidates(left: DataFrame, light: DataFrame, may: Callable[[str, str], Column], scratch: Scratch) -> DataFrame:
    """The rows of left (key, node, component, main, parts) that may be linked, by may(), with one of another component in their bucket.

    Rows are let through, not pairs: only numbers cross the network, and no more rows are written than left has.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    marked = scratch.keep(left.join(light, "node"), "light")
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    to_all = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meeting(some: DataFrame, others: DataFrame) -> DataFrame:
        x, y = (df.repartition(parts, "key", "part").alias(name) for df, name in ((dealt(some), "x"), (to_all(others), "y")))
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
        return x.join(y, same & F.when(F.col("x.component") != F.col("y.component"), may("x.", "y.")).otherwise(F.lit(False)), "left_semi").drop("part")

    rest = scratch.keep(meeting(marked.where("component <> main"), marked), "rest")
    # those of the largest component meet only what is left of the others, never one another
    main = meeting(marked.where("component = main"), rest)
    both = scratch.keep(rest.union(main).select(*left.columns), "candidates")
    scratch.drop(marked, rest)
    return both


def link_buckets(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], scratch: Scratch, marks: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], judged: bool = False, light: tuple[DataFrame, Callable[[str, str], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the confirmed pairs in buckets, and the links that were confirmed.

    members: (key, node, hub, n) as from multiple(), written. confirm: takes candidate pairs (a, b), a < b,
    and returns those that are links. marks: (node, ...) of some nodes (written, column node), what near() reads:
    whether the rows named by two prefixes (x., y.) with the same key may be a link at all, true for one key only of
    those a pair shares. judged: near() is the whole test of a link, so that confirm is not asked in round 3. light: (node, numbers)
    of all nodes, and a cheap test of them that is true for every link; only rows that pass it with another get marks.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    first = members.where("node <> hub").select(*pair("node", "hub")).distinct()
    links = scratch.keep(confirm(first), "links1")
    labels = scratch.keep(components(links, scratch), "labels1")
    for step in (2, 3):
        # two nodes of a bucket have met in round 1; written, as both sides of the join below would shuffle the members by node
        named = members.where("n > 2").join(labels, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("component"))
        named = scratch.keep(named, f"named{step}")
        open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        still = scratch.keep(named.join(open_keys, "key"), f"open{step}")
        scratch.drop(named)
        if step == 2:
            rank = F.xxhash64("key", "node")
            pick = still.groupBy("key").agg(F.min(rank).alias("rank")).join(still.withColumn("rank", rank), ["key", "rank"]).groupBy("key").agg(F.min("node").alias("other"), F.min("component").alias("its"))
            pairs = still.join(pick, "key").where("component <> its and node <> other and node <> hub and other <> hub").select(*pair("node", "other")).distinct()
            more = scratch.keep(confirm(pairs), "links2")
            scratch.drop(still)
        else:
            sizes = still.groupBy("key", "component").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.ceil(F.sum("n") / PART).cast("int").alias("parts")).select("key", F.col("top.component").alias("main"), "parts")
            # every node has met its hub
            left = still.where("node <> hub").join(largest, "key").select("key", "node", "component", "main", "parts")
            left = scratch.keep(left, "left")
            scratch.drop(still)
            if light:
                every = left
                left = _candidates(every, *light, scratch)
                scratch.drop(every)
            nodes = scratch.keep(left.select("node").distinct(), "nodes")
            own = scratch.keep(marks(nodes), "marks")
            marked = scratch.keep(left.join(own, "node"), "marked")
            scratch.drop(left, nodes, own)
            rest = marked.where("component <> main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            all_ = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            # the tests take the time, not the bytes: AQE would join them into a few tasks
            x, y = (df.repartition(parts, "key", "part").alias(name) for df, name in ((rest, "x"), (all_, "y")))
            # two nodes outside the largest component meet once, not twice
            order = (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
            apart = (F.col("x.component") != F.col("y.component")) & order
            same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
            pairs = x.join(y, same & F.when(apart, near("x", "y")).otherwise(F.lit(False))).select(*pair("x.node", "y.node"))
            pairs = scratch.keep(pairs, "pairs3")
            scratch.drop(marked)
            more = pairs if judged else scratch.keep(confirm(pairs), "links3")
        if more.isEmpty():
            if step == 2:
                continue
            break
        links = links.union(more)
        before = labels
        labels = scratch.keep(components(before.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")), scratch), f"labels{step}")
        scratch.drop(before)
    return labels, links
