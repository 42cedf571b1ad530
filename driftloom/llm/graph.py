"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and grouped minima; the only value that reaches the driver is a checksum of the edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release

Alike = Callable[[Column, Column], Column]


#: Edges up to which a round is dealt over tasks of EACH edges, so that a round on no more than EACH is one task without a
#: shuffle; beyond SMALL, the session's settings tell.
SMALL, EACH = 1_000_000, 50_000


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """The different edges, those of one ``a`` together: what joins and groups by ``a`` moves nothing more."""
    if n <= EACH:
        return edges.coalesce(1).distinct()
    return (edges.repartition(n // EACH + 1, "a") if n <= SMALL else edges.repartition("a")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = _dealt(edges.union(edges.select("b", "a")), n)
    if n <= EACH:  # a join would deal the rows of one task anew
        return both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame, n: int) -> DataFrame:
    """``down`` has edges from the greater to the smaller node, as the large star gives them."""
    down = _dealt(down, n)
    if n <= EACH:
        return down.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a and b of one ordered type, no nulls).

    The component is its smallest node. Self-loops and repeated edges are allowed; no edges give no rows."""
    now = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    was = None
    while True:
        n, mark = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mark) == was or n == 0:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
            return out.coalesce(1) if n <= EACH else out
        was = n, mark
        now = checkpointed(_dealt(_small_star(_large_star(now, n), n).filter("a <> b"), n))


#: Nodes of a key compared with all others of it in one task.
TILE = 1024
#: Pairs for each entry up to which all are compared.
FEW = 8


def _led(mixed: DataFrame, alike: Alike, turn: int) -> DataFrame:
    """(a, b): each node with one leader of another component, if it has any that is alike."""
    leader = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "x", "c")).alias("l"))
    met = mixed.join(leader, "key").filter((F.col("c") != F.col("l.c")) & alike(F.col("x"), F.col("l.x")))
    return met.groupBy(F.col("node").alias("b")).agg(F.min("l.node").alias("a")).select("a", "b")


def _across(mixed: DataFrame, classes: DataFrame, alike: Alike) -> DataFrame:
    """(a, b): all pairs of alike nodes that share a key and are of different components.

    Nodes outside a key's largest component meet all others of the key; they are dealt over tiles, to each of which the
    others come."""
    sizes = classes.groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("largest"), F.ceil(F.sum("m") / TILE).alias("tiles"))
    sized = mixed.join(sizes, "key")
    one = sized.filter("c <> largest").select("key", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), F.col("node").alias("a"), F.col("x").alias("p"), F.col("c").alias("ca"))
    two = sized.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.col("node").alias("b"), F.col("x").alias("q"), F.col("c").alias("cb"), (F.col("c") == F.col("largest")).alias("big"))
    met = one.join(two, ["key", "tile"]).filter((F.col("big") | (F.col("ca") < F.col("cb"))) & alike(F.col("p"), F.col("q")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, met: DataFrame, alike: Alike, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the graph of ``edges`` and of those pairs of nodes that share a key, are alike and verified.

    ``met`` has (key, node, x), ``alike`` judges two values of x, ``verify`` keeps of (a, b) the pairs that are linked.
    Only components are asked for, so nodes that are connected already need no comparison. As long as the keys hold many
    pairs of different components, each node is compared with one leader of its keys, which makes pairs in proportion to
    the nodes; what is still apart then is compared pair by pair."""
    turn, before = 0, None
    while True:
        labels = components(edges)
        now = met.join(labels, "node", "left").select("key", "node", "x", F.coalesce("component", "node").alias("c"))
        several = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
        mixed = checkpointed(now.join(several, "key"))
        classes = checkpointed(mixed.groupBy("key", "c").agg(F.count("*").alias("m")))
        sums = classes.groupBy("key").agg(F.sum("m").cast("double").alias("s"), F.sum(F.col("m").cast("double") * F.col("m")).alias("q"))
        total, n = sums.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
        if not total:
            return labels
        # all pairs if they are few, or if another turn of leaders does not make them much fewer
        last = total <= FEW * n or (before is not None and 2 * total > before)
        pairs = checkpointed(_across(mixed, classes, alike) if last else _led(mixed, alike, turn))
        # keys of one component stay so, and the stars of the components stand for the edges so far
        met = mixed.select("key", "node", "x")
        edges = checkpointed(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verify(pairs)))
        if last:
            return components(edges)
        turn, before = turn + 1, total
        release(edges.sparkSession)  # a turn's many shuffles are small, so the heap does not fill before the disk does
