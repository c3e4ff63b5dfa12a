"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked with the least of them: the greater ones (large), or the lesser ones and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    out = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def shortened(edges: DataFrame) -> DataFrame:
    """A written table of edges (u, v), u > v, that connect what these connect, by one round of both stars: a star of edges becomes one of its least node."""
    return stored(_stars(_stars(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"), True), False), "stars")


def labels(edges: DataFrame) -> DataFrame:
    """(node, label): a node that each node with a lesser neighbour is connected with. Equal labels tell of one component; unequal ones of nothing."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge (u, v); component: its least node. Loops and repeated edges do no harm.

    Each round is written as a table, so a lost executor costs one round. The number of rounds grows with the logarithm of
    the longest chain.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    loops = edges.filter("u = v").select("u")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        old, now = now, stored(_stars(_stars(now, True), False), "stars")
        release(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct().withColumn("component", F.col("node"))
    out = stored(nodes.union(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
    release(now)
    return out
