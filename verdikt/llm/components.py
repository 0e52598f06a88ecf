"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links to (node, root): root is the least node of node's component.

    Alternates large-star and small-star until nothing changes. A round is joins of
    links with the minimum of each node, grouped with partial aggregation: the
    neighbours of a node never meet in one task, and as both sides are dealt by node already
    none is sent to all executors. Every round is written, so lost
    executors cost at most the round in work. Nodes without a link have no row.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = large.join(least.hint("merge"), "u")
        small = links.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(links.select("u", F.col("m").alias("v")))
        edges = written(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
