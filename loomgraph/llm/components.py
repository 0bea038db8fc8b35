"""Connected components of an edge list by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, scratch


class Forest:
    """Union-find over hashable nodes; the smallest node is the root."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self):
        return [(x, self.find(x)) for x in list(self.up)]


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Returns u, root for each node that isn't the smallest of its component.

    Each round halves paths; edges are written between rounds. The round's outcome is compared with the
    one before by its count and a hash of all its rows.
    """
    e = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, scratch(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        if (now := mark(e)) == was:
            break
        was = now
    return e.select("u", F.col("v").alias("root"))
