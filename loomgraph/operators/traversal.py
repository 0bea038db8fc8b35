"""Traversal to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.session import shared_folder


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, paths: bool = False) -> DataFrame:
    """All nodes that can be reached: root, node, depth (the least) and, if asked for, the path as an array of nodes.

    edges: u, v; starts: u. Semi-naive: a round joins only the nodes found in the round before with the edges, and an
    anti join keeps what is known out, so a cycle ends and no node is walked on twice. Each round is written to the
    shared folder, so its lineage is cut, and tells by an observation whether it found anything. Of several shortest
    paths the one that is least, node by node, is given; rounds end after `most` steps where that is set.

    Null nodes are no nodes; repeated edges and starts count once, and a start is reached from itself at depth 0.
    """
    spark = edges.sparkSession
    base = shared_folder(spark, "reach")
    edges.where("u is not null and v is not null").select("u", "v").distinct().write.parquet(f"{base}/edges")
    pairs = spark.read.parquet(f"{base}/edges")
    kind = pairs.schema["u"].dataType.simpleString()
    shape = f"root {kind}, node {kind}" + (f", path array<{kind}>" if paths else "")

    def save(found: DataFrame, depth: int) -> int:
        seen = Observation()
        found.observe(seen, F.count("*").alias("n")).write.parquet(f"{base}/found/depth={depth}")
        return seen.get["n"]

    first = starts.where("u is not null").select(F.col("u").cast(kind).alias("root")).distinct().withColumn("node", F.col("root"))
    n, depth = save(first.withColumn("path", F.array("node")) if paths else first, 0), 0
    while n and (most is None or depth < most):
        front = spark.read.schema(shape).parquet(f"{base}/found/depth={depth}")
        step = front.join(pairs, F.col("node") == F.col("u")).select("root", F.col("v").alias("node"), *(["path"] if paths else []))
        step = step.groupBy("root", "node").agg(F.min("path").alias("path")) if paths else step.distinct()
        new = step.join(spark.read.schema(shape).parquet(f"{base}/found").select("root", "node"), ["root", "node"], "left_anti")
        depth += 1
        n = save(new.withColumn("path", F.array_append("path", F.col("node"))) if paths else new, depth)
    return spark.read.schema(f"{shape}, depth int").parquet(f"{base}/found").select("root", "node", "depth", *(["path"] if paths else []))
