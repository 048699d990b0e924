"""Connected components of an edge table (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """One row ``node, component`` for every node that an edge names; component = smallest node id reached.

    Each round maps every node to the lowest neighbour by hashed id (``xxhash64`` of a
    long is one-to-one, so hashed ids identify nodes and their order is random, which
    keeps chains short), follows that map three more times, and rewrites the edges through
    it; edges inside a contracted group vanish.  Rounds grow with the logarithm of the
    graph.  Every step is a join or a partially aggregated ``min``: no neighbour list is
    ever gathered, so hubs cost no more than other rows.  Rows with a null end and self
    loops name nodes but link nothing.
    """
    spark = edges.sparkSession
    tmp = Scratch(spark, "components")
    ends = edges.select(F.col(src).cast("long").alias("s"), F.col(dst).cast("long").alias("d"))
    pairs = ends.where("s <> d").select(F.xxhash64("s").alias("a"), F.xxhash64("d").alias("b"))
    now = tmp.write(_canonical(pairs), "edges")
    first, maps = now, []
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        both = now.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(now.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p"))
        step = tmp.write(_twice(tmp.write(_twice(low), "twice")), "map")
        maps.append(step)
        left = now.join(step.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a")
        moved = left.join(step.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
        now = tmp.write(_canonical(moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = ends.select(F.col("s").alias("node")).unionByName(ends.select(F.col("d").alias("node"))).where("node is not null").distinct()
    label = named.select("node", F.xxhash64("node").alias("c"))
    for step in maps:
        label = label.join(step.select(F.col("n").alias("c"), "p"), "c", "left").select("node", F.coalesce("p", "c").alias("c"))
    label = tmp.write(label, "labels")
    tmp.drop(first, *maps)
    root = label.groupBy("c").agg(F.min("node").alias("component"))
    return label.join(root, "c").select("node", "component")


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _twice(step: DataFrame) -> DataFrame:
    """The map applied to its own result."""
    onward = step.select(F.col("n").alias("p"), F.col("p").alias("q"))
    return step.join(onward, "p", "left").select("n", F.coalesce("q", "p").alias("p"))
