"""Trees of any size: parents, depth-first places, distances and subtree sizes by Euler tours and pointer doubling.

No step holds a fragment in one task.  Each edge becomes two arcs, and each arc's successor is the next arc around the vertex that it
enters, so the arcs of a tree make one tour that ends where it comes back to the root for the last time.  Doubling the
successors finds every arc's distance from the end in a logarithmic number of joins: of an edge's two arcs the earlier one leads
away from the root, and what lies between them is the subtree.  Then the parents are doubled in the same way, which sums
places, lengths and counts from the root down.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch


def rooted(lengths: DataFrame, roots: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``frag_id, vid, parent, size, pos, depth, dist, above``: every vertex that a root reaches.

    lengths (frag_id, u, v, len) are the edges of a forest, roots (frag_id, vid) one vertex of each tree to be walked.  ``pos`` is the place in
    the tree's depth-first order by vertex id, ``dist`` the length of the path from the root, ``size`` counts the subtree with the
    vertex itself, ``above`` sums counts (frag_id, vid, n) over the vertices before this one on that path.  A cycle is an error.
    """
    tmp = Scratch(lengths.sparkSession, "tours")
    same = W.partitionBy("frag_id", "u", "v")
    once = lengths.where("u <> v").select("frag_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("len").cast("double").alias("length")).withColumn("_r", F.row_number().over(same.orderBy("length"))).where("_r = 1").drop("_r")
    edges = tmp.write(once.withColumn("k", F.monotonically_increasing_id()), "edges")
    # A row for each vertex and neighbour: the arcs out (2k from u, 2k + 1 from v) and in.
    out, back = 2 * F.col("k"), 2 * F.col("k") + 1
    sides = edges.select("frag_id", F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("head"), out.alias("out"), back.alias("into")), F.struct(F.col("v").alias("vid"), F.col("u").alias("head"), back.alias("out"), out.alias("into")))).alias("s")).select("frag_id", "s.*")
    around = W.partitionBy("frag_id", "vid").orderBy("head")
    sides = sides.withColumn("succ", F.lead("out").over(around)).withColumn("_first", F.first("out").over(around))
    sides = sides.join(roots.select("frag_id", "vid", F.lit(True).alias("_root")), ["frag_id", "vid"], "left")
    tour = tmp.write(sides.select(F.col("into").alias("id"), F.when(F.col("succ").isNotNull(), F.col("succ")).when(F.col("_root").isNull(), F.col("_first")).alias("next"), F.lit(1).cast("long").alias("d")), "tour")
    longest = edges.groupBy("frag_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(2 * longest + 1))):
        ahead = tour.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("d").alias("_d"))
        then = tmp.write(tour.join(ahead, "next", "left").select("id", F.col("_n").alias("next"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")), "tour")
        tmp.drop(tour)
        tour = then
    # What no root reaches never ends.
    both = tour.where("next is null").groupBy(F.expr("id div 2").alias("k")).agg(F.max_by("id", "d").alias("id"), F.count("*").alias("c"), ((F.max("d") - F.min("d") + 1) / 2).cast("long").alias("size"))
    away = F.col("id") % 2 == 0
    down = edges.join(both, "k").select("frag_id", F.when(away, F.col("u")).otherwise(F.col("v")).alias("parent"), F.when(away, F.col("v")).otherwise(F.col("u")).alias("vid"), "length", "size", "c")
    down = tmp.write(down, "down")
    odd = down.groupBy("frag_id", "vid").agg(F.count("*").alias("n"), F.min("c").alias("c")).join(roots.select("frag_id", "vid", F.lit(1).alias("_one")).distinct(), ["frag_id", "vid"], "left")
    if not odd.where("n + coalesce(_one, 0) > 1 or c < 2").isEmpty():
        raise ValueError("a fragment has a cycle, or two roots in one tree")
    elder = W.partitionBy("frag_id", "parent").orderBy("vid").rowsBetween(W.unboundedPreceding, -1)
    steps = down.select("frag_id", "vid", "parent", "size", F.col("parent").alias("anc"), (1 + F.coalesce(F.sum("size").over(elder), F.lit(0))).alias("pos"), F.lit(1).cast("long").alias("depth"), F.col("length").alias("dist"))
    below = down.groupBy("frag_id", F.col("parent").alias("vid")).agg((F.sum("size") + 1).alias("size"))
    tops = roots.select("frag_id", "vid").distinct().join(below, ["frag_id", "vid"], "left").select("frag_id", "vid", F.lit(None).cast("long").alias("parent"), F.coalesce("size", F.lit(1)).alias("size"), F.lit(None).cast("long").alias("anc"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("dist"))
    tree = steps.unionByName(tops)
    if counts is None:
        tree = tree.withColumn("above", F.lit(0).cast("long"))
    else:
        n = counts.select("frag_id", F.col("vid").alias("anc"), F.col("n").cast("long").alias("above"))
        tree = tree.join(n, ["frag_id", "anc"], "left").withColumn("above", F.coalesce("above", F.lit(0).cast("long")))
    sums = ["pos", "depth", "dist", "above"]
    tree = tmp.write(tree.select("frag_id", "vid", "parent", "size", "anc", *sums), "tree")
    while not tree.where("anc is not null").isEmpty():
        ahead = tree.select("frag_id", F.col("vid").alias("anc"), F.col("anc").alias("_a"), *[F.col(c).alias(f"_{c}") for c in sums])
        then = tree.join(ahead, ["frag_id", "anc"], "left")
        then = tmp.write(then.select("frag_id", "vid", "parent", "size", F.col("_a").alias("anc"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]), "tree")
        tmp.drop(tree)
        tree = then
    return tree.drop("anc")


def marked_above(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """``frag_id, vid, before``: the nearest of the marked vertices (frag_id, vid) before each vertex on its path from the root; null if none is."""
    tmp = Scratch(tree.sparkSession, "above")
    flag = marked.select("frag_id", F.col("vid").alias("anc"), F.lit(True).alias("_m")).distinct()
    look = lambda df: df.join(flag, ["frag_id", "anc"], "left").select("frag_id", "vid", "anc", F.coalesce("_m", F.lit(False)).alias("found"))
    now = tmp.write(look(tree.select("frag_id", "vid", F.col("parent").alias("anc"))), "above")
    while not now.where("anc is not null and not found").isEmpty():
        ahead = now.select("frag_id", F.col("vid").alias("anc"), F.col("anc").alias("_a"), F.col("found").alias("_f"))
        then = now.join(ahead, ["frag_id", "anc"], "left")
        then = tmp.write(then.select("frag_id", "vid", F.when(F.col("found"), F.col("anc")).otherwise(F.col("_a")).alias("anc"), (F.col("found") | F.coalesce("_f", F.lit(False))).alias("found")), "above")
        tmp.drop(now)
        now = then
    return now.select("frag_id", "vid", F.col("anc").alias("before"))
