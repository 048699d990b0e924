"""Clusterings of edge tables, as loops of joins with written rounds."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import cosine, log_odds, norm
from pointweave.operators.components import connected_components
from pointweave.operators.metrics import pairwise
from pointweave.sources.scratch import Scratch


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, cluster``: connected components, named by their lowest node; nodes without edges stay (G1)."""
    found = connected_components(edges)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def threshold_clusters(nodes: DataFrame, edges: DataFrame, t: float, same_seg_t: float | None = None) -> DataFrame:
    """Components of edges (src, dst, p, etype) with p >= t; edges of type 0 may have a threshold of their own."""
    need = F.lit(t) if same_seg_t is None else F.when(F.col("etype") == 0, same_seg_t).otherwise(t)
    return components(nodes, edges.where(F.col("p") >= need))


def calibrated_threshold(nodes: DataFrame, edges: DataFrame, thresholds: list[float]) -> list[tuple[float, float]]:
    """(pairwise F1, threshold) of components at each of a few thresholds, the best first (A35); nodes (node, label)."""
    out = []
    for t in thresholds:
        parts = threshold_clusters(nodes, edges, t).join(nodes.select("node", "label"), "node")
        out.append((pairwise(parts, "cluster", "label", empty=0.0).first()["f1"], t))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def boundary_edges(edges: DataFrame, low: float, high: float, top: int, score: str = "p") -> DataFrame:
    """The edges in an ambiguous band, the nearest to its middle first."""
    return edges.where(F.col(score).between(low, high)).orderBy(F.abs(F.col(score) - (low + high) / 2), "src", "dst", score).limit(top)


def claimed(nodes: DataFrame, edges: DataFrame, parts: DataFrame, floor: float) -> DataFrame:
    """Clusters after every singleton has joined the cluster of its best neighbour above the floor, all at once."""
    size = parts.groupBy("cluster").agg(F.count("*").alias("_n"))
    single = parts.join(size, "cluster").where("_n = 1").select("node")
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "p").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "p"))
    best = both.where(F.col("p") >= floor).join(single, "node", "left_semi").groupBy("node").agg(F.max_by("other", F.struct("p", -F.col("other"))).alias("other"))
    claims = best.select(F.col("node").alias("src"), F.col("other").alias("dst"))
    own = parts.where("node <> cluster").select(F.col("node").alias("src"), F.col("cluster").alias("dst"))
    return components(nodes, claims.unionByName(own))


def embedding_clusters(nodes: DataFrame, edges: DataFrame, t: float) -> DataFrame:
    """Components of candidate edges whose nodes' embeddings have a cosine of t or more (G20); nodes (node, dna)."""
    j = edges.join(nodes.select(F.col("node").alias("src"), F.col("dna").alias("_a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("dna").alias("_b")), "dst")
    return components(nodes, j.where(cosine("_a", "_b") >= t).select("src", "dst"))


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``y`` (1: labels agree) and ``known`` (neither is 0)."""
    j = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst")
    return j.withColumn("y", (F.col("_a") == F.col("_b")).cast("int")).withColumn("known", (F.col("_a") != 0) & (F.col("_b") != 0)).drop("_a", "_b")


def edge_targets(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``seg_connectivity``: 0.5 where an end has no id, 1 where both agree, else 0."""
    j = edges.join(ids.select(F.col("node").alias("src"), F.col("seg").alias("_a")), "src").join(ids.select(F.col("node").alias("dst"), F.col("seg").alias("_b")), "dst")
    return j.withColumn("seg_connectivity", F.when((F.col("_a") == 0) | (F.col("_b") == 0), 0.5).when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).drop("_a", "_b")


def signed_weights(edges: DataFrame, bias: float = 0.0, p: str = "p") -> DataFrame:
    """``src, dst, w``: log odds of each edge's probability, plus a bias."""
    return edges.select("src", "dst", (log_odds(p) + bias).alias("w"))


def _contract(edges: list[tuple[int, int, int, int, int]], least: int = 1) -> dict[int, int]:
    """Greedy additive contraction of edges (a, b, w, and the key that parts equal weights): join the two groups with the greatest summed weight until none has ``least`` or more.

    Parallel edges add up and keep the lower key.  The group with fewer neighbours moves into the other.
    """
    near: dict[int, dict[int, tuple[int, int, int]]] = {}
    for a, b, *e in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = tuple(e)
    name, parent = {x: x for x in near}, {x: x for x in near}
    heap = [(-w, *key, a, b) for a, row in near.items() for b, (w, *key) in row.items() if a < b and w >= least]
    heapq.heapify(heap)
    while heap:
        w, p, q, a, b = heapq.heappop(heap)
        if a not in near or near[a].get(b) != (-w, p, q):
            continue  # stale
        keep, gone = (a, b) if len(near[a]) >= len(near[b]) else (b, a)
        parent[gone], name[keep] = keep, min(name[a], name[b])
        del near[keep][gone]
        for x, e in near.pop(gone).items():
            if x == keep:
                continue
            del near[x][gone]
            old = near[keep].get(x)
            if old:
                e = (old[0] + e[0], *min(old[1:], e[1:]))
            near[keep][x] = near[x][keep] = e
            if e[0] >= least:
                heapq.heappush(heap, (-e[0], *e[1:], keep, x))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    return {x: name[find(x)] for x in parent}


_EDGE = ["a", "b", "w", "p", "q"]


def _summed(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: weights add up, the lower key stays."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"), F.min(F.struct("p", "q")).alias("k")).select("a", "b", "w", "k.p", "k.q")


def _moved(edges: DataFrame, to: DataFrame, *ends: str) -> DataFrame:
    """Edges with ends renamed by (node, cluster)."""
    for c in ends:
        edges = edges.join(to.select(F.col("node").alias(c), F.col("cluster").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return edges


def _blocks(tmp: Scratch, edges: DataFrame, least: int) -> DataFrame:
    """``node, cluster``: groups of nodes between which no summed weight can reach ``least``, however they are contracted.

    Nodes that an edge of that weight joins are of one block, and so are two blocks whose positive edges add up to it.
    """
    up = edges.where("w > 0").select("a", "b", "w")
    links, label = up.where(F.col("w") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst")), None
    while True:
        step = connected_components(links).withColumnRenamed("component", "cluster")
        if label is None:
            label = step
        else:
            ahead = step.select(F.col("node").alias("cluster"), F.col("cluster").alias("_to"))
            label = label.join(ahead, "cluster", "left").select("node", F.coalesce("_to", "cluster").alias("cluster")).unionByName(step.join(label.select("node"), "node", "left_anti"))
        label = tmp.write(label, "blocks")
        up = tmp.write(_moved(up, step, "a", "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "between")
        links = up.where(F.col("w") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if links.isEmpty():
            return label


def correlation_clusters(nodes: DataFrame, weights: DataFrame, group_limit: int = 100_000) -> DataFrame:
    """``node, cluster``: greedy additive edge contraction of signed weights (src, dst, w).

    Parallel edges add up; the two clusters with the greatest positive sum join, until none is left.  Of equal sums the one that holds the
    lowest edge goes first.  Weights count in units of 1e-9, so that sums don't depend on their order.

    The result is that of one contraction after another, for graphs of any size:

    * a node with one edge only changes nobody's sums, so it joins at once if the weight is positive, a hub's leaves all in one step;
    * for a weight t, the graph falls into blocks between which no sum can reach t, whatever contracts.  Each block is contracted down to t in
      a task of its own; then clusters are renamed, parallel edges summed, and a lower t follows.

    t is as low as lets no block have more than ``group_limit`` edges, and zero where the whole graph's components are that small.  If even the
    greatest weight makes a larger block, that block is one task: its edges of that weight follow each other.
    """
    tmp = Scratch(nodes.sparkSession, "correlation")
    raw = weights.where("src <> dst and w is not null").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b"), F.round(F.col("w") * 1e9).cast("long").alias("w"))
    now = tmp.write(_summed(raw.select("a", "b", "w", F.col("a").alias("p"), F.col("b").alias("q"))), "weights")
    label = nodes.select(F.col("node").cast("long").alias("node"), F.col("node").cast("long").alias("cluster"))

    def renamed(to: DataFrame) -> None:
        nonlocal now, label
        label = tmp.write(_moved(label, to.withColumnRenamed("node", "_n").select(F.col("_n").alias("node"), "cluster"), "cluster"), "labels")
        now = tmp.write(_summed(_moved(now, to, "a", "b")), "round")

    tried = 0.0  # the share of edges, from the greatest weight down, that made blocks small enough last time
    while not now.where("w > 0").isEmpty():
        edges, least, block = now.count(), 1, None
        if edges > group_limit:
            degree = now.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select("node", F.lit(True).alias("_leaf"))
            leaves = now.join(degree.withColumnRenamed("node", "a").withColumnRenamed("_leaf", "la"), "a", "left").join(degree.withColumnRenamed("node", "b").withColumnRenamed("_leaf", "lb"), "b", "left").where("la or lb")
            leaves = tmp.write(leaves, "leaves")
            if not leaves.isEmpty():
                # A star is named by its lowest node, so hub and leaves move together.
                joined = leaves.where("w > 0").select(F.when(F.col("la"), F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(F.col("la"), F.col("a")).otherwise(F.col("b")).alias("node"))
                low = joined.groupBy("hub").agg(F.least(F.min("node"), F.first("hub")).alias("cluster"))
                to = tmp.write(joined.join(low, "hub").select("node", "cluster").unionByName(low.select(F.col("hub").alias("node"), "cluster")), "peeled")
                now = now.join(leaves.select("a", "b"), ["a", "b"], "left_anti")
                renamed(to)
                continue
            share = min(0.25, 8 * tried)
            while True:
                if share:
                    least = now.where("w > 0").agg(F.percentile_approx("w", 1 - share, 100_000)).first()[0]
                block = _blocks(tmp, now, least)
                inside = _moved(now.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), block, "ca", "cb").where("ca = cb")
                largest = inside.groupBy("ca").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
                if largest <= group_limit or share and share * edges < 1:
                    break
                share = share / 8 if share else 0.25
            tried = share
        tagged = now.select(*_EDGE, F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb")) if block is None else _moved(now.select(*_EDGE, F.col("a").alias("ca"), F.col("b").alias("cb")), block, "ca", "cb").where("ca = cb")

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:  # noqa: B023
            found = _contract(list(zip(*[pdf[c].tolist() for c in _EDGE])), least)
            return pd.DataFrame([(x, c) for x, c in found.items() if x != c], columns=["node", "cluster"], dtype="int64")

        renamed(tmp.write(tagged.groupBy("ca").applyInPandas(solve, "node long, cluster long"), "solved"))
    return label


def greedy_clusters(nodes: DataFrame, edges: DataFrame, t: float = 0.5, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """``node, cluster``: in hash order each node joins the neighbouring cluster of the highest mean p among edges with p >= t, or opens its own.

    Exactly the sequential result: a round decides every node whose earlier neighbours are all decided, as in a maximal independent set by
    random priorities, so rounds grow with the logarithm of a graph of bounded degree.  An edge is read with the round that decides
    its earlier end, adds its vote to the later end's sums, and is gone; decisions are appended.  A tie goes to the lower cluster
    id; a cluster is named by the node that opened it.  Means count p in units of 1e-12.
    """
    tmp = Scratch(nodes.sparkSession, "greedy")
    both = edges.select(F.col("src").alias("n"), F.col("dst").alias("m"), "p").unionByName(edges.select(F.col("dst").alias("n"), F.col("src").alias("m"), "p"))
    both = both.where("n <> m").groupBy("n", "m").agg(F.max("p").alias("p"))
    before = F.struct(F.xxhash64("m", F.lit(seed)), F.col("m")) < F.struct(F.xxhash64("n", F.lit(seed)), F.col("n"))
    waits = both.where(before).join(nodes.select(F.col("node").alias("n")), "n", "left_semi").join(nodes.select(F.col("node").alias("m")), "m", "left_semi")
    waits = tmp.write(waits.select("n", "m", F.when(F.col("p") >= t, F.col("p").cast("decimal(20,12)")).alias("p")), "waits")
    new = tmp.write(nodes.select(F.col("node").alias("n")).join(waits.select("n").distinct(), "n", "left_anti").select("n", F.col("n").alias("cluster")), "decided")
    done, votes = [new], None
    for _ in range(max_rounds - 1):
        if new.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), done).select(F.col("n").alias("node"), "cluster")
        told = tmp.write(waits.join(new.select(F.col("n").alias("m"), "cluster"), "m").select("n", "cluster", "p"), "told")
        rest = tmp.write(waits.join(new.select(F.col("n").alias("m")), "m", "left_anti").select("n", "m", "p"), "waits")
        added = told.where("p is not null").select("n", "cluster", "p", F.lit(1).cast("long").alias("c"))
        sums = (added if votes is None else votes.unionByName(added)).groupBy("n", "cluster").agg(F.sum("p").cast("decimal(38,12)").alias("p"), F.sum("c").alias("c"))
        sums = tmp.write(sums, "sums")
        ready = told.select("n").distinct().join(rest.select("n").distinct(), "n", "left_anti")
        best = sums.groupBy("n").agg(F.max_by("cluster", F.struct(F.col("p").cast("double") / F.col("c"), -F.col("cluster"))).alias("cluster"))
        new = tmp.write(ready.join(best, "n", "left").select("n", F.coalesce("cluster", "n").alias("cluster")), "decided")
        votes = tmp.write(sums.join(new.select("n"), "n", "left_anti"), "votes")
        tmp.drop(told, waits, sums)
        waits = rest
        done.append(new)
    raise RuntimeError(f"greedy clusters did not settle in {max_rounds} rounds")


def log_score(edges: DataFrame, parts: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: log likelihood of a partition under edge probabilities."""
    j = edges.join(parts.select(F.col("node").alias("src"), F.col("cluster").alias("_a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("cluster").alias("_b")), "dst")
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    return j.agg(F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.log(p)).otherwise(F.log(1 - p))), F.lit(0.0)).alias("log_score"))


def materialisations(nodes: DataFrame, edges: DataFrame, k: int, t: float = 0.5) -> list[tuple[float, int, DataFrame]]:
    """(log score, seed, partition) of the distinct ones among k greedy partitions, the best first."""
    seen, out = set(), []
    for seed in range(k):
        parts = greedy_clusters(nodes, edges, t, seed)
        low = parts.groupBy("cluster").agg(F.min("node").alias("low"))
        mark = parts.join(low, "cluster").agg(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")).alias("h")).first()["h"]
        if mark not in seen:
            seen.add(mark)
            out.append((log_score(edges, parts).first()["log_score"], seed, parts))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def tiled_clusters(nodes: DataFrame, weights: DataFrame, group_limit: int = 100_000) -> DataFrame:
    """Correlation clusters within tiles, then joined where they share a segment (G4); nodes (node, tile, seg)."""
    end = lambda c, p: nodes.select(F.col("node").alias(c), F.col("tile").alias(f"_{p}"))
    inner = weights.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("_a = _b").select("src", "dst", "w")
    parts = Scratch(nodes.sparkSession, "tiled").write(correlation_clusters(nodes, inner, group_limit), "parts")
    return reconciled(nodes, parts)


def reconciled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Clusters joined where they hold parts of one segment."""
    j = nodes.where("seg > 0").select("node", "seg").join(parts.select("node", "cluster"), "node")
    first = j.groupBy("seg").agg(F.min("cluster").alias("dst"))
    links = j.join(first, "seg").where("cluster <> dst").select(F.col("cluster").alias("src"), "dst").distinct()
    found = connected_components(links)
    return parts.select("node", "cluster").join(found.withColumnRenamed("node", "cluster"), "cluster", "left").select("node", F.coalesce("component", "cluster").alias("cluster"))


def k_hop(edges: DataFrame, cores: DataFrame, hops: int) -> DataFrame:
    """``tile, node, core``: each tile's nodes and all within ``hops`` edges of them."""
    tmp = Scratch(edges.sparkSession, "halo")
    both = tmp.write(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    held = tmp.write(cores.select("tile", "node", F.lit(True).alias("core")).distinct(), "core")
    front = held
    for _ in range(hops):
        step = front.select("tile", F.col("node").alias("src")).join(both, "src").select("tile", F.col("dst").alias("node")).distinct()
        front = tmp.write(step.join(held, ["tile", "node"], "left_anti").withColumn("core", F.lit(False)), "front")
        held = tmp.write(held.unionByName(front), "held")
    return held


def cheapest_bridge(edges: DataFrame, sources: DataFrame, targets: DataFrame, cap: float, max_rounds: int = 1000) -> DataFrame:
    """``node, cost, source``: targets that a source reaches within the cost cap, by repeated relaxation (G16); edges (src, dst, cost >= 0), either way."""
    tmp = Scratch(edges.sparkSession, "bridge")
    both = tmp.write(edges.select("src", "dst", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost")), "edges")
    best = tmp.write(sources.select("node", F.lit(0.0).alias("cost"), F.col("node").alias("source")).distinct(), "best")
    front = best
    for _ in range(max_rounds):
        step = front.withColumnRenamed("node", "src").withColumnRenamed("cost", "_c").join(both, "src").select(F.col("dst").alias("node"), (F.col("_c") + F.col("cost")).alias("cost"), "source").where(F.col("cost") <= cap)
        step = step.groupBy("node").agg(F.min(F.struct("cost", "source")).alias("s")).select("node", "s.*")
        old = best.select("node", F.col("cost").alias("_o"), F.col("source").alias("_s"))
        front = tmp.write(step.join(old, "node", "left").where("_o is null or cost < _o or cost = _o and source < _s").select("node", "cost", "source"), "front")
        if front.isEmpty():
            return best.join(targets.select("node").distinct(), "node", "left_semi")
        best = tmp.write(best.join(front, "node", "left_anti").unionByName(front), "best")
    raise RuntimeError(f"costs did not settle in {max_rounds} rounds")


def spanning_forest(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``src, dst, w``: the minimum spanning forest by rounds of each group's lightest edge out (G10, G12, G25); ties by id."""
    tmp = Scratch(edges.sparkSession, "forest")
    now = tmp.write(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w")).withColumn("ca", F.col("a")).withColumn("cb", F.col("b")), "edges")
    picked = []
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        order = F.struct("w", "a", "b")
        both = now.select(F.col("ca").alias("c"), order.alias("e")).unionByName(now.select(F.col("cb").alias("c"), order.alias("e")))
        best = both.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        best = tmp.write(best.join(now.select("a", "b", "ca", "cb"), ["a", "b"]).select("a", "b", "w", "ca", "cb"), "picked")
        picked.append(best)
        comp = tmp.write(connected_components(best.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))), "groups")
        move = lambda df, c: df.join(comp.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        now = tmp.write(move(move(now, "ca"), "cb").where("ca <> cb").select("a", "b", "w", "ca", "cb"), "edges")
    empty = edges.select("src", "dst", "w").limit(0)
    return reduce(lambda x, y: x.unionByName(y), [p.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w") for p in picked], empty)


def cohesion(parts: DataFrame) -> DataFrame:
    """``cluster, n, cohesion``: mean cosine of a cluster's pairs, by (|sum of unit vectors|**2 - n) / (n (n - 1)); 1 for one member (G19); parts (cluster, dna)."""
    unit = parts.withColumn("_n", norm("dna")).where("_n > 0").select("cluster", F.posexplode("dna").alias("pos", "v"), "_n").select("cluster", "pos", (F.col("v") / F.col("_n")).alias("u"))
    length = unit.groupBy("cluster", "pos").agg(F.sum("u").alias("s")).groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("_q"))
    n = parts.where(norm("dna") > 0).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.join(length, "cluster").select("cluster", "n", F.when(F.col("n") > 1, (F.col("_q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("cohesion"))


def contiguous(parts: DataFrame) -> DataFrame:
    """Clusters numbered from 0 by their lowest node; negative ones stay."""
    low = parts.where("cluster >= 0").groupBy("cluster").agg(F.min("node").alias("low"))
    spread = low.repartitionByRange("low").withColumn("_p", F.spark_partition_id())
    spread = Scratch(parts.sparkSession, "contiguous").write(spread, "low")
    ahead = spread.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per partition
    rank = spread.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("low")) - 1).join(ahead, "_p").select("cluster", (F.col("_r") + F.col("_ahead")).alias("_new"))
    return parts.join(rank, "cluster", "left").select("node", F.coalesce("_new", "cluster").alias("cluster"))


def regional_union(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several regions under ids (region, node) (U4)."""
    key = lambda r, c: F.struct(F.lit(r).alias("region_id"), F.col(c).alias("node"))
    nodes = [n.withColumn("node", key(r, "node")) for r, n, _ in graphs]
    edges = [e.withColumn("src", key(r, "src")).withColumn("dst", key(r, "dst")) for r, _, e in graphs]
    union = lambda parts: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return union(nodes), union(edges)
