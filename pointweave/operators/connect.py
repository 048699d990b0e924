"""Counts, degrees and connectomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import f1, pairs_of, ratio


def synapse_counts(pairs: DataFrame, pre: str = "pre_root", post: str = "post_root", somata: DataFrame | None = None) -> DataFrame:
    """``root, n_pre, n_post, total`` (and has_soma) of every root (A1); sort by total, then root, at the end."""
    both = pairs.select(F.explode(F.array(F.struct(F.col(pre).alias("root"), F.lit(0).alias("side")), F.struct(F.col(post).alias("root"), F.lit(1).alias("side")))).alias("s")).select("s.*").where("root <> 0")
    out = both.groupBy("root").agg(F.count_if(F.col("side") == 0).alias("n_pre"), F.count_if(F.col("side") == 1).alias("n_post"))
    out = out.withColumn("total", F.col("n_pre") + F.col("n_post"))
    return with_soma(out, somata) if somata is not None else out


def with_soma(roots: DataFrame, somata: DataFrame) -> DataFrame:
    """Adds has_soma: the root is in the soma table."""
    known = somata.select(F.col("root_id").alias("root")).where("root <> 0").distinct().withColumn("_s", F.lit(True))
    return roots.join(known, "root", "left").withColumn("has_soma", F.col("_s").isNotNull()).drop("_s")


def top_roots(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("total"), "root").limit(n)


def degrees_after_remap(degrees: DataFrame, root_map: DataFrame) -> DataFrame:
    """Counts summed by new root; a root without one goes (A2)."""
    moved = degrees.join(root_map.select(F.col("root_base").alias("root"), "root_target"), "root").where("root_target <> 0")
    return moved.groupBy(F.col("root_target").alias("root")).agg(F.sum("n_pre").alias("n_pre"), F.sum("n_post").alias("n_post"), F.sum("total").alias("total"))


def directed_edges(pairs: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """``pre, post, n_syn`` between different roots above 0 (A3)."""
    sound = pairs.where((F.col(pre) > 0) & (F.col(post) > 0) & (F.col(pre) != F.col(post)))
    return sound.groupBy(F.col(pre).alias("pre"), F.col(post).alias("post")).agg(F.count("*").alias("n_syn"))


def connectome(obs: DataFrame, cluster: str, partner: str, ignore: int = 0) -> DataFrame:
    """``pre, post, n_syn`` of clusters and partners, both unlike ``ignore`` (A4)."""
    sound = obs.where((F.col(cluster) != ignore) & (F.col(partner) != ignore))
    return sound.groupBy(F.col(cluster).alias("pre"), F.col(partner).alias("post")).agg(F.count("*").alias("n_syn"))


def undirected_edges(directed: DataFrame, min_syn: int = 1) -> DataFrame:
    """``a, b, n_syn``: both directions summed, loops left out, of ``min_syn`` or more (A5)."""
    both = directed.where("pre <> post").groupBy(F.least("pre", "post").alias("a"), F.greatest("pre", "post").alias("b")).agg(F.sum("n_syn").alias("n_syn"))
    return both.where(F.col("n_syn") >= min_syn)


def cell_connectivity(synapses: DataFrame, pre_cells: DataFrame, post_cells: DataFrame) -> DataFrame:
    """``pre, post, n_syn``: edges between the cells that a synapse's two sides belong to (A6); inputs (syn_id, cluster)."""
    joined = synapses.select("syn_id").join(pre_cells.select("syn_id", F.col("cluster").alias("pre")), "syn_id").join(post_cells.select("syn_id", F.col("cluster").alias("post")), "syn_id")
    return joined.where("pre >= 0 and post >= 0").groupBy("pre", "post").agg(F.count("*").alias("n_syn"))


def positive_pairs(pairs: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """``positive_pairs``: pairs of synapses that share a root, on the pre side plus on the post side."""
    ids = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(pre).alias("root")), F.struct(F.lit(1).alias("side"), F.col(post).alias("root")))).alias("s")).select("s.*").where("root <> 0")
    counts = ids.groupBy("side", "root").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(pairs_of("n")), F.lit(0.0)).cast("long").alias("positive_pairs"))


def both_sides(pre: DataFrame, post: DataFrame, key: str = "syn_id") -> DataFrame:
    """Synapses whose two sides are both in a partition (J13); inputs (key, cluster, label)."""
    names = lambda p, df: df.select(key, F.col("cluster").alias(f"{p}_cluster"), F.col("label").alias(f"{p}_label"))
    return names("pre", pre).join(names("post", post), key)


def side_coverage(pre: DataFrame, post: DataFrame, key: str = "syn_id") -> DataFrame:
    """How many ids are on both sides, on the first only, on the second only."""
    a, b = pre.select(key).distinct().withColumn("p", F.lit(1)), post.select(key).distinct().withColumn("q", F.lit(1))
    full = a.join(b, key, "full_outer")
    return full.agg(F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("both"), F.count_if(F.col("q").isNull()).alias("pre_only"), F.count_if(F.col("p").isNull()).alias("post_only"))


def majority(obs: DataFrame, group: str = "cluster", label: str = "label", ignore_group: int | None = 0, ignore_label: int | None = 0) -> DataFrame:
    """``group, label, n, size``: the most frequent label, the lowest if tied, and its share of the labelled rows."""
    sound = obs
    if ignore_label is not None:
        sound = sound.where(F.col(label) != ignore_label)
    if ignore_group is not None:
        sound = sound.where(F.col(group) != ignore_group)
    counts = sound.groupBy(group, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label), F.max("n").alias("n"), F.sum("n").alias("size"))
    return best.withColumn("purity", F.col("n") / F.col("size"))


def edge_prf(true: DataFrame, pred: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row: hits, misses and false alarms of a set of edges, with precision, recall and F1."""
    t = true.select(*keys).distinct().withColumn("t", F.lit(1))
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    full = t.join(p, keys, "full_outer")
    n = full.agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    n = n.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return n.select(*[F.col(c).alias(f"{prefix}_{c}") for c in n.columns])


def connectome_accuracy(obs: DataFrame, cluster: str = "cluster", label: str = "label", partner: str = "partner", min_syn: int = 1, ignore: int = 0) -> DataFrame:
    """One row: attribution accuracy, and directed and undirected edge scores of clusters under their majority labels."""
    best = majority(obs, cluster, label, ignore, ignore).select(F.col(cluster).alias("_c"), F.col(label).alias("called"))
    called = obs.join(best, obs[cluster] == best["_c"], "left").drop("_c").withColumn("called", F.coalesce("called", F.lit(0)))
    mapped = called.where((F.col(label) != ignore) & (F.col(cluster) != ignore))
    right = mapped.agg(F.count("*").alias("n_obs"), ratio(F.count_if(F.col("called") == F.col(label)), F.count("*"), float("nan")).alias("attribution_accuracy"))
    true, pred = connectome(obs, label, partner, ignore), connectome(called, "called", partner, ignore)
    directed = edge_prf(true.where(F.col("n_syn") >= min_syn), pred.where(F.col("n_syn") >= min_syn), ["pre", "post"], "directed")
    undirected = edge_prf(undirected_edges(true, min_syn), undirected_edges(pred, min_syn), ["a", "b"], "undirected")
    return right.crossJoin(directed).crossJoin(undirected)  # one row each


def dual_accuracy(pre: DataFrame, post: DataFrame, min_syn: int = 1, ignore: int = 0) -> DataFrame:
    """A26 where both sides are clustered; only synapses whose two sides map to a label count as true."""
    joined = both_sides(pre, post)
    named = []
    for side, df in (("pre", pre), ("post", post)):
        best = majority(df, ignore_group=ignore, ignore_label=ignore)
        named.append(best.select(F.col("cluster").alias(f"{side}_cluster"), F.col("label").alias(f"{side}_called")))
    full = joined.join(named[0], "pre_cluster", "left").join(named[1], "post_cluster", "left").na.fill(0, ["pre_called", "post_called"])
    mapped = full.where((F.col("pre_label") != ignore) & (F.col("post_label") != ignore))
    right = mapped.agg(F.count("*").alias("n_syn"), ratio(F.count_if((F.col("pre_called") == F.col("pre_label")) & (F.col("post_called") == F.col("post_label"))), F.count("*"), float("nan")).alias("attribution_accuracy"))
    true, pred = connectome(mapped, "pre_label", "post_label", ignore), connectome(full, "pre_called", "post_called", ignore)
    keep = lambda df: df.where(F.col("n_syn") >= min_syn)
    return right.crossJoin(edge_prf(keep(true), keep(pred), ["pre", "post"], "directed")).crossJoin(edge_prf(undirected_edges(true, min_syn), undirected_edges(pred, min_syn), ["a", "b"], "undirected"))


def roots_of(pairs: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """All distinct roots of either side."""
    return pairs.select(F.explode(F.array(pre, post)).alias("root")).distinct()


def tier_matrix(pairs: DataFrame, pre_tiers: DataFrame, post_tiers: DataFrame) -> DataFrame:
    """``pre_tier, post_tier, n, share`` with margins (null: all) (A40); inputs (root, tier)."""
    joined = pairs.join(pre_tiers.select(F.col("root").alias("pre_root"), F.col("tier").alias("pre_tier")), "pre_root").join(post_tiers.select(F.col("root").alias("post_root"), F.col("tier").alias("post_tier")), "post_root")
    cells = joined.groupBy("pre_tier", "post_tier").agg(F.count("*").alias("n"))
    cube = cells.cube("pre_tier", "post_tier").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("_all"))
    return cube.crossJoin(total).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row
