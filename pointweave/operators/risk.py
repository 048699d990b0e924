"""Confidence, soft membership and what people should look at."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import ratio

REVIEW = ("REVIEW_MERGE", "REVIEW_SPLIT", "ABSTAIN")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("obs"), F.col("dst").alias("other"), "p").unionByName(edges.select(F.col("dst").alias("obs"), F.col("src").alias("other"), "p"))


def confidence(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``obs, cluster, confidence``: the best edge into the own cluster less the best into another (A36); nodes without edges have 0."""
    own, other = parts.select(F.col("node").alias("obs"), "cluster"), parts.select(F.col("node").alias("other"), F.col("cluster").alias("_oc"))
    j = _both_ways(edges).join(own, "obs").join(other, "other")
    best = j.groupBy("obs").agg(F.max(F.when(F.col("cluster") == F.col("_oc"), F.col("p"))).alias("_in"), F.max(F.when(F.col("cluster") != F.col("_oc"), F.col("p"))).alias("_out"))
    return own.join(best, "obs", "left").select("obs", "cluster", (F.coalesce("_in", F.lit(0.0)) - F.coalesce("_out", F.lit(0.0))).alias("confidence"))


def abstained(conf: DataFrame, floor: float) -> DataFrame:
    """Clusters with each observation below the floor set apart under a negative id of its own (A36); ids are unique, not consecutive."""
    return conf.withColumn("cluster", F.when(F.col("confidence") < floor, -1 - F.col("obs").cast("long")).otherwise(F.col("cluster")))


def soft_membership(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``obs, cluster, p``: edge weight into each cluster, normalised (A37); a node without edges has no row."""
    j = _both_ways(edges).join(parts.select(F.col("node").alias("other"), "cluster"), "other").groupBy("obs", "cluster").agg(F.sum(F.col("p").cast("decimal(20,10)")).alias("w"))  # exact, so that the order of sums can't show
    total = j.groupBy("obs").agg(F.sum("w").alias("_t"))
    return j.join(total, "obs").where("_t > 0").select("obs", "cluster", (F.col("w").cast("double") / F.col("_t").cast("double")).alias("p"))


def entropy(soft: DataFrame, nodes: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``obs, entropy``: Shannon entropy of the membership, about 0 for nodes without a row."""
    h = soft.groupBy("obs").agg((-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("entropy"))
    return nodes.select(F.col("node").alias("obs")).join(h, "obs", "left").na.fill(0.0, ["entropy"])


def decisions(conf: DataFrame, entropies: DataFrame, n_clusters: int, merge_cost: float = 5.0, split_cost: float = 1.0) -> DataFrame:
    """Adds risk_merge, risk_split, expected_loss and action (A38); a negative cluster abstains."""
    j = conf.join(entropies, "obs").withColumn("risk_merge", F.greatest(F.lit(0.0), -F.col("confidence"))).withColumn("risk_split", F.col("entropy") / log(max(n_clusters, 2)))
    j = j.withColumn("expected_loss", merge_cost * F.col("risk_merge") + split_cost * F.col("risk_split"))
    action = F.when(F.col("cluster") < 0, "ABSTAIN").when(F.col("confidence") > 0.3, "CONFIDENT_MERGE").when(F.col("risk_merge") > 0.15, "REVIEW_MERGE").when(F.col("risk_split") > 0.40, "REVIEW_SPLIT").otherwise("CONFIDENT_MERGE")
    return j.withColumn("action", action)


def fragment_risk(decided: DataFrame, members: DataFrame) -> DataFrame:
    """``seg, n_obs, mean_loss, max_loss, n_review`` (A39); members (obs, seg)."""
    return decided.join(members, "obs").groupBy("seg").agg(F.count("*").alias("n_obs"), F.avg("expected_loss").alias("mean_loss"), F.max("expected_loss").alias("max_loss"), F.count_if(F.col("action").isin(*REVIEW)).alias("n_review"))


def risk_summary(decided: DataFrame) -> DataFrame:
    """``action, n, share``."""
    n = decided.groupBy("action").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("_t"))).select("action", "n", ratio(F.col("n"), F.col("_t")).alias("share"))  # one row


def review_queue(decided: DataFrame, top: int, actions: tuple[str, ...] = REVIEW) -> DataFrame:
    """The decisions with the greatest expected loss among the review actions."""
    return decided.where(F.col("action").isin(*actions)).orderBy(F.desc("expected_loss"), "obs").limit(top)
