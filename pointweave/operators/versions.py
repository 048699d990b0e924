"""Two versions of the same ids: remaps, lineage, fragmentation, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import f1, hash_order, pairs_of, ratio
from pointweave.operators.shared import all_pairs
from pointweave.sources.scratch import Scratch


def remap(pairs: DataFrame, root_map: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """Both roots replaced by their later ids; a row with an end that is missing or 0 goes."""
    out = pairs
    for c in (pre, post):
        new = root_map.select(F.col("root_base").alias(c), F.col("root_target").alias("_new"))
        out = out.join(new, c, "left").withColumn(c, F.coalesce("_new", F.lit(0)).cast("long")).drop("_new")
    return out.where((F.col(pre) != 0) & (F.col(post) != 0)).select(*pairs.columns)


def remap_report(root_map: DataFrame, top: int = 10, bins: int = 5) -> DataFrame:
    """``kind, key, n``: survivors, how many bases each target has (1 to bins, then the tail), the largest merges."""
    kept = root_map.where("root_target <> 0")
    into = kept.groupBy("root_target").agg(F.count("*").alias("n"))
    counts = root_map.agg(F.count("*").alias("total"), F.count_if(F.col("root_target") != 0).alias("survived"), F.count_if(F.col("root_target") == 0).alias("lost"))
    rows = counts.select(F.expr("stack(3, 'total', total, 'survived', survived, 'lost', lost) as (kind, n)")).select("kind", F.lit(0).cast("long").alias("key"), "n")
    histogram = into.groupBy(F.least("n", F.lit(bins + 1)).cast("long").alias("key")).agg(F.count("*").alias("n")).select(F.lit("in_degree").alias("kind"), "key", "n")
    merges = into.orderBy(F.desc("n"), "root_target").limit(top).select(F.lit("merge").alias("kind"), F.col("root_target").cast("long").alias("key"), "n")
    return rows.unionByName(histogram).unionByName(merges)


def root_as_of(asked: DataFrame, lineage: DataFrame, at: str = "at") -> DataFrame:
    """The root that each supervoxel had at a time (J2): ``lineage`` (sv, root, ts) holds changes; 0 before the first."""
    joined = asked.join(lineage.select("sv", "root", "ts"), "sv", "left")
    keys = asked.columns
    return joined.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(F.col("ts") <= F.col(at), F.col("root")), F.when(F.col("ts") <= F.col(at), F.col("ts"))), F.lit(0)).alias("root"))


def with_embedding(rows: DataFrame, embeddings: DataFrame, dim: int, key: str = "seg") -> DataFrame:
    """Adds ``dna``: the key's embedding, or zeros."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return rows.join(embeddings.select(key, F.col("dna").alias("_dna")), key, "left").withColumn("dna", F.coalesce("_dna", zero)).drop("_dna")


def fragment_breakdown(obs: DataFrame, label: int | None = None) -> DataFrame:
    """``label, seg, n``: the base ids that a later root is made of."""
    sound = obs.where("label <> 0 and seg <> 0")
    if label is not None:
        sound = sound.where(F.col("label") == label)
    return sound.groupBy("label", "seg").agg(F.count("*").alias("n"))


def fragmentation(obs: DataFrame) -> DataFrame:
    """``n_segs, n_labels``: how many later roots are made of how many base ids."""
    return fragment_breakdown(obs).groupBy("label").agg(F.count("*").alias("n_segs")).groupBy("n_segs").agg(F.count("*").alias("n_labels"))


def edit_summary(obs: DataFrame) -> DataFrame:
    """One row: sides, labelled sides, base ids that were split, later ids that merge several."""
    pairs = obs.where("seg <> 0 and label <> 0").select("seg", "label").distinct()
    split = pairs.groupBy("seg").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_segs"), F.count_if(F.col("n") > 1).alias("split_segs"))
    merged = pairs.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_labels"), F.count_if(F.col("n") > 1).alias("merge_targets"))
    sides = obs.agg(F.count("*").alias("n_sides"), F.count_if(F.col("label") != 0).alias("labelled_sides"))
    return sides.crossJoin(split).crossJoin(merged)  # one row each


def completeness_true(obs: DataFrame) -> DataFrame:
    """``seg, complete``: the segment has one later id, and that id no other segment."""
    pairs = obs.where("seg <> 0 and label <> 0").select("seg", "label").distinct()
    return _one_to_one(pairs, "seg", "label")


def completeness_pred(obs: DataFrame, ignore: int = -1) -> DataFrame:
    """``seg, complete``: the segment lies in one cluster, and that cluster holds no other."""
    pairs = obs.where((F.col("seg") != 0) & (F.col("cluster") != ignore)).select("seg", "cluster").distinct()
    return _one_to_one(pairs, "seg", "cluster")


def _one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    of_b = pairs.groupBy(b).agg(F.count("*").alias("_nb"))
    return pairs.join(of_b, b).groupBy(a).agg(((F.count("*") == 1) & (F.max("_nb") == 1)).alias("complete"))


def completeness_scores(true: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: precision, recall, F1 and accuracy of predicted completeness; NaN where a denominator is 0."""
    both = true.select("seg", F.col("complete").alias("t")).join(pred.select("seg", F.col("complete").alias("p")), "seg")
    n = both.agg(F.count("*").alias("n"), F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"))
    nan = float("nan")
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), nan)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), nan)).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n"), nan))
    return n.withColumn("f1", F.when(F.col("tp") > 0, f1(F.col("precision"), F.col("recall"))).when(F.isnan("precision") | F.isnan("recall"), F.lit(nan)).otherwise(F.lit(0.0)))


def correctable(obs: DataFrame, min_obs: int) -> DataFrame:
    """``seg, n, n_labels, error``: base ids of ``min_obs`` or more that hold several later ids; error is the pairs that doing nothing gets wrong."""
    cells = obs.where("seg <> 0 and label <> 0").groupBy("seg", "label").agg(F.count("*").alias("n"))
    whole = cells.groupBy("seg").agg(F.sum("n").alias("n"), F.count("*").alias("n_labels"), F.sum(pairs_of("n")).alias("_same"))
    return whole.where((F.col("n") >= min_obs) & (F.col("n_labels") > 1)).select("seg", "n", "n_labels", (pairs_of("n") - F.col("_same")).cast("long").alias("error"))


def edit_pairs(obs: DataFrame) -> DataFrame:
    """``kind, group, a, b``: pairs of base ids that one later id joins (false_split), and of later ids that one base id joins (false_merge)."""
    links = Scratch(obs.sparkSession, "links").write(obs.where("seg <> 0 and label <> 0").select("seg", "label").distinct(), "links")

    def within(group: str, member: str, kind: str) -> DataFrame:
        met = all_pairs(links, group, F.col(member), member).where("a <> b")
        return met.select(F.lit(kind).alias("kind"), F.col(group).alias("group"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return within("label", "seg", "false_split").unionByName(within("seg", "label", "false_merge"))


def edits_to_pairs(edits: DataFrame, obs: DataFrame, per_group: int = 10, seed: int = 0) -> DataFrame:
    """``edit_id, a, b, together``: observations on two sides of an edit, 1 for a merge and 0 for a split, at most ``per_group`` of each id.

    The cap per id comes before the pairing, so an edit makes at most per_group ** 2 rows for two of its ids.
    """
    ids = edits.select("edit_id", F.col("op"), F.posexplode(F.when(F.col("op") == "merge", F.col("before")).otherwise(F.col("after"))).alias("pos", "seg"))
    order = W.partitionBy("seg").orderBy(hash_order("syn_id", seed=seed), "syn_id")
    some = obs.join(ids.select("seg").distinct(), "seg", "left_semi").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_group).select("seg", "syn_id")
    held = ids.join(some, "seg")
    a = held.select("edit_id", "op", F.col("pos").alias("pa"), F.col("syn_id").alias("a"))
    b = held.select("edit_id", F.col("pos").alias("pb"), F.col("syn_id").alias("b"))
    return a.join(b, "edit_id").where("pa < pb").select("edit_id", "a", "b", (F.col("op") == "merge").cast("int").alias("together"))


def soma_counts(nuclei: DataFrame, sv_root: DataFrame) -> DataFrame:
    """``root_id, somata``: nuclei by the root of their supervoxel (J14); J38 is this with a semi join on a region's roots."""
    return nuclei.join(sv_root.select("sv", F.col("root").alias("root_id")), "sv").where("root_id <> 0").groupBy("root_id").agg(F.countDistinct("nucleus_id").alias("somata"))


def with_proofread_status(manifest: DataFrame, status: DataFrame, key: str = "root_id") -> DataFrame:
    """The manifest with proofreading columns, null where unknown."""
    return manifest.join(status, key, "left")
