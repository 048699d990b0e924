"""Scores of partitions, pairs and probabilities.  Pair counts are closed forms: no pair is made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import f1, pairs_of, ratio
from pointweave.sources.scratch import Scratch

NAN = float("nan")


def _sum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def contingency(rows: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    return rows.groupBy(F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count("*").alias("n"))


def pair_sums(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs in the same cell, the same predicted group and the same true group, per ``by``."""
    by = by or []
    own = cells.groupBy(*by, "pred", "true").agg(F.sum("n").alias("n"))

    def side(keys: list[str], name: str) -> DataFrame:
        groups = own.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        return groups.groupBy(*by).agg(_sum(pairs_of("n")).alias(name))

    parts = [own.groupBy(*by).agg(_sum(pairs_of("n")).alias("both"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_obs"), F.countDistinct("pred").alias("n_pred"), F.countDistinct("true").alias("n_true")), side(["pred"], "pred_pairs"), side(["true"], "true_pairs")]
    return reduce(lambda a, b: a.join(b, by) if by else a.crossJoin(b), parts)  # one row each without keys


def pairwise(rows: DataFrame, pred: str = "pred", true: str = "true", by: list[str] | None = None, ignore_pred: int | None = -1, ignore_true: int | None = 0, empty: float = NAN) -> DataFrame:
    """Precision, recall and F1 of pairs that lie together."""
    sound = rows
    if ignore_pred is not None:
        sound = sound.where(F.col(pred) != ignore_pred)
    if ignore_true is not None:
        sound = sound.where(F.col(true) != ignore_true)
    cells = sound.groupBy(*(by or []), F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    s = pair_sums(cells, by)
    s = s.withColumn("precision", ratio(F.col("both"), F.col("pred_pairs"), empty)).withColumn("recall", ratio(F.col("both"), F.col("true_pairs"), empty))
    return s.withColumn("f1", F.when(F.isnan("precision") | F.isnan("recall"), F.lit(empty)).otherwise(f1(F.col("precision"), F.col("recall"))))


def coverage_at_k(rows: DataFrame, k: str = "k", recall: float = 0.9, **names: str) -> DataFrame:
    """One row: whether any of the K partitions reaches the recall, and the best."""
    return pairwise(rows, by=[k], **names).agg(F.bool_or(F.col("recall") >= recall).alias("covered"), F.max("recall").alias("best_recall"))


def partition_scores(rows: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """One row: adjusted Rand index, homogeneity, completeness, V-measure and counts; true = 0 is left out, all zeros when nothing is left."""
    cells = contingency(rows.where(F.col(true) != 0), pred, true)
    s = pair_sums(cells)
    total = pairs_of("n_obs")
    expected = F.when(total > 0, F.col("pred_pairs") * F.col("true_pairs") / total).otherwise(0.0)
    most = (F.col("pred_pairs") + F.col("true_pairs")) / 2
    ari = F.when(F.col("n_obs") == 0, 0.0).when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected))
    n_all = cells.agg(F.sum("n").alias("all_n"))
    p, t = cells.groupBy("pred").agg(F.sum("n").alias("np")), cells.groupBy("true").agg(F.sum("n").alias("nt"))
    entropy = lambda df, c, name: df.crossJoin(n_all).agg(F.coalesce(-F.sum(F.col(c) / F.col("all_n") * F.log(F.col(c) / F.col("all_n"))), F.lit(0.0)).alias(name))
    joint = cells.join(p, "pred").join(t, "true").crossJoin(n_all)
    given = joint.agg(F.coalesce(-F.sum(F.col("n") / F.col("all_n") * F.log(F.col("n") / F.col("np"))), F.lit(0.0)).alias("h_true_pred"), F.coalesce(-F.sum(F.col("n") / F.col("all_n") * F.log(F.col("n") / F.col("nt"))), F.lit(0.0)).alias("h_pred_true"))
    out = s.withColumn("ari", ari).crossJoin(entropy(t, "nt", "h_true")).crossJoin(entropy(p, "np", "h_pred")).crossJoin(given)  # one row each
    some = F.col("n_obs") > 0
    out = out.withColumn("homogeneity", F.when(some, F.when(F.col("h_true") > 0, 1 - F.col("h_true_pred") / F.col("h_true")).otherwise(1.0)).otherwise(0.0))
    out = out.withColumn("completeness", F.when(some, F.when(F.col("h_pred") > 0, 1 - F.col("h_pred_true") / F.col("h_pred")).otherwise(1.0)).otherwise(0.0))
    return out.withColumn("v_measure", f1(F.col("homogeneity"), F.col("completeness"))).select("n_obs", "n_pred", "n_true", "ari", "homogeneity", "completeness", "v_measure")


def line_graph(rows: DataFrame, pred_pre: str = "pred_pre", pred_post: str = "pred_post", true_pre: str = "true_pre", true_post: str = "true_post", by: list[str] | None = None) -> DataFrame:
    """``variant, tp, fp, fn, precision, recall, f1`` of the line graph's pairs for pre, post, or, and (A23), per ``by``.

    The number of pairs together on the pre or the post side is C(pre) + C(post) - C(pre, post); hits are
    counted by inclusion and exclusion over groups of up to four ids.  Id 0 joins nothing.
    """
    c, by = {"P": pred_pre, "Q": pred_post, "A": true_pre, "B": true_post}, by or []

    def together(keys: str) -> DataFrame:
        names = [c[k] for k in keys]
        sound = reduce(lambda a, b: a & b, [F.col(x) != 0 for x in names])
        counts = rows.where(sound).groupBy(*by, *names).agg(F.count("*").alias("n"))
        return counts.groupBy(*by).agg(_sum(pairs_of("n")).alias(keys))

    subsets = ["P", "Q", "A", "B", "PQ", "AB", "PA", "PB", "QA", "QB", "PAB", "QAB", "PQA", "PQB", "PQAB"]
    parts = [together(k) for k in subsets]
    if by:
        one = reduce(lambda a, b: a.join(b, by, "left"), parts, rows.select(*by).distinct()).na.fill(0.0, subsets)
    else:
        one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    v = F.col
    either = {"true": v("A") + v("B") - v("AB"), "pred": v("P") + v("Q") - v("PQ"), "tp": v("PA") + v("PB") - v("PAB") + v("QA") + v("QB") - v("QAB") - v("PQA") - v("PQB") + v("PQAB")}
    rows_of = [("pre", v("PA"), v("P"), v("A")), ("post", v("QB"), v("Q"), v("B")), ("or", either["tp"], either["pred"], either["true"]), ("and", v("PQAB"), v("PQ"), v("AB"))]
    out = one.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), tp.alias("tp"), (p - tp).alias("fp"), (t - tp).alias("fn")) for n, tp, p, t in rows_of])).alias("r")).select(*by, "r.*")
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def seg_baseline(synapses: DataFrame, box: str = "box_id") -> DataFrame:
    """``variant, mean_f1, median_f1`` over boxes when base ids are the partition (A44); an id of 0 joins nothing; synapses (box, pre_seg, post_seg, pre_root, post_root)."""
    f = line_graph(synapses, "pre_seg", "post_seg", "pre_root", "post_root", by=[box])
    return f.groupBy("variant").agg(F.avg("f1").alias("mean_f1"), F.expr("percentile(f1, 0.5)").alias("median_f1"))


def line_graph_pairs(rows: DataFrame, key: str, pre: str, post: str) -> DataFrame:
    """``a, b``: rows that share the pre or the post id, a < b; for small tables, as a yardstick."""
    def side(c: str) -> DataFrame:
        left, right = rows.where(F.col(c) != 0).select(c, F.col(key).alias("a")), rows.where(F.col(c) != 0).select(c, F.col(key).alias("b"))
        return left.join(right, c).where("a < b").select("a", "b")

    return side(pre).unionByName(side(post)).distinct()


def sampled_pairs_f1(pairs: DataFrame) -> DataFrame:
    """One row: F1 of sampled pairs ``true, pred`` booleans."""
    n = pairs.agg(F.count_if(F.col("true") & F.col("pred")).alias("tp"), F.count_if(~F.col("true") & F.col("pred")).alias("fp"), F.count_if(F.col("true") & ~F.col("pred")).alias("fn"))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    return n.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def edge_merge(edges: DataFrame, parts: DataFrame, ignore_label: int = 0) -> DataFrame:
    """One row: merge decisions on edges (src, dst, etype) under ``parts`` (node, label, cluster).

    Precision, recall and F1 of nothing are 1.0; edges of type 0 whose labels differ are the frankenmerges.
    """
    end = lambda p, k: parts.select(F.col("node").alias(k), F.col("label").alias(f"{p}_label"), F.col("cluster").alias(f"{p}_cluster"))
    j = edges.join(end("s", "src"), "src").join(end("d", "dst"), "dst").where((F.col("s_label") != ignore_label) & (F.col("d_label") != ignore_label))
    same, joined, one_seg = F.col("s_label") == F.col("d_label"), F.col("s_cluster") == F.col("d_cluster"), F.col("etype") == 0
    n = j.agg(
        F.count("*").alias("n_edges"), F.count_if(same & joined).alias("tp"), F.count_if(~same & joined).alias("fp"), F.count_if(same & ~joined).alias("fn"), F.count_if(~same & ~joined).alias("tn"),
        F.count_if(one_seg).alias("_t0"), F.count_if(one_seg & ~same).alias("_cut"), F.count_if(one_seg & ~same & ~joined).alias("_split"),
    )
    n = n.withColumn("merge_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("merge_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)).withColumn("merge_f1", f1(F.col("merge_precision"), F.col("merge_recall")))
    n = n.withColumn("over_merge_rate", ratio(F.col("fp"), F.col("n_edges"), 0.0)).withColumn("under_merge_rate", ratio(F.col("fn"), F.col("n_edges"), 0.0))
    n = n.withColumn("frankenmerge_rate", ratio(F.col("_cut"), F.col("_t0"), 0.0)).withColumn("frankenmerge_split_recall", ratio(F.col("_split"), F.col("_cut"), 0.0)).drop("_t0", "_cut", "_split")
    abstain = parts.agg(ratio(F.count_if(F.col("cluster") < 0), F.count("*"), 0.0).alias("abstain_rate"))
    return n.crossJoin(abstain)  # one row each


def population(obs: DataFrame, ignore: int = -1) -> DataFrame:
    """One row: the triangle of fragments, neurons and clusters, with fragments per neuron and cluster, and clusters per neuron (A17); obs (seg, label, cluster)."""
    links = obs.where("seg <> 0 and label <> 0").select("seg", "label").distinct()
    placed = obs.where((F.col("cluster") != ignore) & (F.col("seg") != 0)).select("seg", "cluster").distinct()
    three = lambda df, key, name: df.groupBy(key).count().agg(F.avg("count").alias(f"{name}_mean"), F.expr("percentile(count, 0.5)").alias(f"{name}_median"), F.max("count").alias(f"{name}_max"))
    n = obs.agg(F.countDistinct(F.when(F.col("seg") != 0, F.col("seg"))).alias("n_fragments"), F.countDistinct(F.when(F.col("label") != 0, F.col("label"))).alias("n_neurons"), F.countDistinct(F.when(F.col("cluster") != ignore, F.col("cluster"))).alias("n_clusters"), F.count("*").alias("n_obs"))
    reach = placed.join(links, "seg").select("cluster", "label").distinct()
    mixed = reach.groupBy("cluster").count().agg(F.count_if(F.col("count") > 1).alias("false_merge_clusters"))
    parts = [n, mixed, three(links, "label", "frags_per_neuron"), three(placed, "cluster", "frags_per_cluster"), three(reach, "label", "clusters_per_neuron")]
    out = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return out.withColumn("merges_needed", F.col("n_fragments") - F.col("n_neurons")).withColumn("merges_predicted", F.col("n_fragments") - F.col("n_clusters"))


def rand_disagreement(rows: DataFrame, component: str = "component") -> DataFrame:
    """``component, pairs, wrong``: pairs that prediction and truth treat unlike, per component."""
    cells = rows.groupBy(component, F.col("pred").alias("pred"), F.col("true").alias("true")).agg(F.count("*").alias("n"))
    s = pair_sums(cells, [component])
    return s.select(component, pairs_of("n_obs").alias("pairs"), (F.col("pred_pairs") + F.col("true_pairs") - 2 * F.col("both")).alias("wrong"))


def rows_correct(rows: DataFrame) -> DataFrame:
    """Adds ``correct``: the row's true id is its predicted group's most frequent, the lowest if tied."""
    cells = rows.groupBy("pred", "true").agg(F.count("*").alias("n"))
    best = cells.groupBy("pred").agg(F.max_by("true", F.struct("n", -F.col("true"))).alias("_best"))
    return rows.join(best, "pred").withColumn("correct", F.col("true") == F.col("_best")).drop("_best")


def synapses_correct(rows: DataFrame) -> DataFrame:
    """``syn_id, correct``: synapses with both sides present are right if both are."""
    return rows.groupBy("syn_id").agg(F.count("*").alias("_n"), F.bool_and("correct").alias("correct")).where("_n = 2").drop("_n")


def franken_separation(rows: DataFrame, parent: str = "parent", label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row: parents of several labels, and the share whose labels share no cluster; negative clusters are left out."""
    mixed = rows.groupBy(parent).agg(F.countDistinct(label).alias("_l")).where("_l > 1").select(parent)
    cells = rows.where(F.col(cluster) >= 0).groupBy(parent, cluster).agg(F.countDistinct(label).alias("_n")).where("_n > 1").select(parent).distinct().withColumn("_bad", F.lit(True))
    n = mixed.join(cells, parent, "left").agg(F.count("*").alias("n_parents"), F.count_if(F.col("_bad").isNull()).alias("n_separated"))
    return n.withColumn("separation", ratio(F.col("n_separated"), F.col("n_parents"), NAN))


def tangledness(pairs: DataFrame, box: str = "box_id", pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """``box, n_pre_roots, n_post_roots, root_density, max_root_size, multi_root_fraction, tangledness``: how entangled a box is."""
    ids = pairs.select(box, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(pre).alias("root")), F.struct(F.lit(1).alias("side"), F.col(post).alias("root")))).alias("s")).select(box, "s.*")
    counts = ids.groupBy(box, "side", "root").agg(F.count("*").alias("n"))
    s = counts.groupBy(box).agg(F.count_if(F.col("side") == 0).alias("n_pre_roots"), F.count_if(F.col("side") == 1).alias("n_post_roots"), (F.sum("n") / 2).alias("_rows"), F.max("n").alias("max_root_size"), F.count_if(F.col("n") > 1).alias("_multi"))
    roots = F.col("n_pre_roots") + F.col("n_post_roots")
    s = s.withColumn("root_density", roots / F.col("_rows")).withColumn("multi_root_fraction", F.col("_multi") / roots)
    return s.withColumn("tangledness", F.col("multi_root_fraction") * F.col("root_density") * 100).drop("_multi", "_rows")


def occupied_cells(points: DataFrame, sides_nm: list[float], exact: bool = True) -> DataFrame:
    """``side, n_cells``: occupied grid cells for each box side (A10)."""
    cells = points.select(F.explode(F.array(*[F.lit(float(s)) for s in sides_nm])).alias("side"), "x", "y", "z")
    cell = F.struct(*[F.floor(F.col(c) / F.col("side")).alias(c) for c in ("x", "y", "z")])
    count = F.countDistinct(cell) if exact else F.approx_count_distinct(cell)
    return cells.groupBy("side").agg(count.alias("n_cells"))


def spatial_split(boxes: DataFrame, axis: str = "x", bins: int = 10, seed: int = 0, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """Adds ``split``: boxes in quantile bins along an axis; whole bins, in hash order, go to train, val and test."""
    edges = boxes.agg(F.expr(f"percentile({axis}, array({', '.join(str(k / bins) for k in range(1, bins))}))").alias("e")).first()["e"] or []
    bin_of = reduce(lambda a, b: a + b, [(F.col(axis) > F.lit(e)).cast("int") for e in edges], F.lit(0))
    order = boxes.sparkSession.range(bins).orderBy(F.xxhash64("id", F.lit(seed))).collect()  # one row per bin
    rank = {r["id"]: k for k, r in enumerate(order)}
    name = lambda k: "train" if k < shares[0] * bins else "val" if k < sum(shares) * bins else "test"
    split = reduce(lambda c, b: c.when(F.col("bin") == b, name(rank[b])), range(1, bins), F.when(F.col("bin") == 0, name(rank[0])))
    return boxes.withColumn("bin", bin_of).withColumn("split", split)


def boundary_clip(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], margin: float, group: str = "seg") -> DataFrame:
    """One row: share of groups whose centroid lies within the margin of a face, single-point share, median and tenth percentile of size."""
    c = points.groupBy(group).agg(*[F.avg(a).alias(a) for a in ("x", "y", "z")], F.count("*").alias("n"))
    near = F.least(*[F.col(a) - lo for a, lo in zip(("x", "y", "z"), low)], *[hi - F.col(a) for a, hi in zip(("x", "y", "z"), high)]) <= margin
    return c.agg(F.count("*").alias("n_groups"), ratio(F.count_if(near), F.count("*"), NAN).alias("clipped"), ratio(F.count_if(F.col("n") == 1), F.count("*"), NAN).alias("single"), F.expr("percentile(n, 0.5)").alias("median_n"), F.expr("percentile(n, 0.1)").alias("p10_n"))


def reliability(scored: DataFrame, bins: int = 15, p: str = "p", y: str = "y") -> DataFrame:
    """``bin, n, confidence, accuracy`` of equal bins, empty ones kept."""
    got = scored.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").na.fill(0, ["n"])


def calibration_error(scored: DataFrame, bins: int = 15, p: str = "p", y: str = "y") -> DataFrame:
    """One row: ``ece``."""
    r = reliability(scored, bins, p, y)
    return r.agg(ratio(_sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n"), 0.0).alias("ece"))


def fit_temperature(scored: DataFrame, logit: str = "logit", y: str = "y", held: F.Column | None = None, bias: float = 0.0, low: float = 0.05, high: float = 10.0) -> tuple[float, float]:
    """Temperature t with the least mean negative log likelihood of sigmoid((logit + bias) / t) on the held-out rows, and that mean.

    ``held`` marks these rows; by default a fifth of all, by a hash of all columns.  The mean is convex in 1 / t, so
    Newton steps settle it, each one pass that sums first and second derivatives; a step out of the bracket is halved into it.
    """
    if held is None:
        held = F.pmod(F.xxhash64(*scored.columns), F.lit(5)) == 0
    rows = Scratch(scored.sparkSession, "temperature").write(scored.where(held).select((F.col(logit) + bias).cast("double").alias("z"), F.col(y).cast("double").alias("y")).where("z is not null and y is not null"), "held")
    lo, hi, beta = 1 / high, 1 / low, min(max(1.0, 1 / high), 1 / low)
    nll = NAN
    for _ in range(100):
        u = F.col("z") * beta
        p = 1 / (1 + F.exp(-u))
        loss = F.greatest(u, F.lit(0.0)) - u * F.col("y") + F.log1p(F.exp(-F.abs(u)))
        row = rows.agg(F.avg(loss), F.sum(F.col("z") * (p - F.col("y"))), F.sum(F.col("z") ** 2 * p * (1 - p))).first()
        if row[0] is None:
            return 1.0, NAN
        nll, slope, bend = row
        lo, hi = (lo, beta) if slope > 0 else (beta, hi)
        step = beta - slope / bend if bend > 0 else (lo + hi) / 2
        step = step if lo < step < hi else (lo + hi) / 2
        if abs(step - beta) <= 1e-10 * beta:
            break
        beta = step
    return 1 / beta, nll


def roc_auc(scored: DataFrame, score: str = "score", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """``auc`` (ties count half), per ``by``.

    Scores collapse to their distinct values first; ranks are running sums over score bins of 256 per
    group, then within a bin, so no task orders all values.
    """
    by = by or []
    w = scored.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y).cast("int") == 1, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y).cast("int") == 0, 1.0).otherwise(0.0)).alias("neg"))
    ends = w.groupBy(*by).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    binned = (w.join(ends, by) if by else w.crossJoin(ends)).withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 256), F.lit(255))).otherwise(F.lit(0)))
    sums = binned.groupBy(*by, "_bin").agg(F.sum("neg").alias("_n"))
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("_n")
    inside = W.partitionBy(*by, "_bin").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    below = binned.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0.0))).join(ahead, [*by, "_bin"])
    wins = F.sum(F.col("pos") * (F.col("_ahead") + F.col("_in") + F.col("neg") / 2))
    return below.groupBy(*by).agg(ratio(wins, F.sum("pos") * F.sum("neg"), NAN).alias("auc"))


def bootstrap_auc(scored: DataFrame, rounds: int = 50, score: str = "score", y: str = "y", seed: int = 0) -> DataFrame:
    """One row: mean and 2.5 and 97.5 percentiles of the AUC over ``rounds`` resamples with Poisson counts."""
    u = (F.pmod(F.xxhash64(F.col("_row"), F.col("k"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cdf, term, times = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cdf += term
        times = times + (u > cdf).cast("int")
        term /= k + 1
    rows = scored.select(score, y, F.monotonically_increasing_id().alias("_row"))
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_t", times).where("_t > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    return roc_auc(drawn, score, y, ["k"]).agg(F.avg("auc").alias("mean"), F.expr("percentile(auc, 0.025)").alias("low"), F.expr("percentile(auc, 0.975)").alias("high"))


def best_f1_threshold(scored: DataFrame, score: str = "score", y: str = "y", steps: int = 100) -> DataFrame:
    """One row: the threshold of a grid with the best F1."""
    grid = scored.select(score, F.col(y).cast("int").alias("_y"), F.explode(F.expr(f"transform(sequence(0, {steps}), k -> k / {steps}D)")).alias("threshold"))
    n = grid.groupBy("threshold").agg(F.count_if((F.col(score) >= F.col("threshold")) & (F.col("_y") == 1)).alias("tp"), F.count_if((F.col(score) >= F.col("threshold")) & (F.col("_y") == 0)).alias("fp"), F.count_if((F.col(score) < F.col("threshold")) & (F.col("_y") == 1)).alias("fn"))
    n = n.withColumn("f1", ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0))
    return n.orderBy(F.desc("f1"), "threshold").limit(1)


def panel_scores(candidates: DataFrame, site: str = "site", score: str = "score", right: str = "right") -> DataFrame:
    """``site, z, top_right, margin``: each site's best candidate by score standardised within the site."""
    own = W.partitionBy(site)
    sd = F.stddev_pop(score).over(own)
    z = candidates.withColumn("z", F.when(sd > 0, (F.col(score) - F.avg(score).over(own)) / sd).otherwise(0.0))
    ranked = z.withColumn("_r", F.row_number().over(own.orderBy(F.desc("z"), F.desc(right)))).withColumn("_next", F.lead("z").over(own.orderBy(F.desc("z"), F.desc(right))))
    return ranked.where("_r = 1").select(site, "z", F.col(right).alias("top_right"), (F.col("z") - F.coalesce("_next", F.col("z"))).alias("margin"))


def panel_coverage(best: DataFrame, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """``quantile, threshold, coverage, precision, recall`` when only sites above a quantile of the margin answer."""
    cuts = best.agg(F.expr(f"percentile(margin, array({', '.join(map(str, quantiles))}))").alias("t")).select(F.posexplode("t").alias("k", "threshold")).withColumn("quantile", F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("k") + 1))
    j = best.crossJoin(F.broadcast(cuts))  # a row per quantile
    answered = F.col("margin") >= F.col("threshold")
    return j.groupBy("quantile", "threshold").agg(ratio(F.count_if(answered), F.count("*")).alias("coverage"), ratio(F.count_if(answered & F.col("top_right")), F.count_if(answered), NAN).alias("precision"), ratio(F.count_if(answered & F.col("top_right")), F.count("*")).alias("recall"))


def correction_gain(rows: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """``threshold, proposed, edit_precision, edit_recall, net_pairs``: what edits above a threshold fix, against doing nothing (A49); rows (score, gain)."""
    cuts = thresholds if thresholds is not None else rows.sparkSession.range(1, 10).select((F.col("id") / 10.0).alias("threshold"))
    j = rows.crossJoin(F.broadcast(cuts))  # a handful of thresholds
    take, good = F.col("score") >= F.col("threshold"), F.col("gain") > 0
    n = j.groupBy("threshold").agg(F.count_if(take).alias("proposed"), F.count_if(take & good).alias("_hit"), F.count_if(good).alias("_good"), _sum(F.when(take, F.col("gain").cast("double"))).alias("net_pairs"))
    return n.withColumn("edit_precision", ratio(F.col("_hit"), F.col("proposed"), NAN)).withColumn("edit_recall", ratio(F.col("_hit"), F.col("_good"), NAN)).drop("_hit", "_good")


def acceptance_sweep(panel: DataFrame, gaps: list[float], margins: list[float], cosines: list[float]) -> DataFrame:
    """``gap, margin, cos, accepted, right, precision, mass``: what each setting accepts (A41); panel (g1, ratio, cosine, right, n_obs)."""
    spark = panel.sparkSession
    grid = spark.createDataFrame([(float(a), float(b), float(c)) for a in gaps for b in margins for c in cosines], "gap double, margin double, cos double")
    j = panel.crossJoin(F.broadcast(grid))  # a fixed grid
    take = (F.col("g1") <= F.col("gap")) & (F.col("ratio") >= F.col("margin")) & (F.col("cosine") >= F.col("cos"))
    n = j.groupBy("gap", "margin", "cos").agg(F.count_if(take).alias("accepted"), F.count_if(take & F.col("right")).alias("right"), F.coalesce(F.sum(F.when(take, F.col("n_obs"))), F.lit(0)).alias("mass"))
    return n.withColumn("precision", ratio(F.col("right"), F.col("accepted"), NAN))


def scaffold_census(frags: DataFrame, gates: dict[str, str]) -> DataFrame:
    """``gate, n, pure, purity, mass_purity, mass``: fragments that pass each gate (an SQL condition) (A42); frags (purity, n_obs)."""
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.expr(v).alias("passes")) for k, v in gates.items()])).alias("g")
    j = frags.select("purity", "n_obs", marks).select("purity", "n_obs", "g.*").where("passes")
    return j.groupBy("gate").agg(F.count("*").alias("n"), F.count_if(F.col("purity") == 1).alias("pure"), F.avg("purity").alias("purity"), ratio(F.sum(F.col("purity") * F.col("n_obs")), F.sum("n_obs"), NAN).alias("mass_purity"), F.sum("n_obs").alias("mass"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """``metric, value``: one-row frames as a long table."""
    rows = []
    for name, df in parts.items():
        numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "boolean")]
        rows.append(df.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), rows)
