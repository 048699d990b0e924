"""Ordered points of a group: steps, turns, tokens, windows.  Rows are (group, pos, x, y, z)."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import distance
from pointweave.operators.shared import shuffled
from pointweave.operators.spatial import XYZ, knn
from pointweave.sources.scratch import Scratch

TOKENS = ("F", "B", "L", "R")


def principal_axes(points: DataFrame, group: str = "group") -> DataFrame:
    """``group, n, centre, axes, spread``: centre, the three axes by falling spread (each with its largest part positive) and their standard deviations.

    Moments are summed in Spark; only a 3 x 3 matrix per group is decomposed.
    """
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    moments = points.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in XYZ], *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs])

    @F.pandas_udf("struct<axes: array<array<double>>, spread: array<double>>")
    def decompose(*c: pd.Series) -> pd.DataFrame:
        out = []
        for xx, xy, xz, yy, yz, zz in zip(*c):
            values, vectors = np.linalg.eigh(np.nan_to_num(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], float)))
            axes = vectors.T[::-1]
            axes = [(a if a[np.abs(a).argmax()] > 0 else -a).tolist() for a in axes]
            out.append((axes, np.sqrt(np.maximum(values[::-1], 0)).tolist()))
        return pd.DataFrame(out, columns=["axes", "spread"])

    d = moments.withColumn("_d", decompose(*[F.col(f"c_{a}{b}") for a, b in pairs]))
    return d.select(group, "n", F.array(*[f"m_{c}" for c in XYZ]).alias("centre"), "_d.axes", "_d.spread")


def pca_order(points: DataFrame, group: str = "group", key: str = "id") -> DataFrame:
    """Adds ``pos`` along the principal axis from 0, and the coordinates ``u, v, w`` on the three axes (V1); ties by key."""
    j = points.join(principal_axes(points, group), group)
    along = lambda k: sum(((F.col(c) - F.col("centre")[i]) * F.col("axes")[k][i] for i, c in enumerate(XYZ)), F.lit(0.0))
    j = j.withColumn("u", along(0)).withColumn("v", along(1)).withColumn("w", along(2)).drop("centre", "axes", "spread", "n")
    return j.withColumn("pos", F.row_number().over(W.partitionBy(group).orderBy("u", key)) - 1)


def _order(group: str) -> W:
    return W.partitionBy(group).orderBy("pos")


def steps(rows: DataFrame, group: str = "group") -> DataFrame:
    """Adds dx, dy, dz, step, arc (from the first point), centred_arc and turn, the angle between this step and the one before (V2)."""
    w = _order(group)
    out = rows
    for c in XYZ:
        out = out.withColumn(f"d{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    out = out.withColumn("step", F.sqrt(sum((F.col(f"d{c}") ** 2 for c in XYZ), F.lit(0.0))))
    out = out.withColumn("arc", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("centred_arc", F.col("arc") - F.avg("arc").over(W.partitionBy(group)))
    for c in XYZ:
        out = out.withColumn(f"_p{c}", F.lag(f"d{c}").over(w))
    out = out.withColumn("_ps", F.lag("step").over(w))
    cos = sum((F.col(f"d{c}") * F.col(f"_p{c}") for c in XYZ), F.lit(0.0)) / (F.col("step") * F.col("_ps"))
    out = out.withColumn("turn", F.when((F.col("step") > 0) & (F.col("_ps") > 0), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))).otherwise(0.0))
    return out.drop("_px", "_py", "_pz", "_ps")


def tortuosity(rows: DataFrame, group: str = "group") -> DataFrame:
    """``group, tortuosity``: length over the distance of the ends; fewer than two points give 1 (V3)."""
    s = steps(rows, group).groupBy(group).agg(F.count("*").alias("n"), F.sum("step").alias("length"), *[f(c, "pos").alias(f"{n}{c}") for c in XYZ for n, f in (("a", F.min_by), ("b", F.max_by))])
    gap = distance(("ax", "ay", "az"), ("bx", "by", "bz"))
    return s.select(group, F.when(F.col("n") < 2, 1.0).otherwise(F.col("length") / F.greatest(gap, F.lit(1e-9))).alias("tortuosity"))


def tokens(ordered: DataFrame, group: str = "group", threshold: float = 0.4) -> DataFrame:
    """``group, pos, token`` of each step to the next point: forward or back if its share along the first axis passes the threshold, else left or right by the second (V4); rows of ``pca_order``."""
    w = _order(group)
    j = ordered.withColumn("_du", F.lead("u").over(w) - F.col("u")).withColumn("_dv", F.lead("v").over(w) - F.col("v")).withColumn("_dw", F.lead("w").over(w) - F.col("w")).where("_du is not null")
    size = F.sqrt(F.col("_du") ** 2 + F.col("_dv") ** 2 + F.col("_dw") ** 2)
    share = F.when(size > 0, F.col("_du") / size).otherwise(0.0)
    token = F.when(share > threshold, "F").when(share < -threshold, "B").when(F.col("_dv") >= 0, "L").otherwise("R")
    return j.select(group, "pos", token.alias("token"))


def bigrams(toks: DataFrame, group: str = "group") -> DataFrame:
    """``group, first, second, n``."""
    j = toks.withColumn("second", F.lead("token").over(_order(group))).where("second is not null")
    return j.groupBy(group, F.col("token").alias("first"), "second").agg(F.count("*").alias("n"))


def bigram_features(toks: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """One row per group: 16 bigram shares and their conditional entropy; without bigrams all 0 (V5)."""
    b = bigrams(toks, group).withColumn("pair", F.concat("first", "second"))
    names = ["".join(p) for p in product(TOKENS, TOKENS)]
    total = b.groupBy(group).agg(F.sum("n").alias("_t"))
    wide = b.groupBy(group).pivot("pair", names).agg(F.sum("n")).na.fill(0).join(total, group)
    first = b.groupBy(group, "first").agg(F.sum("n").alias("_f"))
    h = b.join(first, [group, "first"]).join(total, group).groupBy(group).agg((-F.sum(F.col("n") / F.col("_t") * F.log(F.col("n") / F.col("_f") + 1e-9))).alias("cond_entropy"))
    out = groups.select(group).distinct().join(wide, group, "left").join(h, group, "left").na.fill(0.0)
    return out.select(group, *[F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(0.0).alias(c) for c in names], "cond_entropy")


def bigram_model(toks: DataFrame, group: str = "group", smooth: float = 1.0) -> DataFrame:
    """``first, second, n, p`` of a whole population, smoothed."""
    spark = toks.sparkSession
    every = spark.createDataFrame([(a, b) for a, b in product(TOKENS, TOKENS)], "first string, second string")
    n = every.join(bigrams(toks, group).groupBy("first", "second").agg(F.sum("n").alias("n")), ["first", "second"], "left").na.fill(0, ["n"])
    total = n.groupBy("first").agg(F.sum("n").alias("_t"))
    return n.join(total, "first").select("first", "second", "n", ((F.col("n") + smooth) / (F.col("_t") + smooth * len(TOKENS))).alias("p"))


def grammar_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Kullback-Leibler divergence of two bigram models, weighted by how often a's first tokens occur."""
    j = a.select("first", "second", "n", F.col("p").alias("_p")).join(b.select("first", "second", F.col("p").alias("_q")), ["first", "second"])
    first = j.groupBy("first").agg(F.sum("n").alias("_f"), F.sum(F.col("_p") * F.log(F.col("_p") / F.col("_q"))).alias("_k"))
    return first.agg(F.try_divide(F.sum(F.col("_f") * F.col("_k")), F.sum("_f")).alias("kl"))


def windows(rows: DataFrame, size: int, group: str = "group") -> DataFrame:
    """``group, start, k, x, y, z``: sliding windows of a chain with half a window's stride (V6)."""
    stride = max(1, size // 2)
    n = rows.groupBy(group).agg((F.max("pos") + 1).alias("_n"))
    j = rows.join(n, group).where(F.col("_n") >= size)
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride)), F.floor(F.col("pos") / stride))
    out = j.withColumn("_s", F.explode(F.when(F.ceil((F.greatest(F.col("pos") - size + 1, F.lit(0))) / stride) <= F.floor(F.col("pos") / stride), starts).otherwise(F.array().cast("array<bigint>"))))
    out = out.withColumn("start", F.col("_s") * stride).where(F.col("start") + size <= F.col("_n"))
    return out.select(group, "start", (F.col("pos") - F.col("start")).alias("k"), *XYZ)


def spliced(rows: DataFrame, size: int, cell: float, group: str = "group", hard: bool = True, seed: int = 0) -> DataFrame:
    """``group, other, k, x, y, z``: false chains, whose second half comes from another group: the nearest (hard) or a hashed one (easy) (V6)."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in XYZ]).where(F.col("_n") >= size)
    centres = n.select(F.col(group).alias("id"), *XYZ)
    if hard:
        mate = knn(centres, centres, 1, cell).select(F.col("a").alias(group), F.col("b").alias("other"))
    else:
        # Neighbours in hash order, within hash parts so that no task orders all groups.
        order = W.partitionBy(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(64))).orderBy(F.xxhash64("id", F.lit(seed + 1)))
        mate = centres.withColumn("other", F.lead("id").over(order)).where("other is not null").select(F.col("id").alias(group), "other")
    half = size // 2
    first = rows.where(F.col("pos") < half).join(mate, group).select(group, "other", F.col("pos").alias("k"), *XYZ)
    second = rows.where((F.col("pos") >= half) & (F.col("pos") < size)).withColumnRenamed(group, "other").join(mate, "other").select(group, "other", F.col("pos").alias("k"), *XYZ)
    return first.unionByName(second)


def with_gap(rows: DataFrame, group: str = "group", seed: int = 0) -> DataFrame:
    """Chains with one inner point left out, by hash (V6, deletion)."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    j = rows.join(n, group).withColumn("_out", 1 + F.pmod(F.xxhash64(group, F.lit(seed)), F.greatest(F.col("_n") - 2, F.lit(1)))).where("pos <> _out or _n < 3")
    return j.withColumn("pos", F.row_number().over(_order(group)) - 1).drop("_n", "_out")


def with_insertion(rows: DataFrame, offset_nm: float, group: str = "group", seed: int = 0) -> DataFrame:
    """Chains with one false point, beside an inner one (V6, insertion)."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    j = rows.join(n, group).withColumn("_at", F.pmod(F.xxhash64(group, F.lit(seed)), "_n"))
    false = j.where("pos = _at").withColumn("x", F.col("x") + offset_nm).withColumn("pos", F.col("pos") + F.lit(0.5))
    both = j.withColumn("pos", F.col("pos").cast("double")).unionByName(false)
    return both.withColumn("pos", F.row_number().over(_order(group)) - 1).drop("_n", "_at")


def directions(rows: DataFrame, group: str = "group") -> DataFrame:
    """Adds tx, ty, tz: unit centred difference (V6)."""
    w = _order(group)
    out = rows
    for c in XYZ:
        out = out.withColumn(f"_t{c}", F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)))
    size = F.sqrt(sum((F.col(f"_t{c}") ** 2 for c in XYZ), F.lit(0.0)))
    for c in XYZ:
        out = out.withColumn(f"t{c}", F.when(size > 0, F.col(f"_t{c}") / size).otherwise(0.0))
    return out.drop(*[f"_t{c}" for c in XYZ])


def parallel_neighbours(rows: DataFrame, cell: float, min_cos: float = 0.8, group: str = "group", key: str = "id") -> DataFrame:
    """``a, b, d``: nearest points of other chains that run in parallel (V6)."""
    d = directions(rows, group)
    p = d.select(F.col(key).alias("id"), *XYZ, group)
    near = knn(p, p, 1, cell, differs=group)
    end = lambda k, n: d.select(F.col(key).alias(k), *[F.col(f"t{c}").alias(f"{n}{c}") for c in XYZ])
    j = near.join(end("a", "p"), "a").join(end("b", "q"), "b")
    cos = F.abs(sum((F.col(f"p{c}") * F.col(f"q{c}") for c in XYZ), F.lit(0.0)))
    return j.where(cos >= min_cos).select("a", "b", "d")


def junction_windows(edits: DataFrame, rows: DataFrame, half: int, group: str = "group") -> DataFrame:
    """``edit_id, label, k, x, y, z``: the last points of one chain and the first of the next across an edit; k is counted from the left end of a full window (V7); merges are 0, splits 1; edits (edit_id, op, left, right)."""
    n = rows.groupBy(group).agg(F.max("pos").alias("_last"))
    tail = rows.join(n, group).where(F.col("pos") > F.col("_last") - half)
    a = edits.join(tail, F.col("left") == tail[group]).select("edit_id", "op", (half - 1 - (F.col("_last") - F.col("pos"))).alias("k"), *XYZ)
    b = edits.join(rows.where(F.col("pos") < half), F.col("right") == rows[group]).select("edit_id", "op", (half + F.col("pos")).alias("k"), *XYZ)
    return a.unionByName(b).select("edit_id", (F.col("op") == "split").cast("int").alias("label"), "k", *XYZ)


def intrinsic(rows: DataFrame, group: str = "group") -> DataFrame:
    """``group, pos, log_step, turn, log_r, dlog_r``: the four intrinsic features, 0 where a neighbour is missing."""
    w = _order(group)
    s = steps(rows, group)
    inner = F.lag("pos").over(w).isNotNull() & F.lead("pos").over(w).isNotNull()
    log_r = F.log(F.greatest("r", F.lit(1e-6)))
    out = s.withColumn("log_step", F.when(F.lag("pos").over(w).isNotNull(), F.log(F.greatest("step", F.lit(1e-6)))).otherwise(0.0)).withColumn("log_r", log_r)
    out = out.withColumn("dlog_r", F.coalesce(F.col("log_r") - F.lag("log_r").over(w), F.lit(0.0)))
    return out.withColumn("_t", F.when(inner, F.lead("turn").over(w)).otherwise(0.0)).select(group, "pos", "log_step", F.col("_t").alias("turn"), "log_r", "dlog_r")


def seams(ordered: DataFrame, group: str = "group") -> DataFrame:
    """Adds ``seam``: the next point has another label, both not 0."""
    after = F.lead("label").over(_order(group))
    return ordered.withColumn("seam", F.coalesce((after != F.col("label")) & (after != 0) & (F.col("label") != 0), F.lit(False)))


def junctions(ordered: DataFrame, group: str = "group") -> DataFrame:
    """``group, pos, step_before, step_after, ratio, turn, span, seam`` at inner junctions of groups of four points or more."""
    w = _order(group)
    s = seams(steps(ordered, group), group).withColumn("_n", F.count("*").over(W.partitionBy(group)))
    s = s.withColumn("step_after", F.lead("step").over(w)).withColumn("_t", F.lead("turn").over(w))
    for c in XYZ:
        s = s.withColumn(f"_a{c}", F.lag(c).over(w)).withColumn(f"_b{c}", F.lead(c).over(w))
    span = distance(("_ax", "_ay", "_az"), ("_bx", "_by", "_bz"))
    out = s.where("_n >= 4 and step_after is not null and _ax is not null")
    return out.select(group, "pos", F.col("step").alias("step_before"), "step_after", (F.col("step_after") / F.greatest("step", F.lit(1e-9))).alias("ratio"), F.col("_t").alias("turn"), span.alias("span"), "seam")


def _tube_cells(width: F.Column, radius: F.Column, length: F.Column) -> F.Column:
    """The cells ``{x, y, z}`` of that width, within lo_x to hi_x and so on, which the tube from p to q can touch, for a radius of at most the width: each stretch
    of the segment no longer than the width has at most 4 x 4 x 4."""
    n = F.greatest(F.ceil(length / width), F.lit(1)).cast("int")

    def of(i: F.Column) -> F.Column:
        spans = []
        for c in XYZ:
            at = lambda k: F.col(f"p{c}") + (F.col(f"q{c}") - F.col(f"p{c}")) * k / n  # noqa: B023, E731
            low = F.floor(F.greatest(F.least(at(i), at(i + 1)) - radius * 1.000001, F.col(f"lo_{c}")) / width)
            high = F.floor(F.least(F.greatest(at(i), at(i + 1)) + radius * 1.000001, F.col(f"hi_{c}")) / width)
            spans.append(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
        x, y, z = spans
        return F.flatten(F.transform(x, lambda p: F.flatten(F.transform(y, lambda q: F.transform(z, lambda r: F.struct(p.alias("x"), q.alias("y"), r.alias("z")))))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of)))


def gap_occupancy(pairs: DataFrame, obs: DataFrame, bins: int = 6, share: float = 0.15, floor_nm: float = 500.0, few: int = 4) -> DataFrame:
    """``a, b, occupancy``: share of bins between two points that hold a point of the segment within a tube (V8); the ends count, and points at one place have 1.

    pairs (a, b, seg, ax, ..., bz); obs (id, seg, x, y, z).  The tube's radius is ``share`` of the length, ``floor_nm`` at least.  As the first and the last bin
    count anyway, a pair meets the points in the cells that the tube touches in between only; cells are as wide as the next power of two above the radius.
    In a crowd a few points show that a bin is held: each cell first answers with ``few`` of its points, and only pairs with an empty bin by then meet the rest.
    """
    tmp = Scratch(pairs.sparkSession, "gaps")
    cell = ["_c0", "_c1", "_c2"]
    ends = [f"{e}{c}" for e in "ab" for c in XYZ]
    j = pairs.select("a", "b", "seg", *ends).distinct().withColumn("_l", distance(("ax", "ay", "az"), ("bx", "by", "bz"))).where("_l >= 1e-6")
    j = j.withColumn("_r", F.greatest(share * F.col("_l"), F.lit(floor_nm))).withColumn("_s", F.ceil(F.log2("_r")).cast("int"))
    box = obs.groupBy("seg").agg(*[f(c).alias(f"{e}{c}") for c in XYZ for e, f in (("lo_", F.min), ("hi_", F.max))])
    j = tmp.write(j.join(box, "seg", "left"), "pairs")
    size = j.count()
    width = F.pow(F.lit(2.0), F.col("_s"))
    first, last = max(0.0, 1 / bins - 1e-6), min(1.0, 1 - 1 / bins + 1e-6)

    def tubes(of: DataFrame) -> DataFrame:
        of = of.repartition(max(int(tmp.spark.conf.get("spark.sql.shuffle.partitions")), size // 50_000), "a", "b")  # a pair is some dozen cells
        between = of.withColumns({f"{n}{c}": F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t for c in XYZ for n, t in (("p", first), ("q", last))})
        out = between.withColumn("_c", F.explode(_tube_cells(width, F.col("_r"), F.col("_l") * abs(last - first))))
        # How near the cell's centre comes to the tube's axis.
        centre = {c: (F.col(f"_c.{c}") + 0.5) * width for c in XYZ}
        along = sum(((centre[c] - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in XYZ), F.lit(0.0)) / (F.col("_l") * F.col("_l"))
        out = out.withColumn("_t", F.least(F.greatest(along, F.lit(min(first, last))), F.lit(max(first, last))))
        off = F.sqrt(sum(((centre[c] - F.col(f"a{c}") - F.col("_t") * (F.col(f"b{c}") - F.col(f"a{c}"))) ** 2 for c in XYZ), F.lit(0.0)))
        out = out.where(off <= (F.col("_r") + width * (math.sqrt(3) / 2)) * 1.000001)
        return shuffled(out.select("a", "b", "seg", "_s", *[F.col(f"_c.{c}").alias(k) for k, c in zip(cell, XYZ)], *ends))

    def hits(met: DataFrame) -> DataFrame:
        span = sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in XYZ), F.lit(0.0))
        met = met.withColumn("_l", F.sqrt(span)).withColumn("_t", sum(((F.col(c) - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in XYZ), F.lit(0.0)) / (F.col("_l") * F.col("_l")))
        off = F.sqrt(sum(((F.col(c) - F.col(f"a{c}") - F.col("_t") * (F.col(f"b{c}") - F.col(f"a{c}"))) ** 2 for c in XYZ), F.lit(0.0)))
        inner = met.where("_t >= 0 and _t <= 1").where(off <= F.greatest(share * F.col("_l"), F.lit(floor_nm)))
        return inner.select("a", "b", F.least(F.floor(F.col("_t") * bins), F.lit(bins - 1)).alias("_bin")).where((F.col("_bin") > 0) & (F.col("_bin") < bins - 1)).distinct()

    held = obs.select("seg", *XYZ).join(j.select("seg", "_s").distinct(), "seg").withColumns({k: F.floor(F.col(c) / width) for k, c in zip(cell, XYZ)})
    some = held.withColumn("_k", F.row_number().over(W.partitionBy("seg", "_s", *cell).orderBy(F.xxhash64(*XYZ)))).where(F.col("_k") <= few + 1)
    some = some.groupBy("seg", "_s", *cell).agg(F.collect_list(F.when(F.col("_k") <= few, F.struct(*XYZ))).alias("_some"), F.max("_k").alias("_k"))
    some = tmp.write(some, "some")
    found = tmp.write(hits(tubes(j).join(some, ["seg", "_s", *cell]).select("a", "b", *ends, F.explode("_some").alias("_p")).select("a", "b", *ends, "_p.*")), "found")
    full = found.groupBy("a", "b").agg(F.count("*").alias("_n")).where(F.col("_n") >= bins - 2)
    rest = tubes(j.join(full, ["a", "b"], "left_anti"))
    crowded = shuffled(rest.join(some.where(F.col("_k") > few).select("seg", "_s", *cell), ["seg", "_s", *cell]))
    more = tmp.write(hits(crowded.join(held, ["seg", "_s", *cell]).select("a", "b", *ends, *XYZ)), "more")
    both = j.select("a", "b", F.explode(F.array(F.lit(0), F.lit(bins - 1)).cast("array<long>")).alias("_bin"))  # the end at t = 1 may round to beside it
    occupied = found.unionByName(more).unionByName(both).groupBy("a", "b").agg((F.countDistinct("_bin") / bins).alias("occupancy"))
    return pairs.select("a", "b").join(occupied, ["a", "b"], "left").na.fill(1.0, ["occupancy"])


def tip_directions(tips: DataFrame, obs: DataFrame, k: int, cell: float) -> DataFrame:
    """``id, tx, ty, tz, spacing``: from the centre of the k nearest points of the same fragment to the tip, and their mean distance (V9)."""
    near = knn(tips, obs, k, cell, key="seg").select(F.col("a").alias("id"), F.col("b"), "d")
    j = near.join(obs.select(F.col("id").alias("b"), *[F.col(c).alias(f"n{c}") for c in XYZ]), "b").groupBy("id").agg(F.avg("d").alias("spacing"), *[F.avg(f"n{c}").alias(f"n{c}") for c in XYZ])
    j = tips.join(j, "id")
    size = distance(XYZ, ("nx", "ny", "nz"))
    return j.select("id", *[F.when(size > 0, (F.col(c) - F.col(f"n{c}")) / size).otherwise(0.0).alias(f"t{c}") for c in XYZ], "spacing")


def continuation(pairs: DataFrame, tips: DataFrame) -> DataFrame:
    """Adds gap, align_a, align_b, opposed, spacing_a, spacing_b, spacing_ratio, rel_gap to pairs (a, b) of tips (id, x.., t.., spacing) (V9)."""
    end = lambda k, p: tips.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}{c}") for c in (*XYZ, "tx", "ty", "tz", "spacing")])
    j = pairs.join(end("a", "p_"), "a").join(end("b", "q_"), "b").withColumn("gap", distance(("p_x", "p_y", "p_z"), ("q_x", "q_y", "q_z")))
    g = F.greatest("gap", F.lit(1e-9))
    align = lambda own, sign: sum(((F.col(f"q_{c}") - F.col(f"p_{c}")) * sign / g * F.col(f"{own}_t{c}") for c in XYZ), F.lit(0.0))
    j = j.withColumn("align_a", align("p", 1)).withColumn("align_b", align("q", -1)).withColumn("opposed", -sum((F.col(f"p_t{c}") * F.col(f"q_t{c}") for c in XYZ), F.lit(0.0)))
    low, high = F.least("p_spacing", "q_spacing"), F.greatest("p_spacing", "q_spacing", F.lit(1e-9))
    return j.select(*pairs.columns, "gap", "align_a", "align_b", "opposed", F.col("p_spacing").alias("spacing_a"), F.col("q_spacing").alias("spacing_b"), (low / high).alias("spacing_ratio"), (F.col("gap") / high).alias("rel_gap"))
