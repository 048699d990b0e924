"""Observations (synapse sides) and filters on them.

``obs`` has syn_id, side (0 pre, 1 post), x, y, z, seg (base id) and label (later id); 0 is
"none" for both ids and stays 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import hash_order, in_box


def sides(synapses: DataFrame, which: str = "both", label_prefix: str = "root", seg_prefix: str = "seg") -> DataFrame:
    """One row per synapse side; sides without a base id go, later ids of 0 stay (F2)."""
    half = {
        name: F.struct(
            F.lit(k).cast("byte").alias("side"),
            *[F.col(f"{name}_{c}").alias(c) for c in ("x", "y", "z") if f"{name}_{c}" in synapses.columns],
            F.col(f"{name}_{seg_prefix}").cast("long").alias("seg"),
            F.coalesce(F.col(f"{name}_{label_prefix}"), F.lit(0)).cast("long").alias("label"),
        )
        for k, name in enumerate(("pre", "post"))
        if which in ("both", name)
    }
    return synapses.select("syn_id", F.explode(F.array(*half.values())).alias("s")).select("syn_id", "s.*").where("seg > 0")


def clutter_filter(pairs: DataFrame, k: int, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """Rows whose roots both occur k times or more, counted over both sides together (F3); k <= 1 keeps all."""
    if k <= 1:
        return pairs
    ids = pairs.select(F.explode(F.array(pre, post)).alias("_id"))
    busy = ids.groupBy("_id").count().where(F.col("count") >= k).select("_id")
    return pairs.join(busy.withColumnRenamed("_id", pre), pre, "left_semi").join(busy.withColumnRenamed("_id", post), post, "left_semi").select(*pairs.columns)


def sliver_filter(obs: DataFrame, k: int) -> DataFrame:
    """Labelled observations of segments that hold k of them or more."""
    sound = obs.where("seg > 0 and label > 0")
    large = sound.groupBy("seg").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("seg")
    return sound.join(large, "seg", "left_semi").select(*obs.columns)


def half_partitions(obs: DataFrame, min_obs: int, train: bool = True) -> DataFrame:
    """Observations in groups of (base id, side) of ``min_obs`` or more; training also needs a later id."""
    sound = obs.where("seg <> 0 and label <> 0" if train else "seg <> 0")
    large = sound.groupBy("seg", "side").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_obs)
    return sound.join(large, ["seg", "side"], "left_semi").select(*obs.columns)


def slice_box(obs: DataFrame, fragments: DataFrame | None, low: tuple[float, float, float], high: tuple[float, float, float]) -> tuple[DataFrame, DataFrame | None]:
    """Observations inside the box, and the fragments that keep one."""
    inside = obs.where(in_box(("x", "y", "z"), low, high))
    return inside, fragments.join(inside.select("seg").distinct(), "seg", "left_semi") if fragments is not None else None


def capped(obs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All sides of n synapses, chosen by the hash of their id."""
    chosen = obs.select("syn_id").distinct().orderBy(hash_order("syn_id", seed=seed), "syn_id").limit(n)
    return obs.join(chosen, "syn_id", "left_semi")


def seg_partition(obs: DataFrame) -> DataFrame:
    """The base ids as a partition; id 0 becomes a group of its own for each synapse."""
    return obs.withColumn("cluster", F.when(F.col("seg") == 0, -F.col("syn_id")).otherwise(F.col("seg")))


def without_seam(train: DataFrame, test: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], buffer_nm: float) -> DataFrame:
    """Training observations farther than the buffer from the test box, and of none of the test's segments (F16)."""
    outside = F.lit(0.0)
    for c, lo, hi in zip(("x", "y", "z"), low, high):
        gap = F.greatest(F.lit(lo) - F.col(c), F.col(c) - F.lit(hi), F.lit(0.0))
        outside = outside + gap * gap
    return train.where(F.sqrt(outside) > buffer_nm).join(test.where("seg > 0").select("seg").distinct(), "seg", "left_anti").select(*train.columns)


def check_versions(inputs: DataFrame, base: int, target: int) -> DataFrame:
    """Raises if graph inputs aren't of the base version, or labels aren't of the target (F15); reads version columns only."""
    off = inputs.where((F.col("seg_version") != base) | (F.col("label_version") != target)).limit(1).count()
    if off or base == target:
        raise ValueError(f"graph inputs must come from version {base} and labels from a later one, {target}")
    return inputs


def xy_bins(points: DataFrame, width: float, height: float, x: str = "x", y: str = "y", origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds ``bin``: cells of an xy grid, counted row by row from the lowest used."""
    cells = points.withColumn("_bx", F.floor((F.col(x) - origin[0]) / width)).withColumn("_by", F.floor((F.col(y) - origin[1]) / height))
    ends = cells.agg(F.min("_bx").alias("x0"), F.max("_bx").alias("x1"), F.min("_by").alias("y0")).first()
    columns = (ends["x1"] - ends["x0"] + 1) if ends["x0"] is not None else 1
    packed = (F.col("_by") - F.lit(ends["y0"])) * columns + F.col("_bx") - F.lit(ends["x0"])
    return cells.withColumn("bin", packed.cast("long")).drop("_bx", "_by")


def split_by_bin(points: DataFrame, train: list[int] | None = None, test: list[int] | None = None) -> DataFrame:
    """Adds ``split``: by stated bins, or bins above the median of the distinct ones are the test."""
    if train is not None or test is not None:
        split = F.when(F.col("bin").isin(test or []), "test").when(F.col("bin").isin(train) if train is not None else F.lit(True), "train")
        return points.withColumn("split", split)
    middle = points.select("bin").distinct().agg(F.expr("percentile(bin, 0.5)").alias("m")).first()["m"]
    return points.withColumn("split", F.when(F.col("bin") > F.lit(middle), "test").otherwise("train"))


def overlap_weights(members: DataFrame, tube: str = "tube", key: str = "key") -> DataFrame:
    """Adds ``weight`` = 1 / number of tubes that hold the key."""
    n = members.select(key, tube).distinct().groupBy(key).agg(F.count("*").alias("_n"))
    return members.join(n, key).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def box_around(rows: DataFrame, half: tuple[float, float, float], point: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Adds lo_x, hi_x and so on: a box of these half extents around each point (F8)."""
    for c, h in zip(point, half):
        rows = rows.withColumn(f"lo_{c}", F.col(c) - h).withColumn(f"hi_{c}", F.col(c) + h)
    return rows


def random_boxes(spark, n: int, low: tuple[float, float, float], high: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """n box centres inside the bounds, by hashed numbers."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(n).select(F.col("id").alias("box_id"), *[(F.lit(lo) + unit(k) * (hi - lo)).alias(c) for k, (c, lo, hi) in enumerate(zip(("x", "y", "z"), low, high))])


def one_per_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id, for tiles that overlap."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
