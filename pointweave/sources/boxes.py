"""Datasets of boxes and fragments: written once, read by what is needed, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.spatial import points_in_boxes


def box_grid(low: tuple[float, float, float], high: tuple[float, float, float], side: float, spark: SparkSession) -> DataFrame:
    """``box_id, x, y, z, side``: centres of a grid of boxes."""
    n = [max(1, int((hi - lo) // side)) for lo, hi in zip(low, high)]
    ids = spark.range(n[0] * n[1] * n[2])
    place = [F.col("id") % n[0], F.floor(F.col("id") / n[0]) % n[1], F.floor(F.col("id") / (n[0] * n[1]))]
    return ids.select(F.col("id").alias("box_id"), *[(F.lit(lo) + (p + 0.5) * side).alias(c) for c, lo, p in zip(("x", "y", "z"), low, place)], F.lit(float(side)).alias("side"))


def members(boxes: DataFrame, synapses: DataFrame, cell: float) -> DataFrame:
    """Each box's synapses (S11, J32); boxes (box_id, x, y, z, side)."""
    b = boxes.select("box_id", *[e for c in ("x", "y", "z") for e in ((F.col(c) - F.col("side") / 2).alias(f"lo_{c}"), (F.col(c) + F.col("side") / 2).alias(f"hi_{c}"))])
    return points_in_boxes(b, synapses, cell).drop(*[f"{e}_{c}" for c in ("x", "y", "z") for e in ("lo", "hi")])


def catalogue(boxes: DataFrame, held: DataFrame) -> DataFrame:
    """Boxes with n_synapses and n_positive_pairs."""
    n = held.groupBy("box_id").agg(F.count("*").alias("n_synapses"))
    sides = held.select("box_id", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("pre_root").alias("r")), F.struct(F.lit(1).alias("s"), F.col("post_root").alias("r")))).alias("e")).select("box_id", "e.*").where("r <> 0")
    p = sides.groupBy("box_id", "s", "r").agg(F.count("*").alias("n")).groupBy("box_id").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n_positive_pairs"))
    return boxes.join(n, "box_id", "left").join(p, "box_id", "left").na.fill(0, ["n_synapses", "n_positive_pairs"])


def write_boxes(held: DataFrame, boxes: DataFrame, path: str) -> None:
    """Synapses under ``path/data`` by box, the catalogue under ``path/catalogue``."""
    held.repartition("box_id").write.mode("append").partitionBy("box_id").parquet(f"{path}/data")
    catalogue(boxes, held).write.mode("append").parquet(f"{path}/catalogue")


def read_boxes(spark: SparkSession, path: str, min_synapses: int = 0, max_synapses: int | None = None, min_pairs: int = 0) -> DataFrame:
    """Synapses of boxes within the limits; only their files are read."""
    chosen = spark.read.parquet(f"{path}/catalogue").where((F.col("n_synapses") >= min_synapses) & (F.col("n_positive_pairs") >= min_pairs))
    if max_synapses is not None:
        chosen = chosen.where(F.col("n_synapses") <= max_synapses)
    return spark.read.parquet(f"{path}/data").join(chosen.select("box_id"), "box_id", "left_semi")


def todo(boxes: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Boxes that the dataset doesn't hold yet."""
    try:
        done = spark.read.parquet(f"{path}/catalogue").select("box_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return boxes
    return boxes.join(done, "box_id", "left_anti")


def audit(spark: SparkSession, path: str, base: int, target: int) -> DataFrame:
    """One row: versions, boxes in the catalogue, boxes with data, and whether both agree."""
    c = spark.read.parquet(f"{path}/catalogue")
    d = spark.read.parquet(f"{path}/data").select("box_id").distinct()
    full = c.where("n_synapses > 0").select("box_id").withColumn("c", F.lit(1)).join(d.withColumn("d", F.lit(1)), "box_id", "full_outer")
    return full.agg(F.lit(base).alias("seg_version"), F.lit(target).alias("label_version"), F.count_if(F.col("c").isNotNull()).alias("in_catalogue"), F.count_if(F.col("d").isNotNull()).alias("with_data"), F.count_if(F.col("c").isNull() | F.col("d").isNull()).alias("incomplete"))


def incomplete(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of the catalogue without data."""
    c = spark.read.parquet(f"{path}/catalogue").where("n_synapses > 0")
    return c.join(spark.read.parquet(f"{path}/data").select("box_id").distinct(), "box_id", "left_anti")


def write_fragments(path: str, vertices: DataFrame, edges: DataFrame, frags: DataFrame) -> None:
    """Fragments as three tables."""
    for name, df in (("vertex", vertices), ("edge", edges), ("frag", frags)):
        df.write.parquet(f"{path}/{name}")


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("vertex", "edge", "frag"))


def write_examples(rows: DataFrame, path: str, key: str = "example", order: str = "k") -> None:
    """Examples as one row each with an array of points."""
    points = F.transform(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"]))
    rows.groupBy(key).agg(points.alias("points")).write.parquet(path)


def neighbourhoods(somata: DataFrame, synapses: DataFrame, radius: float, cell: float) -> DataFrame:
    """``root_id`` and the synapses in a cube around each anchor's soma."""
    boxes = somata.select(F.col("root_id").alias("box_id"), *[e for c in ("x", "y", "z") for e in ((F.col(c) - radius).alias(f"lo_{c}"), (F.col(c) + radius).alias(f"hi_{c}"))])
    return points_in_boxes(boxes, synapses, cell).withColumnRenamed("box_id", "root_id").drop(*[f"{e}_{c}" for c in ("x", "y", "z") for e in ("lo", "hi")])
