"""Two-version worlds: observations of a region with base ids, later ids and fragments."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.sides import sides, sliver_filter
from pointweave.operators.versions import root_as_of
from pointweave.sources.synapses import region_scan


class World(NamedTuple):
    """``obs``, and ``seg_label`` (seg, label, n): which later roots each base id holds."""

    obs: DataFrame
    seg_label: DataFrame


def seg_label(obs: DataFrame) -> DataFrame:
    return obs.where("seg <> 0 and label <> 0").groupBy("seg", "label").agg(F.count("*").alias("n"))


def region_world(synapses: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], side: str = "both", min_obs: int = 1) -> World:
    """Scan, long sides, sliver filter."""
    point = tuple(f"{'post' if side == 'post' else 'pre'}_{c}" for c in ("x", "y", "z"))
    obs = sliver_filter(sides(region_scan(synapses, low, high, point), side), min_obs)
    return World(obs, seg_label(obs))


def neuron_world(synapses: DataFrame, roots: DataFrame, min_obs: int = 1) -> World:
    """The observations of chosen later roots."""
    obs = sides(synapses).join(roots.select(F.col("root").alias("label")).distinct(), "label", "left_semi")
    obs = sliver_filter(obs, min_obs)
    return World(obs, seg_label(obs))


def nodes_world(nodes: DataFrame, lineage: DataFrame, at: object, min_obs: int = 1) -> World:
    """Finer nodes as observations: base ids as of a time, no partners (id 0)."""
    based = root_as_of(nodes.withColumn("at", F.lit(at)), lineage).withColumnRenamed("root", "seg").drop("at")
    obs = sliver_filter(based.withColumn("partner", F.lit(0)), min_obs)
    return World(obs, seg_label(obs))
