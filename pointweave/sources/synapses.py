"""Readers of synapse, nucleus, cell-type and degree tables, and of files that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.columns import in_box, x_tile
from pointweave.operators.sides import one_per_id


def resolve(columns: list[str], candidates: dict[str, list[str]], needed: tuple[str, ...] = ()) -> dict[str, str]:
    """For each wanted name the first candidate among the columns, whatever its case."""
    lower = {c.lower(): c for c in columns}
    out = {want: lower[c.lower()] for want, names in candidates.items() for c in names[::-1] if c.lower() in lower}
    if gone := [n for n in needed if n not in out]:
        raise ValueError(f"no column for {', '.join(gone)} among {', '.join(columns)}")
    return out


def renamed(df: DataFrame, candidates: dict[str, list[str]], needed: tuple[str, ...] = ()) -> DataFrame:
    found = resolve(df.columns, candidates, needed)
    return df.select(*[F.col(c).alias(want) for want, c in found.items()])


def region_scan(synapses: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], point: tuple[str, str, str] = ("x", "y", "z"), columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Valid rows whose point lies in a box (S1, S2): plain range filters, which Parquet pushes down."""
    rows = synapses.where("valid") if "valid" in synapses.columns else synapses
    rows = rows.where(in_box(point, low, high))
    rows = rows.select(*columns) if columns else rows
    return rows.orderBy("syn_id").limit(limit) if limit is not None else rows


def tiled_scan(tiles: list[DataFrame], key: str = "syn_id") -> DataFrame:
    """Tiles that overlap, each id from the first tile that has it (S3)."""
    every = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_tile", F.lit(k)) for k, t in enumerate(tiles)])
    return one_per_id(every, key, "_tile").drop("_tile")


def with_tile(synapses: DataFrame, low: float, high: float, tiles: int, x: str = "x") -> DataFrame:
    return synapses.withColumn("tile", x_tile(x, low, high, tiles))


def touching(synapses: DataFrame, roots: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """Synapses with a root of the list on either side, once each."""
    a = synapses.join(roots.select(F.col("root").alias(pre)).distinct(), pre, "left_semi")
    b = synapses.join(roots.select(F.col("root").alias(post)).distinct(), post, "left_semi")
    return a.select(*synapses.columns).unionByName(b.select(*synapses.columns)).dropDuplicates(["syn_id"])


def roots_in_box(nuclei: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Distinct roots, not 0, whose nucleus lies in a box."""
    return nuclei.where(in_box(("x", "y", "z"), low, high)).where("root_id <> 0").select("root_id").distinct()


def headerless_csv(spark: SparkSession, path: str, header_path: str, kinds: dict[str, str], partitions: int | None = None) -> DataFrame:
    """A CSV whose header line is a file of its own (S6); gz files don't split, so rows are dealt out after reading if asked."""
    names = [c.strip() for c in spark.read.text(header_path).first()[0].split(",")]
    rows = spark.read.schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path)
    return rows.repartition(partitions) if partitions else rows


def nuclei(spark: SparkSession, path: str, voxel_nm: tuple[float, float, float] | None = None) -> DataFrame:
    """``nucleus_id, sv, root_id, x, y, z`` from CSV, without rows whose root is no number or 0."""
    raw = spark.read.option("header", True).csv(path)
    t = renamed(raw, {"nucleus_id": ["nucleus_id", "id"], "sv": ["sv", "supervoxel_id", "pt_supervoxel_id"], "root_id": ["root_id", "pt_root_id"], "x": ["x", "pt_position_x"], "y": ["y", "pt_position_y"], "z": ["z", "pt_position_z"]}, ("root_id",))
    for c, kind in (("nucleus_id", "bigint"), ("sv", "bigint"), ("root_id", "bigint"), ("x", "double"), ("y", "double"), ("z", "double")):
        if c in t.columns:
            t = t.withColumn(c, F.expr(f"try_cast({c} as {kind})"))
    if voxel_nm:
        for c, v in zip(("x", "y", "z"), voxel_nm):
            t = t.withColumn(c, F.col(c) * v)
    return t.where("root_id is not null and root_id <> 0")


def cell_types(spark: SparkSession, path: str) -> DataFrame:
    """``root_id, cell_type``."""
    raw = spark.read.option("header", True).csv(path)
    t = renamed(raw, {"root_id": ["root_id", "pt_root_id"], "cell_type": ["cell_type", "type", "classification_system", "class"]}, ("root_id", "cell_type"))
    return t.withColumn("root_id", F.expr("try_cast(root_id as bigint)")).where("root_id is not null and root_id <> 0")


def type_census(types: DataFrame) -> DataFrame:
    """``cell_type, n``, the most frequent first."""
    return types.groupBy("cell_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_type")


def degree_table(raw: DataFrame) -> DataFrame:
    """``root, n_pre, n_post, total``, nulls as 0."""
    t = renamed(raw, {"root": ["root", "root_id", "pt_root_id"], "n_pre": ["n_pre", "pre_count", "num_pre", "out_degree"], "n_post": ["n_post", "post_count", "num_post", "in_degree"]}, ("root",))
    for c in ("n_pre", "n_post"):
        t = t.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long") if c in t.columns else F.lit(0).cast("long"))
    return t.withColumn("total", F.col("n_pre") + F.col("n_post"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Edit pairs and root maps."""
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def with_assets(manifest: DataFrame, base: str, root: str = "root_id") -> DataFrame:
    """Adds asset addresses that follow from the root."""
    return manifest.withColumn("mesh_url", F.concat(F.lit(f"{base}/mesh/"), F.col(root).cast("string"))).withColumn("skeleton_url", F.concat(F.lit(f"{base}/skeleton/"), F.col(root).cast("string")))


def bounding_box(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row lo_x, hi_x, ...."""
    return points.agg(*[e for c in ("x", "y", "z") for e in ((F.min(c) - margin).alias(f"lo_{c}"), (F.max(c) + margin).alias(f"hi_{c}"))])


def sample_roots(roots: DataFrame, n: int, types: DataFrame | None = None, wanted: list[str] | None = None, status: str | None = None, seed: int = 0) -> DataFrame:
    """n roots in hash order, of some cell types or under a status condition (T4, T5)."""
    r = roots
    if types is not None and wanted:
        r = r.join(types.where(F.col("cell_type").isin(wanted)).select("root_id").distinct(), "root_id", "left_semi")
    if status:
        r = r.where(status)
    return r.orderBy(F.xxhash64("root_id", F.lit(seed)), "root_id").limit(n)
