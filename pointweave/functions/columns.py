"""Column expressions on points, ids, scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_nm(voxels: str | Column, voxel_nm: float) -> Column:
    """Voxel units to nanometres (F1); the size of a voxel has no default."""
    return col(voxels).cast("double") * F.lit(float(voxel_nm))


def distance(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b):
        total = total + (col(p) - col(q)) * (col(p) - col(q))
    return F.sqrt(total)


def in_box(point: tuple[str, ...], low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """Both faces count."""
    test = F.lit(True)
    for p, lo, hi in zip(point, low, high):
        test &= col(p).between(lo, hi)
    return test


def x_tile(x: str | Column, low: float, high: float, tiles: int) -> Column:
    """Tile of equal width along x, 0 to tiles - 1; the last one is closed."""
    return F.least(F.floor((col(x) - low) / ((high - low) / tiles)), F.lit(tiles - 1)).cast("int")


def stable_key(x: str | Column, y: str | Column, z: str | Column, grid_nm: float = 16.0) -> Column:
    """One long for a position on a grid, halves rounded to even, wrapping on overflow."""
    q = [F.rint(col(c) / grid_nm).cast("long") for c in (x, y, z)]
    m = F.lit(1000003).cast("long")
    return _wrap_add(_wrap_mul(_wrap_add(_wrap_mul(q[0], m), q[1]), m), q[2])


def _wrap_mul(a: Column, b: Column) -> Column:
    """a * b modulo 2**64 as a signed long, for 0 <= b < 2**31, without ANSI overflow."""
    low, high = a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(a, 32)
    low_product = low * b  # below 2**63
    carry = F.shiftright(low_product, 32) + high * b  # below 2**63 in size
    return F.shiftleft(carry, 32).bitwiseOR(low_product.bitwiseAND(F.lit(0xFFFFFFFF)))


def _wrap_add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def sigmoid(logit: str | Column, temperature: float = 1.0) -> Column:
    """Probability of a logit at a temperature."""
    return 1 / (1 + F.exp(-col(logit) / F.lit(float(temperature))))


def log_odds(p: str | Column, eps: float = 1e-6) -> Column:
    clipped = F.greatest(F.least(col(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(clipped / (1 - clipped))


def tier_of(somas: str | Column, synapses: str | Column, big: int = 10) -> Column:
    """Evidence tier of a root: one soma, several, none but many synapses, or none."""
    return F.when(col(somas) == 1, "NAMED").when(col(somas) >= 2, "MULTI").when(col(synapses) >= big, "BIG-NOSOMA").otherwise("ANON")


def truthy(c: str | Column) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("t", "true", "1", "yes")


def difficulty(axon_done: str | Column, dendrite_done: str | Column) -> Column:
    """Proofreading difficulty: both parts done, one, or none."""
    a, d = truthy(axon_done), truthy(dendrite_done)
    return F.when(a & d, "easy").when(a | d, "medium").otherwise("hard")


def pairs_of(n: str | Column) -> Column:
    """n choose 2 as a double: exact up to 2**53, and never overflows."""
    d = col(n).cast("double")
    return d * (d - 1) / 2


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, and the stated value where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays, 0 where either has no length (M7)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: str | Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))


def hash_order(*ids: str, seed: int = 0) -> Column:
    """A repeatable order that stands for a seeded shuffle."""
    return F.xxhash64(*ids, F.lit(seed))
