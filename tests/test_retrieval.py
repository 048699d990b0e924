"""Nearest codes against comparing all, and from features to codes to precision."""

import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import pairs


def plain(rows, k):
    out = []
    for i, _, y, code, fold in rows:
        near = sorted(((code ^ c).bit_count(), j, z) for j, _, z, c, f in rows if f != fold)
        out += [(i, j, d, y == z) for d, j, z in near[:k]]
    return sorted(out)


def got(spark, rows, k):
    codes = spark.createDataFrame(rows, "id long, group long, y int, code long, fold long")
    return sorted(tuple(r) for r in pairs.retrieval(codes, k).collect())


@pytest.mark.parametrize("seed, bits, n, k", [(1, 63, 250, 3), (2, 16, 300, 2), (3, 5, 120, 7), (4, 63, 3, 5)])
def test_equal_to_comparing_all(spark, seed, bits, n, k):
    """Random codes, and clumps of close and equal ones."""
    rng = random.Random(seed)
    base = [rng.getrandbits(bits) for _ in range(n // 3)]
    code = lambda: rng.choice([rng.getrandbits(bits), rng.choice(base or [0]), rng.choice(base or [0]) ^ (1 << rng.randrange(bits))])
    rows = [(i, i, rng.randrange(2), code(), rng.randrange(3)) for i in range(n)]
    assert got(spark, rows, k) == plain(rows, k)


@pytest.mark.parametrize("worth", [0, 10**9])
def test_by_changes_and_by_comparing_blocks(spark, worth):
    """Both ways give the nearest codes of other folds as far as k members take, ties included; codes of several members and folds, negative ones too."""
    rng = random.Random(9)
    base = [rng.getrandbits(40) for _ in range(40)] + [-1, -2, -(2**63)]
    rows = [(rng.choice(base) ^ (rng.random() < 0.3) << rng.randrange(40), rng.randrange(3)) for _ in range(400)]
    got = sorted(tuple(r) for r in pairs.near_codes(spark.createDataFrame(rows, "code long, fold long"), 3, worth).where("distance <= 64").distinct().collect())
    apart = lambda c, d: ((c ^ d) & (2**64 - 1)).bit_count()
    for c, f in set(rows):
        near = sorted(apart(c, d) for d, g in rows if g != f)
        held = {(c, f, d, apart(c, d)) for d, g in rows if g != f and apart(c, d) <= near[2]}
        mine = {r for r in got if r[:2] == (c, f)}
        assert held <= mine and {r for r in mine if any(d == r[2] and g != f for d, g in rows)} == held


def test_one_fold_has_nobody(spark):
    assert got(spark, [(1, 1, 0, 7, 0), (2, 2, 0, 7, 0)], 2) == []
    assert got(spark, [], 2) == []


def test_far_fewer_codes_meet_than_all_pairs(spark):
    """Close codes are found by the keys that they share, short codes among them."""
    rng = random.Random(8)
    rows = []
    for g in range(1500):
        base = rng.getrandbits(63)
        rows += [(base, g % 2), (base ^ (1 << rng.randrange(63)), (g + 1) % 2)]
    codes = spark.createDataFrame(rows, "code long, fold long")
    found = pairs.near_codes(codes, 1)
    assert found.count() < 3 * len(rows)
    best = found.groupBy("code", "fold").agg(F.min("distance").alias("d"))
    assert best.where("d <= 1").count() == best.count()


def test_features_to_precision(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = [(i, i // 5, i % 4, [x + rng.gauss(0, 0.2) for x in centres[i % 4]]) for i in range(200)]
    codes = pairs.simhash_code(spark.createDataFrame(rows, "id long, group long, y int, f array<double>"), 48)
    found = pairs.retrieval(codes.select("id", "group", "y", "code"), 3)
    row = pairs.retrieval_scores(found, codes).first()
    assert row["precision"] > 0.9 and abs(row["base_rate"] - 0.25) < 1e-9 and row["lift"] > 3.6
