"""Pairs by keys that many hold, and caps that make no more pairs than they return."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pointweave.operators import pairs, shared, spatial, stitch


@pytest.mark.parametrize("block", [3, 1000])
def test_common_partners_with_a_hub(spark, block):
    rng = random.Random(block)
    rows = [(g, 7) for g in range(1, 60)] + [(rng.randrange(1, 60), rng.randrange(1, 40)) for _ in range(300)] + [(0, 5), (5, 0)]
    got = {(r.ga, r.gb): r.shared for r in spatial.shared_partners(spark.createDataFrame(rows, "seg long, partner long"), block=block).collect()}
    want = Counter()
    for p in {p for _, p in rows if p}:
        want.update(combinations(sorted({g for g, q in rows if q == p and g}), 2))
    assert got == dict(want)
    some = spark.createDataFrame([(1, 2), (3, 59), (3, 59)], "ga long, gb long")
    found = {(r.ga, r.gb): r.shared for r in spatial.shared_partners_of(some, spark.createDataFrame(rows, "seg long, partner long")).collect()}
    assert found == {k: want[k] for k in [(1, 2), (3, 59)]}


def test_links_by_a_key_that_all_hold(spark):
    supers = spark.createDataFrame([(s, s % 5) for s in range(50)], "super_id long, tile_id long")
    keys = spark.createDataFrame([(s, k) for s in range(50) for k in (0, 1 + s // 2)], "super_id long, key long")
    assert {tuple(r) for r in stitch.shared_key_links(supers, keys, 2, block=4).collect()} == {(s, s + 1, 2) for s in range(0, 50, 2)}


def test_a_key_of_100_000_rows_is_spread(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("key"), F.col("id").alias("g"))
    left, right = shared.dealt(rows, "key", "g")
    for side in (left, right):
        n = side.groupBy("key", *shared.BLOCKS).agg(F.count("*").alias("n"))
        assert n.count() == 100 * 100 and n.agg(F.max("n")).first()[0] < 1300


@pytest.mark.parametrize("cap", [1, 7, 40, 10_000])
def test_pairs_of_a_segment(spark, cap):
    obs = spark.createDataFrame([(1000 * s + i, s) for s, n in ((1, 2), (2, 3), (3, 10), (4, 9), (5, 200), (6, 1)) for i in range(n)], "id long, seg long")
    rows = [tuple(r) for r in spatial.same_segment_pairs(obs, cap).collect()]
    assert len(rows) == len(set(rows)) and {(b, a) for a, b in rows} == set(rows)
    n = Counter(a // 1000 for a, b in rows if a < b and a // 1000 == b // 1000)
    assert sum(n.values()) * 2 == len(rows) and n == {s: min(cap, k * (k - 1) // 2) for s, k in ((1, 2), (2, 3), (3, 10), (4, 9), (5, 200))}


@pytest.mark.parametrize("cap", [1, 12, 10_000])
def test_pairs_of_adjacent_fragments(spark, cap):
    sizes = {1: 1, 2: 3, 3: 50, 4: 20}
    obs = spark.createDataFrame([(1000 * f + i, f) for f, n in sizes.items() for i in range(n)], "id long, frag long")
    near = list(combinations(sizes, 2))
    rows = [tuple(r) for r in spatial.adjacent_obs_pairs(spark.createDataFrame(near, "fa long, fb long"), obs, cap).collect()]
    n = Counter((a // 1000, b // 1000) for a, b in rows)
    assert len(rows) == len(set(rows)) and n == {(a, b): min(cap, sizes[a] * sizes[b]) for a, b in near}


def test_lowest_without_a_task_that_holds_them_all(spark):
    rows = spark.range(40_000).select("id", (F.col("id") % 3).alias("b"))
    order = F.xxhash64("id", F.lit(1))
    for n in (0, 1, 777, 39_999, 40_000, 10**9):
        assert sorted(shared.lowest(rows, n, order, "id").collect()) == sorted(rows.orderBy(order, "id").limit(n).collect()), n
    same = shared.lowest(rows, 100, F.lit(-5).cast("long"), "id")  # all in one bin: ties decide
    assert sorted(r["id"] for r in same.collect()) == list(range(100))


def test_negatives_are_not_gathered_in_one_task(spark):
    """The cut at ``ratio`` takes a few rows in order, not all that are kept."""
    rng = random.Random(3)
    p = spark.createDataFrame([(i, 1 + i % 5, 1 + i % 7, *(float(rng.randrange(300)) for _ in range(3))) for i in range(600)], "id long, seg long, label long, x double, y double, z double")
    made = pairs.merge_pairs(p, 3, 300.0)
    kept = made.groupBy("y").count().collect()
    limits = [int(n) for n in re.findall(r"(?:Limit |limit=)(\d+)", made._jdf.queryExecution().executedPlan().toString())]
    assert {r["y"]: r["count"] for r in kept}[0] > 500 and all(n < 50 for n in limits)


def test_all_pairs_of_a_segment(spark):
    """Without a cap, and rows that repeat an id don't meet each other."""
    rows = [(i % 90, i % 2) for i in range(200)] + [(None, 1)]
    made = [tuple(r) for r in spatial.same_segment_pairs(spark.createDataFrame(rows, "id long, seg long")).collect()]
    assert sorted(made) == sorted((a, b) for a, s in rows for b, t in rows if s == t == 1 and None not in (a, b) and a != b)
