"""What must not grow faster than its input: plans and widths, and the same results by brute force."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import models, pairs, shared, skeleton, spatial, versions
from pointweave.plans import further


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowded(spark, n=300, seed=1, groups=4):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(0, 100, (n - 40, 3)), rng.uniform(400, 900, (40, 3))]).round(3)
    rows = [(i, *map(float, x[i]), i % groups) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, seg long"), x


def test_exploded_rows_are_not_broadcast(spark):
    p, _ = crowded(spark, 60)
    boxes = p.selectExpr("id as box_id", *[f"{c} - 50 as lo_{c}" for c in "xyz"], *[f"{c} + 50 as hi_{c}" for c in "xyz"])
    for found in (spatial.radius_pairs(p, p, 50.0), spatial.points_in_boxes(boxes, p, 30.0)):
        assert "BroadcastHashJoin" not in plan(found)


def test_cells_follow_the_crowd(spark):
    p, _ = crowded(spark)
    assert spatial._width(p, 1000.0, 8) <= 62.5 and spatial._width(p, 1000.0, 300) == 1000.0
    copies = p.withColumns({c: F.lit(5.0) for c in "xyz"})
    assert spatial._width(copies, 1000.0, 8) == 1000.0  # no width tells copies apart


@pytest.mark.parametrize("cell", [20.0, 5000.0])
def test_nearest_in_crowds(spark, cell):
    p, x = crowded(spark)
    got = {(r["a"], r["rank"]): r["b"] for r in spatial.knn(p, p, 3, cell, key="seg").collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    seg = np.arange(len(x)) % 4
    d[(seg[:, None] != seg[None]) | np.eye(len(x), dtype=bool)] = np.inf
    assert got == {(i, k + 1): b for i in range(len(x)) for k, b in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3].tolist())}


def test_all_pairs_meet_in_blocks(spark):
    rows = spark.createDataFrame([(i, 0 if i < 2500 else i % 7) for i in range(3000)], "id long, g long")
    held = shared.in_blocks(rows, "g", F.col("id"), "id", 100)
    assert held.agg(F.max(F.size("members"))).first()[0] < 200 and held.where("g = 0").count() > 20
    made = shared.all_pairs(rows, "g", F.col("id"), "id", 100).select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = rows.groupBy("g").count().select("g", F.expr("count * (count - 1) div 2").alias("n"))
    got = made.groupBy("g").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, n.collect())) and made.where("a < b").distinct().count() == made.count()


def test_pairs_of_a_base_id_are_whole(spark):
    """No number of pairs switches to a part of them; rows that repeat an id meet others, not each other."""
    rows = [(i % 500, i % 3, i % 5) for i in range(900)] + [(900, 1, None), (901, None, 2), (902, -1, 2), (903, -1, 2)]
    obs = spark.createDataFrame(rows, "id long, seg long, label long")
    made = pairs.split_pairs(obs)
    want = sorted((a, b, int(p == q)) for a, s, p in rows for b, t, q in rows if s and s > 0 and s == t and p and q and a < b)
    assert sorted(map(tuple, made.collect())) == want and "cap" not in inspect.signature(pairs.split_pairs).parameters


def test_tasks_follow_the_pairs(spark):
    rows = spark.range(3000).select("id", F.lit(1).alias("g"))
    assert shared.tasks_of(spark, None) == 4 and shared.tasks_of(spark, 1e9) == 50
    held = shared.in_blocks(rows, "g", F.col("id"), "id", 1000).select(shared.chunks("members").alias("m"))
    assert held.agg(F.max(F.size("m")), F.sum(F.size("m"))).first()[:] == (8, 3000)  # what two nested explodes make of a row is held at once


def test_links_are_read_once_and_meet_in_short_arrays(spark):
    rows = [(i % 40 + 1, i * i % 7) for i in range(300)] + [(0, 3), (None, 2), (5, None)]
    made = versions.edit_pairs(spark.createDataFrame(rows, "seg long, label long"))
    assert "posexplode" not in plan(made) and "ExistingRDD" not in plan(made)
    links = {(s, p) for s, p in rows if s and p}
    want = [("false_split", p, a, b) for a, p in links for b, q in links if p == q and a < b] + [("false_merge", s, a, b) for s, a in links for t, b in links if s == t and a < b]
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_more_pairs_than_an_array_holds(spark):
    assert shared.counted(spark.range(2), F.col("id") * 200_000, "k").agg(F.count("*"), F.max("k"), F.countDistinct("k")).first()[:] == (200_000, 199_999, 200_000)
    obs = spark.range(40).select("id", (F.col("id") % 2).alias("frag"))
    frags = spark.createDataFrame([(0, 1)], "fa long, fb long")
    assert spatial.adjacent_obs_pairs(frags, obs, 10**9).distinct().count() == 400


def test_nearest_points_of_groups(spark):
    """Widths start far below r in the crowd; groups that lie apart are found further out."""
    p, x = crowded(spark, 200, groups=6)
    p = p.withColumn("g", F.when(F.col("id") >= 160, F.col("seg") + 10).otherwise(F.col("seg"))).withColumn("t", F.col("seg") % 2)
    side = p.select("id", "g", "t", "x", "y", "z")
    got = {(r["ga"], r["gb"]): (r["d"], r["a"], r["b"]) for r in spatial.nearest_of_groups(side, side, 700.0, (F.col("ga") < F.col("gb")) & (F.col("ta") != F.col("tb"))).collect()}
    g = [i % 6 + (10 if i >= 160 else 0) for i in range(200)]
    want = {}
    for i in range(200):
        for j in range(200):
            d = float(np.linalg.norm(x[i] - x[j]))
            if g[i] < g[j] and i % 2 != j % 2 and d <= 700:
                want[g[i], g[j]] = min(want.get((g[i], g[j]), (9e9, 0, 0)), (d, i, j))
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-6 for k in want)


def test_somata_near_by_brute_force(spark):
    p, x = crowded(spark, 200)
    s = spark.createDataFrame([(i, float(i * 7), float(i * 5), float(i * 3)) for i in range(120)], "id long, x double, y double, z double")
    d = np.linalg.norm(x[:, None] - np.array([(i * 7, i * 5, i * 3) for i in range(120)], float)[None], axis=2)
    for r in (40.0, 300.0):
        got = {row["seg"]: row["somata"] for row in spatial.somata_near(p, s, r).collect()}
        assert got == {k: int((d[np.arange(200) % 4 == k] <= r).any(0).sum()) for k in range(4)}


def test_somata_are_not_met_by_every_point(spark):
    """Where all lies in one cell, a fragment is one row of it."""
    p = spark.range(3000).select("id", F.col("id") % 3, *[F.rand(k) for k in range(3)]).toDF("id", "seg", "x", "y", "z")
    s = spark.range(2000).select("id", *[F.rand(k + 5) for k in range(3)]).toDF("id", "x", "y", "z")
    assert {tuple(r) for r in spatial.somata_near(p, s, 100.0).collect()} == {(k, 2000) for k in range(3)}


def test_sql_hash_order_is_sparks(spark):
    """The SQL of f6_capped takes the same rows where its cap acts."""
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.sql(f"with v_obs as (select range * 12345678901 - 5 as syn_id from range(300)) select k, h from {further._hash_order('syn_id')}").fetchall()
    assert {tuple(map(int, r)) for r in found} == {tuple(r) for r in spark.range(300).select((F.col("id") * 12345678901 - 5).alias("k")).select("k", F.xxhash64("k", F.lit(0))).collect()}


def test_sql_windows_of_a_long_chain():
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql("create or replace table customer as select range * 25 as c_custkey from range(9000)")  # all of one segment
    sql = further.ORACLE_SQL["v6_windows"]
    assert duckdb.sql(f"select max(start), count(*) from ({sql})").fetchall() == [(8992, 8 * 2249)]


def test_scores_of_ids_in_several_groups(spark):
    rows = [(i, i % 3, float(i % 3) * 10) for i in range(30)] + [(4, 2, 20.0), (7, 0, 0.0), (7, 0, 0.0)]
    obs = spark.createDataFrame(rows, "id long, seg long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)}).where("seg <> 0").unionByName(
        spark.createDataFrame([(r[0], 5, 0.0) for r in rows if r[1] == 0], "id long, seg long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    )
    kept = [(r["id"], r["seg"], r["x"]) for r in obs.collect()]
    mean = {g: np.mean([x for _, s, x in kept if s == g]) for g in {s for _, s, _ in kept}}
    want = {}
    for i, a, _ in kept:
        for j, b, _ in kept:
            if a < b and abs(mean[a] - mean[b]) <= 12:
                k = (min(i, j), max(i, j))
                want[k] = max(want.get(k, -9.0), 1 - abs(mean[a] - mean[b]) / 12)
    made = [tuple(r) for r in spatial.group_scores(obs, 12.0, 1 - F.col("d") / 12.0).collect()]
    assert len(made) == len(want) and all(abs(want[a, b] - s) < 1e-9 for a, b, s in made)


def test_pairs_are_not_aggregated(spark):
    """Pairs of ids that are one row each leave the task that makes them as they are."""
    obs = spark.createDataFrame([(i, i % 2, 1.0, 0.0, 0.0) for i in range(20)], "id long, seg long, x double, y double, z double")
    links = obs.select(F.col("seg") + 1, F.col("id") + 1).toDF("seg", "label")
    assert "collect_list" in plan(versions.edit_pairs(links))  # blocks travel, not the rows of a key to one task
    assert versions.edit_pairs(links).where("kind = 'false_merge'").count() == 2 * 45


def test_members_of_asked_keys_meet(spark):
    """Blocks of two keys meet as short arrays beside long ones, each two once, in as many tasks as the pairs ask for."""
    rows = spark.createDataFrame([(i, i % 3) for i in range(210)], "id long, g long")
    held = shared.in_blocks(rows, "g", F.col("id"), "id", 20)
    asked = spark.createDataFrame([(0, 1), (1, 1), (2, 9)], "ga long, gb long")
    met = shared.members_met(asked, held, held, "ga", "gb", "g")
    assert met.agg(F.max(F.size("_l")), F.max(F.size("_r")) < 45).first()[:] == (8, True)
    got = met.select("ga", "gb", F.explode("_l").alias("a"), "_r").select("ga", "gb", "a", F.explode("_r").alias("b")).collect()
    assert sorted(map(tuple, got)) == sorted((f, g, a, b) for f, g in ((0, 1), (1, 1)) for a in range(f, 210, 3) for b in range(g, 210, 3))


def test_adjacent_pairs_without_a_cap(spark):
    obs = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(5, 2)], "id long, frag long")
    made = spatial.adjacent_obs_pairs(spark.createDataFrame([(0, 2), (1, 7)], "fa long, fb long"), obs)
    assert sorted(map(tuple, made.collect())) == sorted((a, b) for a in range(0, 90, 3) for b in [*range(2, 90, 3), 5])


def test_scores_are_rounded_before_members_meet(spark, tmp_path):
    spark.range(300).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    made = further.QUERIES["j12_group_scores"](spark, str(tmp_path))
    assert "round(" not in plan(made) and made.count() > 0


@pytest.mark.parametrize("r", [8.0, 25.0, 120.0])
def test_parts_by_brute_force(spark, r):
    p, x = crowded(spark, 150, groups=3)
    part = {i: i for i in range(150)}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for _ in range(150):
        part = {i: min(part[j] for j in range(i % 3, 150, 3) if d[i, j] <= r) for i in range(150)}
    assert {row["id"]: row["part"] for row in skeleton._reached(p, r).collect()} == part


def test_shared_partners_of_a_crowd_meet_in_blocks(spark):
    """Hundreds of groups around the same few partners: pairs are counted where blocks meet, not once for each partner and then summed."""
    rng = np.random.default_rng(4)
    has = rng.random((230, 12)) < 0.7
    rows = [(int(g) + 1, int(p) + 1) for g, p in zip(*np.nonzero(has))] * 2 + [(0, 1), (7, 0)]
    made = spatial.shared_partners(spark.createDataFrame(rows, "seg long, partner long"), block=50)
    assert "FlatMapGroupsInArrow" in plan(made) and "Join" not in plan(made)
    n = has.astype(int) @ has.T.astype(int)
    want = {(i + 1, j + 1): n[i, j] for i in range(230) for j in range(i + 1, 230) if n[i, j]}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(want) and {(a, b): k for a, b, k in got} == want


def test_blocks_of_groups_grow_with_their_number(spark):
    """A group is sent to few blocks, however many groups there are; more partners than are counted at a time, too."""
    assert [spatial._block_count(n, 1000) for n in (230, 9000, 90_000, 540_000)] == [1, 8, 12, 68]
    rng = np.random.default_rng(6)
    has = rng.random((60, 2500)) < 0.3
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(has))], "g long, p long")
    n = has.astype(int) @ has.T.astype(int)
    assert {tuple(r) for r in spatial._shared_in_blocks(links, 60, 9).collect()} == {(i, j, int(n[i, j])) for i in range(60) for j in range(i + 1, 60) if n[i, j]}


@pytest.mark.parametrize("r, least", [(60.0, 3), (25.0, 4), (60.0, 1)])
def test_density_clusters_by_cells(spark, monkeypatch, r, least):
    """Crowded points are not measured against each other; clusters are those of all distances."""
    rng = np.random.default_rng(int(r) + least)
    x = np.concatenate([rng.uniform(0, 90, (120, 3)), rng.uniform(100, 190, (60, 3)), rng.uniform(200, 700, (60, 3))]).round(2)
    seg = np.arange(len(x)) % 2
    p = spark.createDataFrame([(i, *map(float, x[i]), int(seg[i])) for i in range(len(x))], "id long, x double, y double, z double, group long")
    measured, pairs_of = [], models.radius_pairs
    monkeypatch.setattr(models, "radius_pairs", lambda left, *a, **k: measured.append(left.count()) or pairs_of(left, *a, **k))
    got = {tuple(q) for q in models.radius_clusters(p, r, "group", least).collect()}
    near = (np.linalg.norm(x[:, None] - x[None], axis=2) <= r) & (seg[:, None] == seg[None])
    core, blob = near.sum(1) >= least, np.arange(len(x))
    for _ in range(len(x)):
        blob = np.where(core, np.where(near & core, blob, len(x)).min(1), blob)
    edge = {(i, int(min(blob[near[i] & core]))) for i in np.flatnonzero(~core) if (near[i] & core).any()}
    assert got == {(int(i), int(blob[i])) for i in np.flatnonzero(core)} | edge and len({b for _, b in got}) > 2
    assert r < 60 or max(measured) < 0.9 * len(x)


def test_boxes_meet_points_in_many_tasks(spark):
    """A crowded cell's points are many keys, and tasks follow the pairs to look at; faces count, and columns stay."""
    p, x = crowded(spark)
    b = p.where("id % 10 = 0").selectExpr("id as box_id", *[f"{c} - 30 as lo_{c}" for c in "xyz"], *[f"{c} + 40 as hi_{c}" for c in "xyz"])
    found = spatial.points_in_boxes(b, p, 500.0, 8, 100)
    assert found.columns == ["box_id", *[f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"], "id", "x", "y", "z", "seg"] and found.rdd.getNumPartitions() > 20
    got = sorted((r["box_id"], r["id"], r["seg"]) for r in found.collect())
    assert got == sorted((i, j, j % 4) for i in range(0, 300, 10) for j in range(300) if (x[j] >= x[i] - 30).all() and (x[j] <= x[i] + 40).all())
