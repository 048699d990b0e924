import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import models, pairs, sequence, spatial
from pointweave.sources import boxes, synapses
from pointweave.sources.scratch import Scratch
from pointweave.streaming import jobs


def cloud(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1000, (n, 3)).round(3)
    x[:5] += 20_000  # far from the others
    rows = [(i, *map(float, x[i]), i % 7 + 1, i % 11) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, seg long, label long"), x


def test_knn_is_exact_even_far_away(spark):
    p, x = cloud(spark)
    got = {}
    for r in spatial.knn(p, p, 6, 40.0).collect():
        got.setdefault(r["a"], {})[r["rank"]] = r["b"]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][k] for k in range(1, 7)] == np.lexsort((np.arange(len(x)), d[i]))[:6].tolist()


def test_spatial_joins_use_equi_joins(spark):
    p, _ = cloud(spark, 50)
    plan = spatial.self_radius_pairs(p, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_pca_order_does_not_depend_on_the_sign(spark):
    p, x = cloud(spark, 60)
    out = sequence.pca_order(p.withColumn("group", F.lit(1))).orderBy("pos").collect()
    c = x[:60] - x[:60].mean(0)
    axis = np.linalg.svd(c, full_matrices=False)[2][0]
    axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
    assert [r["id"] for r in out] == np.argsort(c @ axis, kind="stable").tolist()
    toks = sequence.tokens(sequence.pca_order(p.withColumn("group", F.col("seg"))))
    feats = sequence.bigram_features(toks, p.withColumn("group", F.col("seg")))
    assert feats.count() == 7 and all(abs(sum(r[c] for c in feats.columns[1:17]) - 1) < 1e-9 for r in feats.collect())


def test_windows(spark):
    rows = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(11)], "group long, pos long, x double, y double, z double")
    got = {}
    for r in sequence.windows(rows, 4).collect():
        got.setdefault(r["start"], []).append((r["k"], r["x"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: [(k, float(s + k)) for k in range(4)] for s in (0, 2, 4, 6)}


def test_pair_mining_invariants(spark):
    p, _ = cloud(spark)
    m = pairs.merge_pairs(p, 3, 400.0).join(p.select(F.col("id").alias("a"), F.col("seg").alias("sa"), F.col("label").alias("la")), "a").join(p.select(F.col("id").alias("b"), F.col("seg").alias("sb"), F.col("label").alias("lb")), "b").collect()
    assert m and all(r["a"] < r["b"] and r["d"] <= 400 for r in m)
    assert all(r["la"] == r["lb"] and r["sa"] != r["sb"] for r in m if r["y"] == 1) and all(r["la"] != r["lb"] for r in m if r["y"] == 0)
    capped = spatial.same_segment_pairs(p, 5).groupBy("src").count().count()
    assert capped > 0
    n = spatial.same_segment_pairs(p.withColumn("seg", F.lit(1)), 10)
    assert n.count() == 20


def test_classifier_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i // 4), float(rng.normal(2 * (i % 2), 1)), float(rng.normal()), i % 2, "all") for i in range(400)]
    t = spark.createDataFrame(rows, "group long, f double, g double, y int, stratum string")
    auc = models.stratum_auc(models.cross_validated(t, ["f", "g"], folds=3)).first()["auc"]
    null = models.stratum_auc(models.cross_validated(t, ["f", "g"], folds=3, shuffled=True)).first()["auc"]
    assert auc > 0.85 and abs(null - 0.5) < 0.15


def test_shape_features(spark):
    p, _ = cloud(spark)
    dna = models.shape_embedding(p.withColumn("group", F.col("seg")).withColumn("r", F.lit(10.0)), dim=16).collect()
    assert all(len(r["dna"]) == 16 and abs(sum(v * v for v in r["dna"]) - 1) < 1e-9 for r in dna)


def test_box_dataset_round_trip(spark):
    p, _ = cloud(spark)
    syn = p.select(F.col("id").alias("syn_id"), "x", "y", "z", F.col("seg").alias("pre_root"), (F.col("label") + 100).alias("post_root"))
    grid = boxes.box_grid((0, 0, 0), (1000, 1000, 1000), 500.0, spark)
    held = boxes.members(grid, syn, 500.0)
    path = Scratch(spark, "boxes").path("set")
    boxes.write_boxes(held, grid, path)
    assert boxes.audit(spark, path, 1, 2).first()["incomplete"] == 0
    assert boxes.read_boxes(spark, path, min_synapses=1).count() == held.count() == 195
    assert boxes.todo(grid, spark, path).count() == 0 and boxes.incomplete(spark, path).count() == 0
    assert boxes.todo(grid, spark, path + "-none").count() == grid.count()


def test_column_resolver():
    found = synapses.resolve(["PT_Root_ID", "n"], {"root": ["root_id", "pt_root_id"]}, ("root",))
    assert found == {"root": "PT_Root_ID"}
    with pytest.raises(ValueError, match="root"):
        synapses.resolve(["a"], {"root": ["root_id"]}, ("root",))


def test_streams(spark):
    tmp = Scratch(spark, "streams")
    rows = [(i % 40, i % 5 + 1, i % 7 + 100, i) for i in range(120)]
    t = spark.createDataFrame(rows, "syn_id long, pre_root long, post_root long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = tmp.path("in")
    t.repartition(3).write.parquet(path)
    schema = "syn_id long, pre_root long, post_root long, ts timestamp"
    counts = {r["root"]: r["n_pre"] + r["n_post"] for r in jobs.drained(jobs.root_counts(jobs.as_stream(spark, path, schema)), "roots").collect()}
    assert counts[1] == 24 and counts[100] == 18
    once = jobs.drained(jobs.first_of_each(jobs.as_stream(spark, path, schema)), "once", "append")
    assert once.count() == once.select("syn_id").distinct().count() == 40
    seen = []
    for _ in range(2):
        q = jobs.ingest_boxes(jobs.as_stream(spark, path, schema, 10), lambda df: seen.append(df.count()), f"{path}-checkpoint")
        q.awaitTermination()
    assert sum(seen) == 120
    edits = tmp.path("edits")
    spark.createDataFrame([(i, "merge" if i % 3 else "split", i % 4, i * 600) for i in range(24)], "edit_id long, op string, seg long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(edits)
    stream = jobs.as_stream(spark, edits, "edit_id long, op string, seg long, ts timestamp")
    rates = jobs.drained(jobs.edit_rates(stream), "rates").collect()
    assert sum(r["n"] for r in rates) == 24 and len(rates) == 8
    labels = spark.createDataFrame([(0, 10), (1, 11)], "seg long, label long")
    assert jobs.drained(jobs.labelled_edits(stream, labels), "edits", "append").count() == 12
