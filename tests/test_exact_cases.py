"""Small inputs with known answers."""

import math

from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import graph, metrics, risk, sides, skeleton, stitch, versions


def pair_table(spark, pre, post):
    return spark.createDataFrame(list(zip(range(len(pre)), pre, post)), "id long, pre_root long, post_root long")


def test_line_graph_pairs(spark):
    t = pair_table(spark, [1, 1, 2, 2], [10, 11, 12, 13])
    assert {tuple(r) for r in metrics.line_graph_pairs(t, "id", "pre_root", "post_root").collect()} == {(0, 1), (2, 3)}
    t = pair_table(spark, [1, 2], [10, 10])
    assert {tuple(r) for r in metrics.line_graph_pairs(t, "id", "pre_root", "post_root").collect()} == {(0, 1)}


def test_clutter_filter(spark):
    kept = lambda pre, post: sides.clutter_filter(pair_table(spark, pre, post), 5).collect()
    assert [r["pre_root"] for r in kept([1] * 5 + [99], [10] * 6)] == [1] * 5
    assert kept([1] * 5, [99, 10, 10, 10, 10]) == []
    assert len(kept([7, 7, 7, 8, 8], [8, 8, 8, 7, 7])) == 5
    assert sides.clutter_filter(pair_table(spark, [1], [2]), 1).count() == 1


def test_root_remap(spark):
    m = spark.createDataFrame([(1, 101), (2, 0), (3, 103), (10, 201), (11, 0), (12, 202)], "root_base long, root_target long")
    out = versions.remap(pair_table(spark, [1, 1, 2, 3, 3], [10, 10, 10, 11, 12]), m)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 4]


def scores(spark, pred, true, **how):
    return metrics.pairwise(spark.createDataFrame(list(zip(pred, true)), "pred long, true long"), **how).first()


def test_pairwise(spark):
    r = scores(spark, [0, 0, 1, 1], [5, 5, 5, 6])
    assert (r["precision"], r["recall"]) == (0.5, 1 / 3)
    big = 864691135000000001
    r = scores(spark, [0, 0, 1, 1], [big, big, big + 1, big + 1])
    assert (r["precision"], r["recall"]) == (1, 1)
    r = scores(spark, [0, 0, -1], [5, 5, 5])
    assert (r["n_obs"], r["precision"]) == (2, 1)
    assert math.isnan(scores(spark, [0], [0])["precision"])


def test_stitch_edge_precision(spark):
    supers = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "super_id long, majority_label long")
    edges = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    assert stitch.edge_precision(edges, supers).first()["precision"] == 0.5


def test_shared_key_links(spark):
    def links(groups, least):
        supers = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(groups)], "super_id long, tile_id long")
        keys = spark.createDataFrame([(k, x) for k, (_, ks) in enumerate(groups) for x in ks], "super_id long, key long")
        return [(r["i"], r["j"]) for r in stitch.shared_key_links(supers, keys, least).collect()]

    assert links([(0, [1, 2, 3, 4]), (1, [1, 2, 3, 9]), (1, [4, 20, 21])], 3) == [(0, 1)]
    assert links([(0, [1, 2, 3]), (0, [1, 2, 3])], 1) == []


def test_constrained_stitch_reasons(spark):
    def run(supers, cands, forced=(), **how):
        s = spark.createDataFrame(supers, "super_id long, n_obs long, has_soma boolean")
        c = spark.createDataFrame(cands, "i long, j long, end_i long, end_j long, score double")
        f = spark.createDataFrame(list(forced), "i long, j long")
        parts, decisions = stitch.stitch(s, f, c, **how)
        return {(r["i"], r["j"]): r["decision"] for r in decisions.collect()}, {r["super_id"]: r["cluster"] for r in parts.collect()}

    three = [(0, 5, False), (1, 5, False), (2, 5, False)]
    got, parts = run(three, [(0, 1, 1, 2, 0.9), (1, 2, 3, 4, 0.8), (0, 2, 5, 6, 0.7)])
    assert got[(0, 2)] == "cycle" and set(parts.values()) == {0}
    got, _ = run(three, [(0, 1, 1, 2, 0.9), (0, 2, 1, 6, 0.7)])
    assert got[(0, 2)] == "endpoint_used"
    got, _ = run([(0, 5, True), (1, 5, True)], [(0, 1, 1, 2, 0.9)])
    assert got[(0, 1)] == "soma_cannot_link"
    got, _ = run(three, [(0, 1, 1, 2, 0.9)], max_obs=9)
    assert got[(0, 1)] == "obs_cap"
    got, parts = run(three, [(0, 1, 1, 2, 0.3)], min_score=0.5, forced=[(1, 2)])
    assert got[(0, 1)] == "below_min_score" and got[(1, 2)] == "joined" and parts == {0: 0, 1: 1, 2: 1}


def chain(spark, xs):
    v = spark.createDataFrame([(1, i, float(x), 0.0, 0.0, 100.0) for i, x in enumerate(xs)], "frag_id long, vid long, x double, y double, z double, r double")
    e = spark.createDataFrame([(1, i, i + 1) for i in range(len(xs) - 1)], "frag_id long, u long, v long")
    return v, e


def test_odd_edges(spark):
    v, e = chain(spark, [0, 1000, 2000, 52000, 53000, 54000])
    assert [r["u"] for r in skeleton.odd_edges(skeleton.edge_lengths(v, e)).where("odd").collect()] == [2]
    v, e = chain(spark, [0, 1000, 2000, 5000])
    assert skeleton.odd_edges(skeleton.edge_lengths(v, e), factor=2).where("odd").count() == 0
    assert skeleton.oddness(v, e).first()["odd"] is False


def test_skeleton_y(spark):
    places = {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (3, -1)}
    v = spark.createDataFrame([(9, i, 1000.0 * x, 1000.0 * y, 0.0, 50.0) for i, (x, y) in places.items()], "frag_id long, vid long, x double, y double, z double, r double")
    e = spark.createDataFrame([(9, 0, 1), (9, 1, 2), (9, 2, 3), (9, 2, 4)], "frag_id long, u long, v long")
    assert {r["vid"]: r["degree"] for r in skeleton.degrees(v, e).collect()} == {0: 1, 1: 2, 2: 3, 3: 1, 4: 1}
    assert sorted(r["vid"] for r in skeleton.endpoints(v, e).collect()) == [0, 3, 4]
    atoms = skeleton.atoms(v, e).collect()
    assert len({r["atom"] for r in atoms}) == 3 and sum(r["vid"] == 2 for r in atoms) == 3
    shape = skeleton.shape(v, e).first()
    assert (shape["branches"], shape["tips"], shape["components"], shape["is_tree"]) == (1, 3, 1, True)
    assert abs(skeleton.diameter(v, e).first()["length"] - (2000 + 1000 * 2**0.5)) < 1e-6
    labels = spark.createDataFrame([(9, 0, 1, 3), (9, 3, 2, 3), (9, 4, 1, 2)], "frag_id long, vid long, label long, n long")
    cut = skeleton.best_cuts(v, e, labels).collect()
    assert [(r["u"], r["v"], r["after"]) for r in cut] == [(2, 3, 0.0)]


def test_franken_separation(spark):
    def sep(parent, true, pred):
        rows = spark.createDataFrame(list(zip(parent, true, pred)), "parent long, label long, cluster long")
        return metrics.franken_separation(rows).first()["separation"]

    parents, true = [7] * 4 + [8] * 2, [100, 100, 200, 200, 300, 300]
    assert sep(parents, true, [0, 0, 1, 1, 2, 2]) == 1
    assert sep(parents, true, [0, 0, 0, 1, 2, 2]) == 0
    assert sep([7, 7, 7], [100, 200, 200], [0, -1, 1]) == 1


def test_overlap_weights_and_bins(spark):
    rows = spark.createDataFrame([("k1", 1), ("k2", 1), ("k2", 2)], "key string, tube int")
    assert {(r["key"], r["weight"]) for r in sides.overlap_weights(rows).collect()} == {("k1", 1.0), ("k2", 0.5)}
    p = spark.createDataFrame([(25000.0, 50000.0), (75000.0, 50000.0)], "x double, y double")
    assert len({r["bin"] for r in sides.xy_bins(p, 50_000, 100_000).collect()}) == 2


def gaec(spark, n, edges):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    w = spark.createDataFrame(edges, "src long, dst long, w double")
    out = {}
    for limit in (20_000, 1):  # solved whole, and by blocks
        found = {r["node"]: r["cluster"] for r in graph.correlation_clusters(nodes, w, group_limit=limit).collect()}
        out[limit] = sorted(sorted(k for k, v in found.items() if v == c) for c in set(found.values()))
    return out


def test_contraction(spark):
    cliques = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, -2.0)]
    assert gaec(spark, 6, cliques) == {20_000: [[0, 1, 2], [3, 4, 5]], 1: [[0, 1, 2], [3, 4, 5]]}
    assert gaec(spark, 3, [(0, 1, -1.0), (1, 2, -1.0)])[20_000] == [[0], [1], [2]]
    assert gaec(spark, 3, [(0, 1, 1.0), (1, 2, 1.0)])[20_000] == [[0, 1, 2]]
    assert gaec(spark, 2, [(0, 1, 1.0), (1, 0, -3.0)])[20_000] == [[0], [1]]


def test_greedy_equals_the_sequential_run(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(90)]
    nodes = spark.range(40).withColumnRenamed("id", "node")
    e = spark.createDataFrame(edges, "src long, dst long, p double")
    order = [r["node"] for r in nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").collect()]
    near = {}
    for a, b, p in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = max(p, near.get(x, {}).get(y, 0))
    label = {}
    for n in order:
        votes = {}
        for m, p in near.get(n, {}).items():
            if m in label and p >= 0.5:
                votes.setdefault(label[m], []).append(p)
        label[n] = min(votes, key=lambda c: (-sum(votes[c]) / len(votes[c]), c)) if votes else n
    assert {r["node"]: r["cluster"] for r in graph.greedy_clusters(nodes, e, 0.5, seed=3).collect()} == label


def test_abstained_ids_are_unique_negatives(spark):
    conf = spark.createDataFrame([(0, 5, -0.5), (1, 5, -0.2), (2, 5, 0.9)], "obs long, cluster long, confidence double")
    got = {r["obs"]: r["cluster"] for r in risk.abstained(conf, 0.0).collect()}
    assert got[2] == 5 and got[0] < 0 and got[1] < 0 and got[0] != got[1]


def test_stable_key_wraps(spark):
    for x, y, z in ((1.0, 2.0, 3.0), (-8.0, 24.0, 40.0), (9e12, -7e11, 5.0), (3.3e15, 1.0, -1e14)):
        q = [round(v / 16) for v in (x, y, z)]
        want = ((q[0] * 1000003 + q[1]) * 1000003 + q[2] + 2**63) % 2**64 - 2**63
        got = spark.createDataFrame([(x, y, z)], "x double, y double, z double").select(C.stable_key("x", "y", "z").alias("k")).first()["k"]
        assert got == want


def test_spanning_forest_and_bridges(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 1.0), (2, 3, 9.0), (5, 6, 1.0)], "src long, dst long, w double")
    assert {(r["src"], r["dst"]) for r in graph.spanning_forest(e).collect()} == {(0, 1), (1, 2), (3, 4), (2, 3), (5, 6)}
    cost = e.withColumnRenamed("w", "cost")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    got = {r["node"]: (r["cost"], r["source"]) for r in graph.cheapest_bridge(cost, ids(0, 4), ids(2, 3, 5), 11.0).collect()}
    assert got == {2: (3.0, 0), 3: (1.0, 4)}


def test_components_keep_isolated_nodes_and_long_chains(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 250)] + [(260, 270), (280, 280)], "src long, dst long")
    got = {r["node"]: r["cluster"] for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(251)) and got[270] == 260 and got[280] == 280 and got[299] == 299


def test_unfinished_clusterings_are_errors(spark):
    import pytest

    nodes = spark.range(6).withColumnRenamed("id", "node")
    star = spark.createDataFrame([(0, k, float(k)) for k in range(1, 6)], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        graph.greedy_clusters(nodes, star.withColumnRenamed("w", "p"), max_rounds=1)
