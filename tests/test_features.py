"""Features and fits against plain versions, and the stitch end to end."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import metrics, models, skeleton, stitch


def test_seam_descriptor(spark):
    rng = random.Random(1)
    n, hops = 14, 2
    v = [(1, i, rng.uniform(0, 9000), rng.uniform(0, 9000), rng.uniform(0, 9000), rng.uniform(10, 300)) for i in range(n)]
    e = [(1, (i - 1) // 2 if i < 9 else i - 1, i) for i in range(1, n)]
    obs = [(1, rng.randrange(n), rng.randrange(2)) for _ in range(30)]
    near = {i: sorted([b for _, a, b in e if a == i] + [a for _, a, b in e if b == i]) for i in range(n)}
    xyz, r = np.array([x[2:5] for x in v]), [x[5] for x in v]

    def ball(i):
        held = {i}
        for _ in range(hops):
            held |= {j for k in held for j in near[k]}
        return held

    def share(i):
        pre, post = (sum(o[1] in ball(i) and o[2] == s for o in obs) for s in (0, 1))
        return (pre + 0.5) / (pre + post + 1), pre + post

    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = {x["vid"]: x for x in models.seam_descriptor(t(v, "frag_id long, vid long, x double, y double, z double, r double"), t(e, "frag_id long, u long, v long"), t(obs, "frag_id long, vid long, side int"), hops).collect()}
    for i in range(n):
        a, b = near[i][0], near[i][1] if len(near[i]) > 1 else None
        kink = 0.5
        if len(near[i]) == 2:
            p, q = xyz[a] - xyz[i], xyz[b] - xyz[i]
            kink = 1 + p @ q / (np.linalg.norm(p) * np.linalg.norm(q) + 1e-9)
        pts = xyz[list(ball(i))]
        want = {
            "log_r": math.log1p(r[i]), "calibre_jump": max(abs(math.log1p(r[i]) - math.log1p(r[j])) for j in near[i]), "cross_ratio": (min(r[j] for j in near[i]) + 1) / (max(r[j] for j in near[i]) + 1),
            "kink": kink, "degree": min(5, len(near[i])), "density": math.log1p(share(i)[1]), "pre_fraction": share(i)[0],
            "polarity_contrast": abs(share(a)[0] - share(b)[0]) if b is not None else 0.0,
            "tortuosity": math.log1p(len(ball(i))) / math.log1p((np.linalg.norm(pts.max(0) - pts.min(0)) + 1) / 1000 + 1),
        }
        for name, value in want.items():
            assert abs(got[i][name] - value) < 1e-6, (i, name)


def test_temperature(spark):
    rng = random.Random(2)
    rows = [(z, int(rng.random() < 1 / (1 + math.exp(-z / 2)))) for z in (rng.gauss(0, 3) for _ in range(2000))]
    scored = spark.createDataFrame(rows, "logit double, y int")
    t, nll = metrics.fit_temperature(scored, held=F.lit(True))
    cost = lambda t: sum(math.log1p(math.exp(-z / t if y else z / t)) for z, y in rows) / len(rows)
    assert abs(nll - cost(t)) < 1e-9 and all(nll <= cost(t * k) + 1e-9 for k in (0.9, 0.97, 1.03, 1.1))
    part, _ = metrics.fit_temperature(scored)  # a fifth of them
    assert 0 < abs(part - t) < 0.5
    shifted, _ = metrics.fit_temperature(spark.createDataFrame([(z + 2, y) for z, y in rows], "logit double, y int"), held=F.lit(True), bias=-2.0)
    assert abs(shifted - t) < 1e-6
    assert metrics.fit_temperature(spark.createDataFrame([(5.0, 1), (-5.0, 0)], "logit double, y int"), held=F.lit(True))[0] < 0.051  # all right: as sharp as may be


@pytest.mark.parametrize("seed", [1, 2])
def test_two_means_of_all_groups_at_once(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g, n in enumerate([1, 5, 6, 40, 300, 300]):
        far = rng.choice([0, 5000])
        rows += [(1000 * g + i, g, rng.gauss(0, 100) + far * (i % 3 == 0), rng.gauss(0, 50), rng.gauss(0, 10)) for i in range(n)]
    rows += [(9000 + i, 9, 1.0, 2.0, 3.0) for i in range(8)]  # all in one place
    got = {r["group"]: r for r in models.two_means(spark.createDataFrame(rows, "id long, group long, x double, y double, z double"), "group").collect()}
    assert set(got) == {r[1] for r in rows}
    for g in got:
        x = np.array([r[2:] for r in sorted(rows) if r[1] == g])
        want = [0.0, 0.0, 0.0]
        if len(x) >= 6:
            c = x[[0, int(np.linalg.norm(x - x[0], axis=1).argmax())]]
            for _ in range(100):
                side = np.linalg.norm(x[:, None] - c[None], axis=2).argmin(1)
                new = np.stack([x[side == k].mean(0) if (side == k).any() else c[k] for k in (0, 1)])
                if np.allclose(new, c, atol=1e-9):
                    break
                c = new
            total, n = ((x - x.mean(0)) ** 2).sum(), np.bincount(side, minlength=2)
            within = sum(((x[side == k] - c[k]) ** 2).sum() for k in (0, 1))
            want = [1 - within / total if total > 1e-9 else 0.0, np.linalg.norm(c[0] - c[1]) / (np.linalg.norm(x.max(0) - x.min(0)) + 1), n.min() / n.max()]
        assert np.allclose([got[g][c] for c in ("bimodality", "centre_gap", "balance")], want, atol=1e-5), g


def test_two_tiles_are_stitched(spark):
    """Two strands run through both tiles; one shares an observation in the halo, the other meets end to end."""
    rows = []
    for tile in (0, 1):
        for k in range(6):
            x = 600.0 * tile + 100.0 * k
            rows += [(1000 * tile + k, 5000 if (tile, k) in ((0, 5), (1, 0)) else 1000 * tile + k, tile, True, 1, 7, x, 0.0), (1000 * tile + 500 + k, 1000 * tile + 500 + k, tile, True, 2, 8, x, 4000.0)]
    parts = spark.createDataFrame([(i, key, t, core, c, i, label, False, [1.0, 0.0], x, y, 0.0) for i, key, t, core, c, label, x, y in rows], "id long, key long, tile_id long, core boolean, cluster long, atom long, label long, has_soma boolean, dna array<double>, x double, y double, z double")
    labels, decisions = stitch.two_level_stitch(parts, 150.0)
    by = {r["id"]: r["cluster"] for r in labels.collect()}
    strands = [{by[i] for i, *_ in rows if (i % 1000 >= 500) == upper} for upper in (False, True)]
    assert all(len(s) == 1 for s in strands) and strands[0] != strands[1] and len(by) == len(rows)
    assert sorted((r["forced"], r["decision"], r["soma_conflict"]) for r in decisions.collect()) == [(False, "joined", False), (True, "joined", False)]


def test_cloud_ends_of_ties(spark):
    """Of several points at one end of the widest axis the lowest id is it, at either end."""
    rows = [(i, i % 2, float(i // 2 % 5) * 10, 1.0, 2.0) for i in range(60)] + [(99, 0, None, 1.0, 2.0)]
    ends = skeleton.cloud_ends(spark.createDataFrame(rows, "id long, seg long, x double, y double, z double").repartition(5, "id"))
    assert {tuple(r)[:3] for r in ends.collect()} == {(0, 0, 8), (1, 1, 9)}
