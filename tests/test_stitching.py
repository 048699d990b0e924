"""Stitching and candidate caps against deciding one pair after another."""

import random
from collections import Counter

import pytest

from pointweave.operators import stitch


def one_by_one(supers, forced, cands, min_score, max_obs):
    """The decisions of a plain loop, and the clusters."""
    parent = {s: s for s, *_ in supers}
    n, soma = {s: k for s, k, _ in supers}, {s: b for s, _, b in supers}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    used, out = set(), []
    rows = [(float("-inf"), i, j, 0, 0, True) for i, j in forced] + [(-score, i, j, a, b, False) for i, j, a, b, score in cands]
    for o, i, j, a, b, must in sorted(rows):
        x, y = find(i), find(j)
        if must:
            why = "already_joined" if x == y else "joined"
        elif -o < min_score:
            why = "below_min_score"
        elif x == y:
            why = "cycle"
        elif {(i, a), (j, b)} & used:
            why = "endpoint_used"
        elif soma[x] and soma[y]:
            why = "soma_cannot_link"
        elif max_obs is not None and n[x] + n[y] > max_obs:
            why = "obs_cap"
        else:
            why = "joined"
            used |= {(i, a), (j, b)}
        out.append((i, j, must, why, why == "joined" and soma[x] and soma[y]))
        if why == "joined":
            keep, gone = min(x, y), max(x, y)
            parent[gone], n[keep], soma[keep] = keep, n[x] + n[y], soma[x] or soma[y]
    return out, {s: find(s) for s in parent}


def frames(spark, supers, forced, cands):
    return (
        spark.createDataFrame(supers, "super_id long, n_obs long, has_soma boolean"),
        spark.createDataFrame(forced, "i long, j long"),
        spark.createDataFrame(cands, "i long, j long, end_i long, end_j long, score double"),
    )


def graph(seed, n, m, ends=4, grain=50):
    rng = random.Random(seed)
    supers = [(s, rng.randrange(1, 20), rng.random() < 0.15) for s in range(n)]
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    cands = [(i, j, rng.randrange(ends), rng.randrange(ends), rng.randrange(grain) / grain) for i, j in pairs]
    forced = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(n // 10)]
    return supers, sorted(set(forced)), cands


@pytest.mark.parametrize("seed, limit, max_obs", [(1, 100_000, None), (2, 40, 60)])
def test_equal_to_one_after_another(spark, seed, limit, max_obs):
    supers, forced, cands = graph(seed, 80, 160)
    parts, decisions = stitch.stitch(*frames(spark, supers, forced, cands), 0.1, max_obs, group_limit=limit)
    want, clusters = one_by_one(supers, forced, cands, 0.1, max_obs)
    assert {tuple(r) for r in parts.collect()} == set(clusters.items())
    assert Counter(tuple(r) for r in decisions.collect()) == Counter(want)
    assert {"joined", "cycle", "endpoint_used", "soma_cannot_link", "below_min_score"} <= {w[3] for w in want}
    counts = {r.decision: r.n for r in stitch.reject_counts(decisions).collect()}
    assert counts["cycle"] == sum(w[3] == "cycle" for w in want) and counts["joined"] == sum(w[3] == "joined" for w in want)


def test_group_of_200_000_pairs(spark):
    """One connected group of twice the rows that a task decides."""
    supers, forced, cands = graph(9, 60_000, 200_000, ends=8, grain=10_000)
    parts, decisions = stitch.stitch(*frames(spark, supers, forced, cands), 0.05, 400)
    want, clusters = one_by_one(supers, forced, cands, 0.05, 400)
    assert {tuple(r) for r in parts.collect()} == set(clusters.items())
    assert Counter(tuple(r) for r in decisions.collect()) == Counter(want)


def test_candidates_of_a_crowded_super(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(400)} | {(0, k) for k in range(1, 60)}
    rows = [(i, j, rng.randrange(10) / 10) for i, j in pairs]
    got = stitch.capped_candidates(spark.createDataFrame(rows, "i long, j long, score double"), 3)
    degree, want = Counter(), []
    for i, j, score in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if degree[i] < 3 and degree[j] < 3:
            degree.update((i, j))
            want.append((i, j, score))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_nothing_to_stitch(spark):
    supers = [(1, 5, True), (2, 5, None)]
    parts, decisions = stitch.stitch(*frames(spark, supers, [], []))
    assert {tuple(r) for r in parts.collect()} == {(1, 1), (2, 2)} and decisions.count() == 0
