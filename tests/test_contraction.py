"""Greedy additive contraction against a plain one."""

import random

import pytest

from pointweave.operators import graph


def plain(nodes, edges):
    """Join the best pair again and again; of equal sums that with the lowest edge."""
    cluster = {x: x for x in nodes}
    sums = {}
    for a, b, w in edges:
        if a != b:
            k = min(a, b), max(a, b)
            sums[k] = sums.get(k, 0) + round(w * 1e9)
    while True:
        total = {}
        for (a, b), w in sums.items():
            k = tuple(sorted((cluster[a], cluster[b])))
            if k[0] != k[1]:
                old = total.get(k, (0, (a, b)))
                total[k] = old[0] + w, min(old[1], (a, b))
        best = min(((-w, low, k) for k, (w, low) in total.items() if w > 0), default=None)
        if best is None:
            return cluster
        keep, gone = best[2]
        cluster = {x: keep if c == gone else c for x, c in cluster.items()}


def clusters(spark, n, edges, limit):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    w = spark.createDataFrame(edges, "src long, dst long, w double")
    return {r.node: r.cluster for r in graph.correlation_clusters(nodes, w, group_limit=limit).collect()}


@pytest.mark.parametrize("seed, limit", [(1, 10_000), (2, 130)])
def test_random_graphs(spark, seed, limit):
    rng = random.Random(seed)
    edges = []
    for _ in range(170):
        a, b = rng.randrange(90), rng.randrange(90)
        edges.append((a, b, rng.choice([rng.gauss(0.4 if a // 9 == b // 9 else -0.2, 1), rng.randrange(-2, 4) / 2])))
    edges += [(a, a + 1, 2.5) for a in range(0, 80, 2)] + [(5, 7, 1.0), (7, 5, 1.0)]
    assert clusters(spark, 95, edges, limit) == plain(range(95), edges)


def test_contract_itself():
    rng = random.Random(5)
    for _ in range(30):
        edges = {tuple(sorted(rng.sample(range(12), 2))): rng.randrange(-3, 5) for _ in range(30)}
        got = graph._contract([(a, b, w, a, b) for (a, b), w in edges.items()])
        want = plain(range(12), [(a, b, w / 1e9) for (a, b), w in edges.items()])
        assert all(want[x] == c for x, c in got.items())


def test_star_of_50_000_leaves(spark):
    n = 50_001
    edges = [(k, n - 1, (k % 7 + 1) / 2 if k % 10 else -1.0) for k in range(n - 1)]
    got = clusters(spark, n, edges, 1000)
    assert all(got[k] == (1 if k % 10 else k) for k in range(n - 1)) and got[n - 1] == 1


def test_hub_whose_leaves_have_an_edge_more(spark):
    """No node has one edge only: the blocks decide."""
    n = 400
    edges = [(0, k, 1 + k / 1000) for k in range(1, n)] + [(k, k + 1, -0.4) for k in range(1, n - 1)] + [(1, n, 0.1), (0, n, -0.3)]
    assert clusters(spark, n + 1, edges, 500) == plain(range(n + 1), edges)


def test_rising_chain(spark):
    edges = [(k, k + 1, 1 + k / 500) for k in range(300)] + [(k, k + 2, -1.0 - k / 1000) for k in range(0, 298, 3)]
    assert clusters(spark, 301, edges, 350) == plain(range(301), edges)
