"""Trees walked by Euler tours against walking each fragment in one task."""

import math
import random

import pytest

from pointweave.operators import skeleton, tours


def forest(spark, seed, sizes):
    """Random trees, among them chains, stars and fragments of several trees, with shuffled vertex ids."""
    rng = random.Random(seed)
    vertices, edges = [], []
    for frag, n in enumerate(sizes):
        ids = rng.sample(range(10 * n + 1), n)
        kind = frag % 4
        for i, vid in enumerate(ids):
            vertices.append((frag, vid, rng.random() * 1e4, rng.random() * 1e4, rng.random() * 1e3, 50.0))
            if i and not (kind == 3 and i % 7 == 0):
                up = {0: rng.randrange(i), 1: i - 1, 2: 0, 3: i - 1 - rng.randrange(max(1, i % 7))}[kind]
                edges.append((frag, *rng.sample([vid, ids[up]], 2)))
    v = spark.createDataFrame(vertices, "frag_id long, vid long, x double, y double, z double, r double")
    return v, spark.createDataFrame(edges, "frag_id long, u long, v long"), vertices


def rows(df):
    return sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def trees(spark):
    return forest(spark, 3, [1, 40, 30, 60, 50, 2, 3])


def test_order_pieces_and_diameter(spark, trees):
    v, e, _ = trees
    assert rows(skeleton.depth_order(v, e, limit=2)) == rows(skeleton.depth_order(v, e))
    assert rows(skeleton.pieces(v, e, 4, limit=2)) == rows(skeleton.pieces(v, e, 4))
    assert rows(skeleton.diameter(v, e, limit=2)) == rows(skeleton.diameter(v, e))


def test_order_from_given_roots(spark, trees):
    v, e, vertices = trees
    roots = {}
    for frag, vid, *_ in vertices:
        roots[frag] = max(vid, roots.get(frag, -1))
    r = spark.createDataFrame(list(roots.items()), "frag_id long, root_vid long")
    assert rows(skeleton.depth_order(v, e, r, limit=0)) == rows(skeleton.depth_order(v, e, r))


def test_observations_on_the_way_from_the_root(spark, trees):
    v, e, vertices = trees
    rng = random.Random(9)
    at = [(frag, vid, 1000 * k + n) for k, (frag, vid, *_) in enumerate(vertices) if rng.random() < 0.4 for n in range(rng.randrange(1, 4))]
    at = spark.createDataFrame(at, "frag_id long, vid long, id long")
    key = lambda df: sorted(map(str, rows(df)))  # noqa: E731  nulls
    assert key(skeleton.obs_tree(v, e, at, limit=2)) == key(skeleton.obs_tree(v, e, at))


def test_one_fragment_of_300_000_vertices(spark):
    """A chain with side branches, beyond what one task would take here; depths and subtree sizes have closed forms."""
    n = 200_000
    chain = spark.range(1, n).selectExpr("1L as frag_id", "id - 1 as u", "id as v", "1.0D as len")
    twigs = spark.range(n // 2).selectExpr("1L as frag_id", "2 * id as u", f"{n} + id as v", "0.5D as len")
    tree = tours.rooted(chain.unionByName(twigs), spark.createDataFrame([(1, 0)], "frag_id long, vid long"))
    got = tree.selectExpr(
        "count(*) as n", "count(distinct pos) as places", "max(pos) as last",
        f"count_if(vid < {n} and (depth <> vid or dist <> vid)) as odd_chain",
        f"count_if(vid >= {n} and (dist <> 2 * (vid - {n}) + 0.5 or size <> 1)) as odd_twigs",
        f"count_if(vid < {n} and size <> {n} - vid + ({n} - vid) div 2) as odd_sizes",
    ).first()
    assert got["n"] == got["places"] == got["last"] + 1 == 300_000
    assert got["odd_chain"] == got["odd_twigs"] == got["odd_sizes"] == 0


def test_cycles_are_errors(spark):
    ring = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 0, 1.0)], "frag_id long, u long, v long, len double")
    with pytest.raises(ValueError):
        tours.rooted(ring, spark.createDataFrame([(1, 0)], "frag_id long, vid long"))


def test_all_gainful_cuts(spark):
    """A chain of twelve stretches of unlike labels takes eleven cuts."""
    v = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0) for i in range(36)], "frag_id long, vid long, x double, y double, z double, r double")
    e = spark.createDataFrame([(1, i, i + 1) for i in range(35)], "frag_id long, u long, v long")
    labels = spark.createDataFrame([(1, i, i // 3, 2) for i in range(36)], "frag_id long, vid long, label long, n long")
    cuts = skeleton.best_cuts(v, e, labels).collect()
    assert sorted(r["v"] for r in cuts) == [3 * k for k in range(1, 12)] and cuts[-1]["after"] < cuts[-1]["before"]
    assert math.isclose(sum(r["before"] - r["after"] for r in cuts), 72 * 71 / 2 - 12 * 6 * 5 / 2)
