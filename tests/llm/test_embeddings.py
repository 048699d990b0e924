import numpy as np

from pointweave.llm import embeddings as em


def slow(ids, x, threshold=0.9):
    u = em.unit(x)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    group = list(range(len(ids)))
    for start in range(len(ids)):
        todo = [start]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(near[a]):
                if ids[group[b]] > ids[group[start]]:
                    group[b] = group[start]
                    todo.append(b)
    return near.sum(1), near


def table(spark, n=700, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(100, 400):  # copies of the first rows, near the threshold and nearer
        x[i] = x[i % 7] + rng.normal(size=dim) * rng.choice([0.02, 0.25, 0.45])
    x[400:420] = x[3]
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", em.F.lit("clash")), x


def reach(near):
    n = len(near)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], n).min(1))
        if (new == low).all():
            return low
        low = new


def test_one_cell_is_exact(spark):
    vectors, x = table(spark)
    got = {r["vec_id"]: r for r in em.near_vectors(vectors, full_rows=1000, block_rows=100).collect()}
    n, near = slow(list(range(len(x))), x)
    assert [got[i]["n_links"] for i in range(len(x))] == n.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == reach(near).tolist()


def recall(spark, n_links=0.95, **how):
    vectors, x = table(spark, n=1500, dim=64)
    got = {r["vec_id"]: r for r in em.near_vectors(vectors.repartition(3), **how).collect()}
    n, near = slow(list(range(len(x))), x)
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= n).all() and mine.sum() >= n_links * n.sum()
    low = reach(near)
    assert all(low[got[i]["component_id"]] == low[i] for i in range(len(x)))


def test_cells_of_the_default_settings(spark):
    recall(spark)


def test_levels_of_cells_count_no_pair_twice(spark):
    recall(spark, 0.9, cell_rows=50, full_rows=120, fan=6, block_rows=60)


def test_centroids_that_are_not_broadcast(spark):
    recall(spark, 0.9, cell_rows=50, full_rows=120, fan=6, broadcast_bytes=0)


def test_hard_pairs_at_ten_and_at_fifty_cells():
    rng = np.random.default_rng(4)
    x = em.unit(rng.normal(size=(6000, 64)))
    off = rng.normal(size=x.shape)
    off = em.unit(off - (off * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(0.19) * off  # the least similar pairs that link
    for cells in (10, 50):
        c = em.spherical_kmeans(x[: 16 * cells], cells)
        (hx, nx), (hy, ny) = em.cells_of(x, c, 0.06), em.cells_of(y, c, 0.06)
        rows = np.arange(len(x))
        assert (nx[rows, hy] | ny[rows, hx]).mean() >= 0.95


def test_a_clump_is_not_cut():
    rng = np.random.default_rng(5)
    x = em.unit(rng.normal(size=64) + 0.02 * rng.normal(size=(2000, 64)))
    assert not em.worth_cutting(x, em.spherical_kmeans(x[:256], 16), 0.06)
    y = em.unit(rng.normal(size=(2000, 64)))
    assert em.worth_cutting(y, em.spherical_kmeans(y[:256], 16), 0.06)


def test_unsound_vectors_link_with_nothing(spark):
    e = [1.0, 0.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, e), (2, e), (2, e), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.1, 0.0]), (None, e), (10, [3e38, 1e37])]
    out = em.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got == {1: (3, 1), 2: (3, 1), 10: (3, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (2, 9), 11: (2, 9), 12: (2, 9), None: (0, None)}
    assert em.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_a_level_writes_only_the_cells_it_cuts(spark, monkeypatch):
    cut, write = [], em.Scratch.write

    def noted(self, df, name):
        out = write(self, df, name)
        if name == "cells":
            cut.append({r["id"] for r in out.select("id").collect()})
        return out

    monkeypatch.setattr(em.Scratch, "write", noted)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i < 130 else 16).tolist()) for i in range(230)]  # those of length 16 are few enough for one cell
    placed = em.place(spark.createDataFrame(rows, "id long, e array<double>"), 0.06, 65, 120, 6, 32_000_000).select("id", "home").collect()
    assert sorted(r["id"] for r in placed) == list(range(230)) and all(r["home"] is not None for r in placed)
    assert cut[0] == set(range(130)) and all(ids <= cut[0] for ids in cut)
