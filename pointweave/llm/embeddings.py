"""Near-duplicate vectors by spherical k-means cells.

Vectors are compared by cosine in double precision, with those of their own length.  Equal vectors
collapse first, by 128 bits of hash, and count by their number.  Vectors of one length are one cell at
first; a cell of more than ``full_rows`` is cut by spherical k-means, fitted on a sample of it (16 vectors, chosen by
the hash of their id, for each of up to ``fan`` new cells of about ``cell_rows``), and so are the new cells, level by
level, while that saves work: a clump of vectors so near to each other that they would visit most of each other's cells
stays whole.  Every vector is assigned: it lives in the cell of its nearest centroid, and visits each
other one whose boundary with that is within ``margin``.  A pair is found if either vector visits,
or lives in, the home of the other.  For a pair of cosine 0.9 whose difference has a random direction in 64
dimensions the distances to a boundary differ by 0.055 (one standard deviation); such pairs are the hardest.

Inside a cell, blocks of ``block_rows`` are compared with blocks, those who live there with one another
and with those who visit, one pair of blocks per group, so the largest cell is as many small tasks.  A group returns, for each vector,
its number of links and the smallest id of those it connects there; no pair leaves a task.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite components
link with nothing, as do rows without an id (whose component is null); vectors of different lengths don't link; rows that repeat
an id count as vectors of their own; of equally near centroids the first is home; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.beside import mapped_beside
from pointweave.operators.components import connected_components
from pointweave.sources.scratch import Scratch

SOUND = "vec_id is not null and size(e) > 0 and forall(e, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(e, v -> v <> 0)"


def unit(rows: list[list[float]] | pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    if isinstance(rows, pa.Array):
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    else:
        x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(c)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            np.add.at(sums, (part @ c.T).argmax(1), part)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def cells_of(x: np.ndarray, centroids: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and which cells it lives in or visits."""
    s = x @ centroids.T
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
    near = s.max(1)[:, None] - s <= margin * apart[home]
    near[np.arange(len(x)), home] = True
    return home, near


def worth_cutting(x: np.ndarray, centroids: np.ndarray, margin: float) -> bool:
    """Whether comparing within the cells that these centroids make costs at most 0.75 of comparing all."""
    return len(centroids) > 1 and 2 * cells_of(x, centroids, margin)[1].sum(1).mean() - 1 <= 0.75 * len(centroids)


def compare(cell: int, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, home: np.ndarray, visits: list[list[int]], first: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among the rows of a cell that it must count: row, number of linked vectors, smallest connected id.

    first: compare the rows before it with those from it on; None: all with one another.
    """
    left, right = [], []
    stop = len(ids) if first is None else first
    for lo in range(0, stop, 256):
        to = min(lo + 256, stop)
        begin = lo if first is None else first
        i, j = np.nonzero(x[lo:to] @ x[begin:].T >= threshold)
        i, j = i + lo, j + begin
        keep = (i < j) & ((home[i] == cell) | (home[j] == cell))
        left.append(i[keep])
        right.append(j[keep])
    i, j = np.concatenate(left), np.concatenate(right)
    swap = home[i] != cell  # let i be the one that lives here
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    # A pair that both homes find counts in the lower one.
    names, code = np.unique(np.concatenate([home, *map(np.asarray, visits)]).astype(np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), [len(r) for r in visits])
    both = np.isin(i * len(names) + code[j], owner * len(names) + code[len(ids) :]) & (home[j] < cell)
    i, j = i[~both], j[~both]
    n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label, a, b = np.arange(len(ids)), rank[i], rank[j]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rows = np.flatnonzero(n)
    return rows, n[rows].astype(np.int64), ids[order][label[rank[rows]]]


def place(classes: DataFrame, margin: float, cell_rows: int, full_rows: int, fan: int, broadcast_bytes: int) -> DataFrame:
    """``id, home, visits``: the cells of every vector, as hashes of their names."""
    tmp = Scratch(classes.sparkSession, "cells")
    kind = classes.schema["e"].dataType.simpleString()

    def fit(table: pa.Table) -> pa.Table:
        x = unit(table.column("e"))[np.argsort(table.column("id").to_numpy(), kind="stable")]
        c = spherical_kmeans(x, int(table.column("k")[0].as_py()))
        value = c.tobytes() if worth_cutting(x, c, margin) else b""
        return pa.table({"cell": table.column("cell")[:1], "value": pa.array([value], pa.binary())})

    def assign(b: pa.RecordBatch, value_of: Callable[[str], object]) -> pa.RecordBatch:
        at, to, stays = [], [], []
        names = np.array(b.column("cell").to_pylist(), object)
        for cell in sorted(set(names)):
            rows = np.flatnonzero(names == cell)
            value = value_of(cell)
            if not value:  # a clump: a name with ! isn't cut again
                at.append(rows)
                to += [f"{cell}!"] * len(rows)
                stays.append(np.ones(len(rows), bool))
                continue
            x = unit(b.column("e").take(pa.array(rows)))
            home, near = cells_of(x, np.frombuffer(value, np.float64).reshape(-1, x.shape[1]), margin)
            i, j = np.nonzero(near)
            at.append(rows[i])
            to += [f"{cell}.{c}" for c in j.tolist()]
            stays.append(home[i] == j)
        i = np.concatenate(at) if at else np.zeros(0, np.int64)
        lives = b.column("lives").to_numpy(zero_copy_only=False).astype(bool)[i] & (np.concatenate(stays) if at else np.zeros(0, bool))
        took = pa.array(i)
        return pa.RecordBatch.from_arrays([b.column("id").take(took), b.column("e").take(took), pa.array(to, pa.string()), pa.array(lives)], ["id", "e", "cell", "lives"])

    here, settled = classes.select("id", "e", F.size("e").cast("string").alias("cell"), F.lit(True).alias("lives")), []
    while True:
        full = here.where("not endswith(cell, '!')").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > full_rows)
        full = tmp.write(full.withColumn("k", F.least(F.lit(fan), F.ceil(F.col("n") / cell_rows)).cast("int")), "full")
        settled.append(here.join(full, "cell", "left_anti").select("id", "cell", "lives"))  # a level reads the cells that the one before has cut, no others
        if full.isEmpty():
            break
        of_hash = F.pmod(F.xxhash64("id", F.length("cell")), F.lit(1 << 20)) < F.col("k") / F.col("n") * (16 << 20)
        sample = here.join(full, "cell").where(of_hash).select("cell", "k", "id", "e")
        centroids = tmp.write(sample.groupBy("cell").applyInArrow(fit, "cell string, value binary"), "centroids")
        here = tmp.write(mapped_beside(here.join(full, "cell", "left_semi"), "cell", centroids, assign, f"id long, e {kind}, cell string, lives boolean", broadcast_bytes), "cells")
    here = reduce(DataFrame.unionByName, settled)
    cell = F.xxhash64("cell")
    return here.groupBy("id").agg(F.max(F.when(F.col("lives"), cell)).alias("home"), F.collect_set(F.when(~F.col("lives"), cell)).alias("visits"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, margin: float = 0.06, cell_rows: int = 128, full_rows: int = 480, block_rows: int = 1024, fan: int = 1024, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row."""
    tmp = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    sound = rows.where(SOUND).withColumn("k1", F.xxhash64(F.lit(1), "e")).withColumn("k2", F.xxhash64(F.lit(2), "e"))
    classes = tmp.write(sound.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("e").alias("e")), "classes")
    cells = place(classes, margin, cell_rows, full_rows, fan, broadcast_bytes)
    placed = tmp.write(classes.select("id", "w", "e").join(cells, "id").withColumn("visits", F.array_except("visits", F.array("home"))), "placed")
    stays = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).withColumn("lives", F.col("cell") == F.col("home"))
    blocks_of = lambda c: F.ceil(F.count_if(c) / block_rows).cast("int")
    sizes = stays.groupBy("cell").agg(blocks_of(F.col("lives")).alias("homes"), blocks_of(~F.col("lives")).alias("guests"))
    # Blocks of those who live in the cell come first; guests meet these, not one another.
    own = F.when(F.col("lives"), F.pmod(F.xxhash64("id"), "homes")).otherwise(F.col("homes") + F.pmod(F.xxhash64("id"), "guests"))
    cut = stays.join(sizes, "cell").where("homes > 0").withColumn("own", own.cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("lives"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1))))
    dealt = dealt.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "w", "home", "visits", "e")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            cell, lo, hi = group
            own = table.column("own").to_numpy()
            first = None if lo == hi else int((own == lo).sum())
            table = table.take(np.argsort(own, kind="stable"))
            ids, w, home = (table.column(c).to_numpy() for c in ("id", "w", "home"))
            at, n, low = compare(cell, ids, unit(table.column("e")), w, home, table.column("visits").to_pylist(), first, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n), pa.array(low)], ["src", "n", "dst"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("cell", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                key = tuple(keys[:, at].tolist())
                if key != group:
                    if held:
                        yield close()
                    held, group = [], key
                held.append(b.slice(at, to - at))
        if held:
            yield close()

    by = ["cell", "lo", "hi"]
    found = tmp.write(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(links, "src long, n long, dst long"), "links")
    counts = found.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    whole = connected_components(found.where("src <> dst").select("src", "dst")).withColumnRenamed("node", "id")
    known = classes.join(counts, "id", "left").join(whole, "id", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    others = rows.where(f"not coalesce({SOUND}, false)")
    linked = sound.join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
