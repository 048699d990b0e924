"""Neighbours in space by grid cells: equi joins on cells, then the exact distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import cosine, distance, hash_order
from pointweave.operators.shared import BLOCKS, all_pairs, counted, dealt, in_blocks, members_met, shuffled, tasks_of
from pointweave.sources.scratch import Scratch

XYZ = ("x", "y", "z")


def _cell(size: float, point: tuple[str, ...] = XYZ) -> list[F.Column]:
    return [F.floor(F.col(c) / size).alias(f"_c{k}") for k, c in enumerate(point)]


def _around(rows: DataFrame, size: float, reach: int = 1) -> DataFrame:
    """A copy of each row for every cell within ``reach`` of its own."""
    out = rows
    for k, c in enumerate(XYZ):
        own = F.floor(F.col(c) / size)
        out = out.withColumn(f"_c{k}", F.explode(F.sequence(own - reach, own + reach)))
    return shuffled(out)


def _width(rows: DataFrame, size: float, most: float, key: str | None = None, least: float = 0.0) -> float:
    """``size`` halved, to ``least`` at the least, until the mean row has at most ``most`` rows in its cell (and of its key), itself included.

    Where halving thins the cells no more, as among copies, it ends with the widest that are about as thin.
    """
    def crowd(width: float) -> float:
        held = rows.groupBy(*_cell(width), *([key] if key else [])).agg(F.count("*").cast("double").alias("_n"))
        return held.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0] or 0.0

    tried = [(crowd(size), size)]
    while tried[-1][0] > most and tried[-1][1] / 2 >= least and len(tried) < 24:
        if len(tried) > 4 and tried[-1][0] > 0.95 * tried[-4][0]:
            break
        tried.append((crowd(tried[-1][1] / 2), tried[-1][1] / 2))
    return max(w for n, w in tried if n <= 1.1 * max(most, tried[-1][0]))


def radius_pairs(left: DataFrame, right: DataFrame, r: float, key: str | None = None) -> DataFrame:
    """``a, b, d``: ids of left and right points within r (J7); both hold id, x, y, z and, if named, an equal key.

    The right side's cells are as wide as r, so a left point meets the 27 around its own.
    """
    keys = ([key] if key else []) + ["_c0", "_c1", "_c2"]
    a = _around(left.select("id", *XYZ, *([key] if key else [])), r).withColumnRenamed("id", "a")
    b = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in XYZ], *([key] if key else []), *_cell(r))
    return a.join(b, keys).withColumn("d", distance(XYZ, ("_x", "_y", "_z"))).where(F.col("d") <= r).select("a", "b", "d")


def self_radius_pairs(points: DataFrame, r: float, key: str | None = None) -> DataFrame:
    """``a, b, d`` with a < b."""
    return radius_pairs(points, points, r, key).where("a < b")


def knn(queries: DataFrame, points: DataFrame, k: int, cell: float, max_distance: float | None = None, key: str | None = None, differs: str | None = None, max_rounds: int = 12) -> DataFrame:
    """``a, b, d, rank``: the k nearest other points of each query, exactly (J6); ties go to the lower id.

    Round n looks in cells of ``2**n`` times the first width, which holds every point within that distance; a query is
    settled once its k-th hit is that near, or the width passes ``max_distance``, and only the others go on.
    The first width is ``cell``, halved where that holds many more points than k.
    ``key``: both must agree in it; ``differs``: they must not.
    """
    tmp, todo, done = Scratch(queries.sparkSession, "knn"), queries, None
    extra = [c for c in (key, differs) if c]
    held = points.select(F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in XYZ], *[F.col(c).alias(f"_k_{c}") for c in extra])
    todo = tmp.write(queries.select(F.col("id").alias("a"), *XYZ, *extra), "queries")
    size = _width(points, cell, k + 3, key)
    for n in range(max_rounds + round(math.log2(cell / size))):
        cells = held
        for i, c in enumerate(XYZ):
            cells = cells.withColumn(f"_c{i}", F.floor(F.col(f"_{c}") / size))
        on = ["_c0", "_c1", "_c2"]
        asked = _around(todo, size)
        if key:
            asked, cells, on = asked.withColumn("_key", F.col(key)), cells.withColumn("_key", F.col(f"_k_{key}")), [*on, "_key"]
        hits = asked.join(cells, on).where("a <> b")
        if differs:
            hits = hits.where(F.col(differs) != F.col(f"_k_{differs}"))
        hits = hits.withColumn("d", distance(XYZ, ("_x", "_y", "_z")))
        limit = size if max_distance is None else min(size, max_distance)
        hits = hits.where(F.col("d") <= limit).select("a", "b", "d")
        ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
        ranked = tmp.write(ranked, "hits")
        last = max_distance is not None and size >= max_distance
        full = ranked if last else ranked.join(ranked.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("a"), "a", "left_semi")
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        todo = tmp.write(todo.join(full.select("a").distinct(), "a", "left_anti"), "queries")
        if todo.isEmpty():
            return done
        size *= 2
    # What is left lies far from k points: compare it with all of them, in blocks.
    if key:
        rest = todo.join(held, F.col(key) == F.col(f"_k_{key}"))
    else:
        rest = shuffled(todo.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(63))))).join(held.withColumn("_blk", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")), "_blk")
    rest = rest.where("a <> b")
    if differs:
        rest = rest.where(F.col(differs) != F.col(f"_k_{differs}"))
    rest = rest.withColumn("d", distance(XYZ, ("_x", "_y", "_z")))
    best = rest.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
    return done.unionByName(best.select("a", "b", "d", "rank"))


def points_in_boxes(boxes: DataFrame, points: DataFrame, cell: float, block: int = 256, rows: int = 4_000_000) -> DataFrame:
    """``box_id, id, ...``: points inside boxes (lo_x, hi_x, ...), faces included (J4, J32); a box is listed in every cell that it touches.

    Cells narrow, to a quarter at the least, until the mean point has ``block`` points in its cell; a cell of more is dealt into keys of about ``block`` points.
    What is shuffled says little of the pairs that come of it, so tasks are as many as give each about ``rows`` pairs to look at.
    """
    size = _width(points, cell, block, least=cell / 4)
    cells = ["_c0", "_c1", "_c2"]
    held = points.withColumns({f"_c{k}": F.floor(F.col(c) / size) for k, c in enumerate(XYZ)})
    crowd = held.groupBy(*cells).agg(F.count("*").alias("_n"), F.ceil(F.count("*") / block).cast("int").alias("_b"))
    own = F.pmod(F.xxhash64(*points.columns), F.col("_b")).cast("int")
    held = held.join(crowd, cells).withColumn("_i", own).drop("_n", "_b")
    out = boxes
    for k, c in enumerate(XYZ):
        out = out.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / size), F.floor(F.col(f"hi_{c}") / size))))
    out = shuffled(out).join(crowd, cells)
    pairs = out.agg(F.sum(F.col("_n").cast("double"))).first()[0] or 0.0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / rows))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_n", "_b")
    keys = [*cells, "_i"]
    j = shuffled(out.repartition(tasks, *keys)).join(held.repartition(tasks, *keys), keys)
    inside = F.lit(True)
    for c in XYZ:
        inside &= F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return j.where(inside).drop(*keys)


def nearest_soma(skeletons: DataFrame, nuclei: DataFrame, margin: float, cell: float) -> DataFrame:
    """``frag_id, nucleus_id, d``: of the nuclei in a skeleton's box with its margin the nearest to its centroid."""
    aggs = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))]
    boxes = skeletons.groupBy("frag_id").agg(*aggs)
    for c in XYZ:
        boxes = boxes.withColumn(f"lo_{c}", F.col(f"lo_{c}") - margin).withColumn(f"hi_{c}", F.col(f"hi_{c}") + margin)
    inside = points_in_boxes(boxes, nuclei.select("nucleus_id", *XYZ), cell).withColumn("d", distance(XYZ, ("m_x", "m_y", "m_z")))
    return inside.groupBy("frag_id").agg(F.min_by("nucleus_id", F.struct("d", "nucleus_id")).alias("nucleus_id"), F.min("d").alias("d"))


def somata_near(fragments: DataFrame, somata: DataFrame, r: float) -> DataFrame:
    """``seg, somata``: distinct somata within r of a fragment's points (J5); points (id, seg, x, y, z)."""
    tmp = Scratch(fragments.sparkSession, "somata")
    cells = ["_c0", "_c1", "_c2"]
    points, centres = fragments.select("seg", *XYZ), somata.select(F.col("id").alias("b"), *XYZ)
    # Two points of one cell of this width are nearer than r.
    close = 0.57 * r
    sure = centres.select("b", *_cell(close)).join(points.select("seg", *_cell(close)).distinct(), cells).select("b", "seg").distinct()
    sure = tmp.write(sure, "sure")
    # The other fragments near a soma: only these are measured.
    held = points.select("seg", *_cell(r)).distinct()
    asked = _around(centres, r).join(held, cells).join(sure, ["b", "seg"], "left_anti")
    there = points.select("seg", *[F.col(c).alias(f"_{c}") for c in XYZ], *_cell(r))
    rest = shuffled(asked).join(there, ["seg", *cells]).where(distance(XYZ, ("_x", "_y", "_z")) <= r).select("b", "seg").distinct()
    return sure.unionByName(rest).groupBy("seg").agg(F.countDistinct("b").alias("somata"))


def _first_segment_pairs(obs: DataFrame, cap: int, seg: str, seed: int) -> DataFrame:
    """``a, b``: ids of two observations of a segment, each pair one way, ``cap`` of them per segment or all if there are fewer."""
    held = obs.where(F.col(seg) > 0).withColumnRenamed(seg, "_g")
    n = held.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_p", F.expr("(_n * (_n - 1)) div 2"))
    whole = all_pairs(held.join(n.where(F.col("_p") <= cap), "_g", "left_semi"), "_g", F.col("id"), "id").select("a", "b")
    order = W.partitionBy("_g").orderBy(hash_order("id", seed=seed), "id")
    ranked = held.select("_g", "id", (F.row_number().over(order) - 1).cast("long").alias("_r")).where(F.col("_r") <= cap)
    k = shuffled(counted(n.where(F.col("_p") > cap), F.lit(cap), "_k").select("_g", F.expr("_k % _n").alias("_a"), F.expr("(_k % _n + _k div _n + 1) % _n").alias("_b")))
    end = lambda c, name: ranked.select("_g", F.col("_r").alias(c), F.col("id").alias(name))
    some = shuffled(k.join(end("_a", "a"), ["_g", "_a"])).join(end("_b", "b"), ["_g", "_b"]).select("a", "b")
    return whole.unionByName(some)


def same_segment_pairs(obs: DataFrame, cap: int | None = None, seg: str = "seg", seed: int = 0) -> DataFrame:
    """``src, dst``: all pairs of a segment's observations, or ``cap`` of them per segment, both ways.

    Where a cap acts, observations stand in a ring in hash order and meet the next one, then the one after it, and so on, until there are enough pairs;
    else blocks of them meet.  Only the pairs that are returned are ever made.
    """
    if cap is None:
        return all_pairs(obs.where(F.col(seg) > 0), seg, F.col("id"), "id", both=True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return _first_segment_pairs(obs, cap, seg, seed).select(F.explode(both).alias("p")).select("p.*")


def nearest_of_groups(left: DataFrame, right: DataFrame, r: float, met: F.Column) -> DataFrame:
    """``ga, gb, d, a, b``: the nearest two points within r of each two groups that ``met`` allows (of ga, gb, ta, tb), ties to the lowest a, then b; both (id, g, t, x, y, z).

    Pairs of points are looked for within a width that the crowd asks for, and the groups that none joins within twice that, and so on: most groups
    that mingle are settled at once, and only cells of the others meet further out.
    """
    tmp = Scratch(left.sparkSession, "nearest")
    cells = ["_c0", "_c1", "_c2"]
    name = lambda df, p: df.select(*[F.col(c).alias(f"{n}{p}") for c, n in (("g", "g"), ("t", "t"))], F.col("id").alias(p), *XYZ)
    a, b = tmp.write(name(left, "a"), "left"), tmp.write(name(right, "b"), "right")
    held = lambda df, p, size: df.select(f"g{p}", f"t{p}", *_cell(size)).distinct()

    def wider(df: DataFrame) -> DataFrame:
        """Cells with those around them, _n0, _n1, _n2."""
        for k in range(3):
            df = df.withColumn(f"_n{k}", F.explode(F.sequence(F.col(f"_c{k}") - 1, F.col(f"_c{k}") + 1)))
        return shuffled(df)

    def cells_met(size: float) -> DataFrame:
        other = held(b, "b", size).withColumnsRenamed({f"_c{k}": f"_n{k}" for k in range(3)})
        return wider(held(a, "a", size)).join(other, ["_n0", "_n1", "_n2"]).where(met)

    best = lambda near: near.groupBy("ga", "gb").agg(F.min(F.struct("d", "a", "b")).alias("s")).select("ga", "gb", "s.*")
    apart = distance(XYZ, ("_x", "_y", "_z"))
    far = b.withColumnsRenamed({c: f"_{c}" for c in XYZ})
    size, todo, done = _width(b, r, 8), None, None
    while True:
        if todo is None:
            there = far.withColumns({f"_c{k}": F.floor(F.col(f"_{c}") / size) for k, c in enumerate(XYZ)})
            near = _around(a, size).join(there, cells).where(met)
        else:
            asked = shuffled(cells_met(size).join(todo, ["ga", "gb"]).select("ga", "gb", *cells, "_n0", "_n1", "_n2"))
            near = shuffled(asked.join(a.select("ga", "a", *XYZ, *_cell(size)), ["ga", *cells]))
            near = near.join(far.select("gb", "b", "_x", "_y", "_z", *[F.floor(F.col(f"_{c}") / size).alias(f"_n{k}") for k, c in enumerate(XYZ)]), ["gb", "_n0", "_n1", "_n2"])
        found = tmp.write(best(near.withColumn("d", apart).where(F.col("d") <= size)), "found")
        done = found if done is None else done.unionByName(found)
        if size >= r:
            return done
        todo = cells_met(r).select("ga", "gb").distinct() if todo is None else todo
        todo = tmp.write(todo.join(found, ["ga", "gb"], "left_anti"), "todo")
        if todo.isEmpty():
            return done
        size *= 2


def endpoint_pairs(ends: DataFrame, r: float) -> DataFrame:
    """``fa, fb, d``: the nearest pair of endpoints of each two fragments within r, fa < fb (J7); ends (id, frag, x, y, z)."""
    e = ends.select("id", F.col("frag").alias("g"), F.lit(0).alias("t"), *XYZ)
    return nearest_of_groups(e, e, r, F.col("ga") < F.col("gb")).select(F.col("ga").alias("fa"), F.col("gb").alias("fb"), "d")


def adjacent_obs_pairs(frag_pairs: DataFrame, obs: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """``src, dst``: observations of adjacent fragments, all pairs, or ``cap`` of them per pair of fragments.

    With a cap the first observations of both, in hash order, about as many of each; only the pairs that are returned are ever made.
    """
    n = obs.groupBy(F.col("frag").alias("_f")).agg(F.count("*").alias("_n"))
    end = lambda c: n.select(F.col("_f").alias(c), F.col("_n").alias(f"n{c}"))
    j = frag_pairs.select("fa", "fb").join(end("fa"), "fa").join(end("fb"), "fb")
    held = in_blocks(obs.withColumnRenamed("frag", "_f"), "_f", F.col("id"), "id", 4000)
    all_of = lambda some: members_met(some.select("fa", "fb"), held, held, "fa", "fb", "_f").select(F.explode("_l").alias("src"), "_r").select("src", F.explode("_r").alias("dst"))
    if cap is None:
        return all_of(j)
    whole = all_of(j.where(F.col("nfa") * F.col("nfb") <= cap))
    # The cap acts: ranks in hash order.
    ranked = obs.select(F.col("frag").alias("_f"), "id", (F.row_number().over(W.partitionBy("frag").orderBy(hash_order("id", seed=seed), "id")) - 1).cast("long").alias("_r")).where(F.col("_r") < cap)
    k = j.where(F.col("nfa") * F.col("nfb") > cap)
    k = k.withColumn("_w", F.least("nfb", F.greatest(F.ceil(F.sqrt(F.lit(float(cap)))), F.ceil(F.lit(cap) / F.col("nfa")))).cast("long"))
    k = shuffled(counted(k, F.lit(cap), "_k").select("fa", "fb", F.expr("_k div _w").alias("_a"), F.expr("_k % _w").alias("_b")))
    side = lambda f, r, name: ranked.select(F.col("_f").alias(f), F.col("_r").alias(r), F.col("id").alias(name))
    some = shuffled(k.join(side("fa", "_a", "src"), ["fa", "_a"])).join(side("fb", "_b", "dst"), ["fb", "_b"]).select("src", "dst")
    return whole.unionByName(some)


def typed_edges(same: DataFrame, near: DataFrame, ends: DataFrame, dna: DataFrame) -> DataFrame:
    """``src, dst, etype, same_seg, spatial, endpoint, cos``: the three kinds of edges with the cosine of their embeddings."""
    every = same.select("src", "dst", F.lit(0).alias("etype")).unionByName(near.select("src", "dst", F.lit(1).alias("etype"))).unionByName(ends.select("src", "dst", F.lit(2).alias("etype")))
    j = every.join(dna.select(F.col("id").alias("src"), F.col("dna").alias("_a")), "src").join(dna.select(F.col("id").alias("dst"), F.col("dna").alias("_b")), "dst")
    return j.select("src", "dst", "etype", *[(F.col("etype") == k).cast("int").alias(n) for k, n in enumerate(("same_seg", "spatial", "endpoint"))], cosine("_a", "_b").alias("cos"))


def _links(obs: DataFrame, group: str, partner: str) -> DataFrame:
    return obs.where((F.col(group) != 0) & (F.col(partner) != 0)).select(F.col(group).alias("g"), F.col(partner).alias("p")).distinct()


def _block_count(groups: int, block: int) -> int:
    return max(-(-groups // (8 * block)), min(-(-groups // block), 8))


def _shared_in_blocks(links: DataFrame, groups: int, block: int) -> DataFrame:
    """``ga, gb, shared`` by products of blocks: groups with their partners are dealt into blocks, and each two blocks meet in a task that counts for all their pairs at once.

    A group is sent to each block, so blocks are up to eight times as large where there are many; a task counts and passes on some rows of its pairs at a time.
    """
    blocks = _block_count(groups, block)
    held = links.groupBy("g").agg(F.array_sort(F.collect_list("p")).alias("ps")).withColumn("own", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int"))
    dealt_to = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt_to = dealt_to.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "g", "ps")
    step = 1024

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        own, g, ps = (t.column(c).combine_chunks() for c in ("own", "g", "ps"))
        own, g, lengths = own.to_numpy(), g.to_numpy(), np.diff(ps.offsets.to_numpy())
        known, column = np.unique(ps.flatten().to_numpy(), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(lengths)])

        def has(rows: np.ndarray, at: int) -> np.ndarray:
            """Which of ``step`` partners the groups have: bounded memory, whatever the partners."""
            held = np.repeat(np.arange(len(rows)), lengths[rows])
            places = column[np.repeat(start[rows] - np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]), lengths[rows]) + np.arange(len(held))] - at
            some = (places >= 0) & (places < step)
            out = np.zeros((len(rows), min(step, len(known) - at)), np.float32)
            out[held[some], places[some]] = 1
            return out

        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        whole = has(right, 0) if len(known) <= step else None
        for first in range(0, len(left), step):
            some = left[first : first + step]
            n = np.zeros((len(some), len(right)), np.float32 if whole is not None else np.int32)
            for at in range(0, len(known), step):
                n += (has(some, at) @ (has(right, at) if whole is None else whole).T).astype(n.dtype)
            if lo == hi:
                n[np.arange(first, first + len(some))[:, None] >= np.arange(len(right))[None]] = 0
            for row in range(0, len(some), 64):
                i, j = np.nonzero(n[row : row + 64])
                a, b = g[some[row + i]], g[right[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n[row + i, j].astype(np.int64))], ["ga", "gb", "shared"])

    kind = links.schema["g"].dataType.simpleString()
    tasks = tasks_of(links.sparkSession, groups**2 / 2)
    return dealt_to.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInArrow(count, f"ga {kind}, gb {kind}, shared long")


def shared_partners(obs: DataFrame, group: str = "seg", partner: str = "partner", block: int = 1000) -> DataFrame:
    """``ga, gb, shared``: partners that two groups have in common.

    Where a partner brings few groups together, groups meet by partners, and a partner of many groups is spread over tasks.  Where that would make more rows than there
    are pairs of groups, blocks of groups meet instead: each pair is in one task, so nothing is made or shuffled that isn't returned.
    """
    links = Scratch(obs.sparkSession, "partners").write(_links(obs, group, partner), "links")
    groups = links.select("g").distinct().count()
    rows = links.groupBy("p").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    if rows > float(groups) ** 2:
        return _shared_in_blocks(links, groups, block)
    left, right = dealt(links, "p", "g", block)
    met = left.withColumnRenamed("g", "ga").join(right.withColumnRenamed("g", "gb"), ["p", *BLOCKS]).where("ga < gb")
    return met.groupBy("ga", "gb").agg(F.count("*").alias("shared"))


def shared_partners_of(pairs: DataFrame, obs: DataFrame, group: str = "seg", partner: str = "partner") -> DataFrame:
    """``ga, gb, shared`` of the stated pairs (ga < gb) only: the partners of one looked up among those of the other."""
    links = _links(obs, group, partner)
    held = pairs.select("ga", "gb").where("ga < gb").distinct().join(links.select(F.col("g").alias("ga"), "p"), "ga")
    return held.join(links.select(F.col("g").alias("gb"), "p"), ["gb", "p"]).groupBy("ga", "gb").agg(F.count("*").alias("shared"))


def evidence_edges(obs: DataFrame, near: DataFrame, clique_size: int, scores: DataFrame | None = None) -> DataFrame:
    """``src, dst, distance, same_scaffold, shared_partners, seg_connectivity`` (J11): near pairs and cliques of a group's first members; obs (id, seg, partner, x, y, z)."""
    first = obs.where("seg <> 0").withColumn("_r", F.row_number().over(W.partitionBy("seg").orderBy("id"))).where(F.col("_r") <= clique_size)
    a, b = first.select("seg", F.col("id").alias("src")), first.select("seg", F.col("id").alias("dst"))
    clique = a.join(b, "seg").where("src < dst").select("src", "dst")
    edges = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).unionByName(clique).distinct()
    end = lambda k, p: obs.select(F.col("id").alias(k), F.col("seg").alias(f"{p}seg"), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    j = edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    j = j.withColumn("distance", distance(("ax", "ay", "az"), ("bx", "by", "bz"))).withColumn("same_scaffold", ((F.col("aseg") == F.col("bseg")) & (F.col("aseg") != 0)).cast("int"))
    j = j.withColumn("ga", F.least("aseg", "bseg")).withColumn("gb", F.greatest("aseg", "bseg"))
    j = j.join(shared_partners_of(j, obs), ["ga", "gb"], "left").withColumn("shared_partners", F.coalesce("shared", F.lit(0)))
    if scores is not None:
        j = j.join(scores.select("ga", "gb", "score"), ["ga", "gb"], "left")
    else:
        j = j.withColumn("score", F.lit(None).cast("double"))
    return j.select("src", "dst", "distance", "same_scaffold", "shared_partners", F.coalesce("score", F.lit(0.5)).alias("seg_connectivity"))


def group_scores(obs: DataFrame, r: float, score: F.Column) -> DataFrame:
    """``src, dst, score``: a score of two groups near in centroid, for all pairs of their members, the greatest kept (J12); ``score`` reads d."""
    centroids = obs.where("seg <> 0").groupBy(F.col("seg").alias("id")).agg(*[F.avg(c).alias(c) for c in XYZ])
    scored = Scratch(obs.sparkSession, "groups").write(self_radius_pairs(centroids, r).withColumn("score", score), "scored")
    # Two observations meet once where each is a row of its own id; only those that are more than one row have a greatest score to find.
    many = obs.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit(True).alias("more"))
    held = obs.select("seg", "id").join(many, "id", "left")
    once, again = held.where("more is null"), held.where("more")
    blocks_of = lambda rows: in_blocks(rows, "seg", F.col("id"), "id", 4000)

    def pairs_of(of: DataFrame, other: DataFrame) -> DataFrame:
        met = members_met(scored.select("a", "b", "score"), of, other, "a", "b", "seg")
        made = met.select("score", F.explode("_l").alias("p"), "_r").select("score", "p", F.explode("_r").alias("q"))
        return made.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), "score")

    single = pairs_of(blocks_of(once), blocks_of(once))
    if again.isEmpty():
        return single
    several = pairs_of(blocks_of(again), blocks_of(held)).unionByName(pairs_of(blocks_of(once), blocks_of(again)))
    return single.unionByName(several.groupBy("src", "dst").agg(F.max("score").alias("score")))


def fragment_edge_scores(pairs: DataFrame, dna: DataFrame, r: float) -> DataFrame:
    """Adds ``score``: nearness, clamped to 0..1, times how well embeddings agree, which is 1 where either has none."""
    j = pairs.join(dna.select(F.col("frag").alias("fa"), F.col("dna").alias("_a")), "fa", "left").join(dna.select(F.col("frag").alias("fb"), F.col("dna").alias("_b")), "fb", "left")
    agree = F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1.0).otherwise((cosine("_a", "_b") + 1) / 2)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / r))
    return j.withColumn("score", near * agree).drop("_a", "_b")


def capped_degree(edges: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Edges among the k best of either end."""
    order = [F.desc(score), "fa", "fb"]
    ends = edges.select("fa", "fb", score, F.explode(F.array("fa", "fb")).alias("_end"))
    best = ends.withColumn("_r", F.row_number().over(W.partitionBy("_end").orderBy(*order))).where(F.col("_r") <= k).select("fa", "fb").distinct()
    return edges.join(best, ["fa", "fb"], "left_semi")


def nearest_anchors(frags: DataFrame, anchors: DataFrame, r: float, k: int) -> DataFrame:
    """``frag, anchor, gap, rank, margin``: each fragment's k nearest anchor clouds, margin = second gap / first (J20); both (id, group, x, y, z)."""
    side = lambda df: df.select("id", F.col("group").alias("g"), F.lit(0).alias("t"), *XYZ)
    gap = nearest_of_groups(side(frags), side(anchors), r, F.lit(True)).select(F.col("ga").alias("frag"), F.col("gb").alias("anchor"), F.col("d").alias("gap"))
    order = W.partitionBy("frag").orderBy("gap", "anchor")
    out = gap.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.lead("gap").over(order) / F.greatest("gap", F.lit(1e-9)))
    return out.where(F.col("rank") <= k)


def nearest_other_group(obs: DataFrame, cell: float) -> DataFrame:
    """``group, other, d``: the nearest centroid of another group."""
    c = obs.where("seg <> 0").groupBy(F.col("seg").alias("id")).agg(*[F.avg(a).alias(a) for a in XYZ])
    return knn(c, c, 1, cell).select(F.col("a").alias("group"), F.col("b").alias("other"), "d")


def closest_points(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """``d``, the least distance between two point sets."""
    shifted = b.select((-1 - F.col("id")).alias("id"), *XYZ)
    return knn(a.select("id", *XYZ), shifted, 1, cell).agg(F.min("d").alias("d"))


def local_density(obs: DataFrame, k: int, cell: float, key: str = "seg") -> DataFrame:
    """``id, spacing``: mean distance to the k nearest of the same group."""
    return knn(obs, obs, k, cell, key=key).groupBy(F.col("a").alias("id")).agg(F.avg("d").alias("spacing"))
