"""Training pairs, retrieval and merge features.  Caps take rows in hash order; they bound what is learned from, not what is scored."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import distance, hash_order
from pointweave.operators.sequence import pca_order
from pointweave.operators.shared import BLOCKS, all_pairs, dealt, lowest
from pointweave.operators.spatial import XYZ, knn
from pointweave.sources.scratch import Scratch


def split_pairs(obs: DataFrame) -> DataFrame:
    """``a, b, y``: all pairs within one base id, a < b, labelled by whether the later ids agree (J24); obs (id, seg, label, x, y, z)."""
    p = all_pairs(obs.where("label <> 0 and seg > 0"), "seg", F.struct("id", "label"), "id").where("a.id <> b.id")
    return p.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), (F.col("a.label") == F.col("b.label")).cast("int").alias("y"))


def merge_pairs(obs: DataFrame, k: int, r: float, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """``a, b, d, y``: near pairs of unlike base ids; positives share the later id, negatives are neighbours of positive anchors with another one, at most ``ratio`` for each positive."""
    sound = obs.where("label <> 0 and seg <> 0")
    flat = knn(sound, sound, k, r, max_distance=r, key="label", differs="seg")
    pos = Scratch(obs.sparkSession, "merges").write(flat.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct().withColumn("y", F.lit(1)), "positives")
    anchors = sound.join(pos.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    near = knn(anchors, sound, k, r, max_distance=r, differs="label")
    neg = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    n = int(ratio * pos.count())
    return pos.unionByName(lowest(neg, n, hash_order("a", "b", seed=seed), "a", "b").withColumn("y", F.lit(0)))


def partition_merge_pairs(parts: DataFrame, cell: float, k: int, r: float) -> DataFrame:
    """``pa, pb, d, y``: pairs of half-partitions: of one later id and unlike bases (1), or the k nearest of other later ids (0); pairs that share a synapse are left out.

    parts (id, part, label, syn_id, x, y, z); distances are those of the closest points.
    """
    own = parts.select("part", "label").distinct()
    left, right = dealt(own.where("label <> 0"), "label", "part")
    pos = left.withColumnRenamed("part", "pa").join(right.withColumnRenamed("part", "pb"), ["label", *BLOCKS]).where("pa < pb").select("pa", "pb")
    centres = parts.groupBy("part", "label").agg(*[F.avg(c).alias(c) for c in XYZ]).withColumnRenamed("part", "id")
    near = knn(centres, centres, k, r, max_distance=r, differs="label")
    neg = near.select(F.least("a", "b").alias("pa"), F.greatest("a", "b").alias("pb")).distinct()
    every = pos.withColumn("y", F.lit(1)).unionByName(neg.withColumn("y", F.lit(0)))
    s = parts.select("part", "syn_id").distinct()
    held = every.select("pa", "pb").distinct().join(s.select(F.col("part").alias("pa"), "syn_id"), "pa")  # only the pairs in question look at their synapses
    shared = held.join(s.select(F.col("part").alias("pb"), "syn_id"), ["pb", "syn_id"], "left_semi").select("pa", "pb").distinct()
    kept = every.join(shared, ["pa", "pb"], "left_anti")
    gap = part_gaps(kept.select("pa", "pb"), parts, cell)
    return kept.join(gap, ["pa", "pb"], "left")


def _boxes(points: DataFrame, low: list[float], size: float, deepest: int) -> list[DataFrame]:
    """Cells that hold points of a part, level by level: ``part, c0, c1, c2``, the box around their points, and one of them; level n halves the width n times."""
    cells = [F.floor((F.col(c) - low[k]) / (size / 2**deepest)).alias(f"c{k}") for k, c in enumerate(XYZ)]
    own = points.select("part", *cells, *[F.col(c).cast("double").alias(f"{e}{c}") for e in ("lo_", "hi_") for c in XYZ], F.struct(*[F.col(c).cast("double").alias(c) for c in XYZ]).alias("one"))
    out: list[DataFrame] = []
    for _ in range(deepest + 1):
        own = own.groupBy("part", "c0", "c1", "c2").agg(*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in XYZ], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in XYZ], F.min("one").alias("one"))
        out.insert(0, own)
        own = own.select("part", *[F.shiftright(f"c{k}", 1).alias(f"c{k}") for k in range(3)], *[f"{e}{c}" for e in ("lo_", "hi_") for c in XYZ], "one")
    return out


def part_gaps(pairs: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """``pa, pb, d``: closest-point distance of the stated pairs of groups (V10); pairs of which a group has no point are left out.

    Branch and bound over nested cells: each holds the box around its group's points and one of them.  Two boxes bound the distance of their points from below,
    two points from above.  Level by level, pairs of cells that can't beat the least upper bound of their groups go, and the others are halved, down to
    cells no wider than ``cell``; only points of cells that are left are compared.
    """
    tmp = Scratch(pairs.sparkSession, "gaps")
    asked = pairs.select("pa", "pb").distinct()
    named = asked.select(F.col("pa").alias("part")).unionByName(asked.select(F.col("pb").alias("part"))).distinct()
    points = tmp.write(parts.select("part", *XYZ).dropna().join(named, "part", "left_semi"), "points")
    ends = points.agg(*[F.min(c) for c in XYZ], *[F.max(c) for c in XYZ]).first()
    if ends[0] is None:
        return pairs.select("pa", "pb", F.lit(0.0).alias("d")).limit(0)
    low, size = list(ends[:3]), max(1e-9, *(float(b - a) for a, b in zip(ends[:3], ends[3:])))
    deepest = min(20, max(0, math.ceil(math.log2(size / cell))))
    levels = [tmp.write(level, "level") for level in _boxes(points, low, size, deepest)]
    cells = ["c0", "c1", "c2"]
    side = lambda p, level: level.select(F.col("part").alias(f"p{p}"), *[F.col(c).alias(f"{p}{c}") for c in level.columns if c != "part"])

    def bounded(met: DataFrame) -> DataFrame:
        """Adds the bounds of a pair of cells; a box is no nearer than the sum of its axes' gaps says, rounded like the distance itself."""
        gap = sum((F.pow(F.greatest(F.col(f"alo_{c}") - F.col(f"bhi_{c}"), F.col(f"blo_{c}") - F.col(f"ahi_{c}"), F.lit(0.0)), 2) for c in XYZ), F.lit(0.0))
        both = sum((F.pow(F.col(f"aone.{c}") - F.col(f"bone.{c}"), 2) for c in XYZ), F.lit(0.0))
        return met.select("pa", "pb", *[f"{p}{c}" for p in "ab" for c in cells], F.sqrt(gap).alias("low"), F.sqrt(both).alias("high"))

    now, best = None, None
    for level in levels:
        if now is None:
            met = asked.join(side("a", level), "pa").join(side("b", level), "pb")
        else:
            kids = lambda p: side(p, level).withColumns({f"_{p}{c}": F.shiftright(f"{p}{c}", 1) for c in cells})  # noqa: B023, E731
            above = now.select("pa", "pb", *[F.col(f"{p}{c}").alias(f"_{p}{c}") for p in "ab" for c in cells])
            met = above.join(kids("a"), ["pa", *[f"_a{c}" for c in cells]]).join(kids("b"), ["pb", *[f"_b{c}" for c in cells]])
        met = tmp.write(bounded(met), "met")
        upper = met.groupBy("pa", "pb").agg(F.min("high").alias("d"))
        best = tmp.write(upper if best is None else best.unionByName(upper).groupBy("pa", "pb").agg(F.min("d").alias("d")), "best")
        now = met.join(best, ["pa", "pb"]).where("low < d").drop("low", "high", "d")
    fine = points.select("part", *[F.floor((F.col(c) - low[k]) / (size / 2**deepest)).alias(f"c{k}") for k, c in enumerate(XYZ)], *XYZ)
    near = now.join(side("a", fine), ["pa", *[f"a{c}" for c in cells]]).join(side("b", fine), ["pb", *[f"b{c}" for c in cells]])
    near = near.groupBy("pa", "pb").agg(F.min(distance([f"a{c}" for c in XYZ], [f"b{c}" for c in XYZ])).alias("d"))
    return best.unionByName(near).groupBy("pa", "pb").agg(F.min("d").alias("d"))


def halves(obs: DataFrame, group: str = "seg") -> DataFrame:
    """Adds ``half`` (0, 1): the group cut in the middle along its principal axis."""
    j = pca_order(obs.withColumn("group", F.col(group)))
    n = j.groupBy("group").agg(F.count("*").alias("_n"))
    return j.join(n, "group").withColumn("half", (F.col("pos") >= F.ceil(F.col("_n") / 2)).cast("int")).select(*obs.columns, "half")


def merge_examples(obs: DataFrame, cell: float, group: str = "seg") -> DataFrame:
    """``left, right, y``: the two halves of one root (1), and nearest different roots, as many at most (0)."""
    c = obs.groupBy(F.col(group).alias("id")).agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in XYZ]).where("n >= 2")
    pos = c.select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit(1).alias("y"))
    near = knn(c, c, 1, cell).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()
    return pos.unionByName(near.withColumn("y", F.lit(0)))


def cluster_examples(obs: DataFrame, cell: float, group: str = "seg") -> DataFrame:
    """``example, group, y``: members of atomic (1: one root) and false (0: two near roots) clusters."""
    m = merge_examples(obs, cell, group)
    pos = m.where("y = 1").select(F.xxhash64("left").alias("example"), F.col("left").alias("group"), "y")
    neg = m.where("y = 0").select(F.xxhash64("left", "right").alias("example"), F.explode(F.array("left", "right")).alias("group"), "y")
    return pos.unionByName(neg)


def class_balance(examples: DataFrame) -> DataFrame:
    """One row: examples and share of positives."""
    return examples.select("example", "y").distinct().agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("positive_share"))


def label_pairs(obs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``a, b, y``: pairs of equal and of unlike labels, n / 2 each at most, made in hash buckets (J29, A24); obs (id, label)."""
    sound = obs.where("label <> 0").select("id", "label")
    order = W.partitionBy("label").orderBy(hash_order("id", seed=seed), "id")
    pos = sound.withColumn("b", F.lead("id").over(order)).where("b is not null").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), F.lit(1).alias("y"))
    mixed = W.partitionBy(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(256))).orderBy(hash_order("id", seed=seed + 2), "id")
    neg = sound.withColumn("b", F.lead("id").over(mixed)).withColumn("_l", F.lead("label").over(mixed)).where("b is not null and label <> _l").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), F.lit(0).alias("y"))
    half = lambda df: df.orderBy(hash_order("a", "b", seed=seed), "a", "b").limit(n // 2)
    return half(pos).unionByName(half(neg))


def stratified_roots(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...], grid: tuple[int, int, int], per_cell: int, seed: int = 0) -> DataFrame:
    """``root, cell``: at most ``per_cell`` roots of each cell of a grid, in hash order."""
    cell = F.lit(0)
    for c, lo, hi, n in zip(XYZ, low, high, grid):
        cell = cell * n + F.least(F.greatest(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(0)), F.lit(n - 1))
    roots = points.where("root <> 0").withColumn("cell", cell).select("root", "cell").distinct()
    return roots.withColumn("_r", F.row_number().over(W.partitionBy("cell").orderBy(hash_order("root", seed=seed), "root"))).where(F.col("_r") <= per_cell).drop("_r")


def simhash_code(features: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """Adds ``code``: signs of hashed random projections of the array ``f`` (J30), up to 63 bits."""
    def plane(b: int) -> F.Column:
        terms = F.transform("f", lambda v, i: v * F.when(F.xxhash64(i, F.lit(b), F.lit(seed)) >= 0, 1.0).otherwise(-1.0))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    code = F.lit(0).cast("long")
    for b in range(bits):
        code = code.bitwiseOR(F.when(plane(b) >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
    return features.withColumn("code", code)


def _parts(code: str, bits: list[list[int]]) -> F.Column:
    """The code's blocks: for each list of bit places these bits, packed."""
    pick = lambda b, to: F.shiftleft(F.shiftrightunsigned(F.col(code), b).bitwiseAND(F.lit(1).cast("long")), to)
    return F.array(*[reduce(lambda x, y: x.bitwiseOR(y), [pick(b, to) for to, b in enumerate(block)]) for block in bits])


def _scanned(left: DataFrame, units: DataFrame, k: int, block: int = 131_072) -> DataFrame:
    """``code, fold, other, distance`` by comparing codes with all units of other folds (code, fold, n): blocks of both meet, each in a task that passes on the nearest of its own."""
    spark = left.sparkSession
    left = left.select("code", "fold")
    rows = left.count()
    mine = max(1, -(-rows // 32_768), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1024))
    others = max(1, -(-units.count() // block))
    own = lambda n, seed: F.pmod(F.xxhash64("code", "fold", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("_i", own(mine, 1)).withColumn("_j", every(others))
    right = units.select("code", "fold", "n", own(others, 2).alias("_j"), every(mine).alias("_i"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("fold"), b.sort_by("fold")
        mine, its = (t.column("code").to_numpy().astype(np.int64) for t in (a, b))
        fold, other = (t.column("fold").to_numpy() for t in (a, b))
        n, wide = b.column("n").to_numpy(), -(-max(1, len(its)) // 64) * 64
        bits = np.full((32, wide), 255, np.uint8)
        out = []
        at = 0
        while at < len(mine) and len(its):
            to = min(at + 32, int(np.searchsorted(fold, fold[at], "right")))  # of one fold
            d = bits[: to - at]
            for tile in range(0, len(its), 8192):
                some = its[tile : tile + 8192]
                d[:, tile : tile + len(some)] = np.bitwise_count((mine[at:to, None] ^ some[None]).view(np.uint64))
            d[:, np.searchsorted(other, fold[at], "left") : np.searchsorted(other, fold[at], "right")] = 255
            # The k-th of the least of 64 parts each bounds the k-th of all.
            least = d.reshape(to - at, 64, -1).min(axis=1)
            far = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(to - at, 254, np.uint8)
            i, j = np.nonzero(d <= np.minimum(far, 254)[:, None])
            out.append((mine[at + i], fold[at + i], its[j], d[i, j].astype(np.int32), n[j]))
            at = to
        names = ["code", "fold", "other", "distance", "n"]
        kinds = [np.int64, np.int64, np.int64, np.int32, np.int64]
        return pa.table({c: np.concatenate([o[x] for o in out]).astype(t) if out else np.array([], t) for x, (c, t) in enumerate(zip(names, kinds))})

    dealt_to = lambda df: df.repartition(mine * others, "_i", "_j").groupBy("_i", "_j")
    met = dealt_to(left).cogroup(dealt_to(right)).applyInArrow(nearest, "code long, fold long, other long, distance int, n long")
    order = W.partitionBy("code", "fold").orderBy("distance").rangeBetween(W.unboundedPreceding, W.currentRow)
    held = met.withColumn("_sum", F.sum("n").over(order))
    at = held.groupBy("code", "fold", "distance", "_sum").agg(F.sum("n").alias("_c"), F.collect_set("other").alias("_o"))
    return at.where(F.col("_sum") - F.col("_c") < k).select("code", "fold", F.explode("_o").alias("other"), "distance")


def near_codes(codes: DataFrame, k: int, worth: int = 20_000) -> DataFrame:
    """``code, fold, other, distance``: for each code and fold the other codes, nearest first, as far as k members of other folds take; exact.

    codes (code long, fold), a row for each member.  Multi-index hashing: the bits that differ at all are dealt into m blocks of about log2(n) bits.  Two codes within
    m * (s + 1) - 1 bits agree in some block but for s bits, so looking up each block with all changes of up to s bits
    finds them all.  s grows until the k-th member lies within that distance; only codes that still lack it look further.
    Where a change costs more than ``worth`` comparisons in a block of codes, the rest are compared with all codes, block by block.
    """
    tmp = Scratch(codes.sparkSession, "codes")
    units = tmp.write(codes.groupBy("code", "fold").agg(F.count("*").alias("n")), "units")
    every = tmp.write(units.groupBy("code").agg(F.sum("n").alias("n")), "every")
    n, either, both = every.agg(F.count("*"), F.bit_or("code"), F.bit_and("code")).first()
    places = [b for b in range(64) if n and ((either ^ both) >> b) & 1]
    m = max(1, round(len(places) / max(1.0, math.log2(max(n, 2)))))
    blocks = [places[b::m] for b in range(min(m, len(places)))] or [[0]]
    m, width = len(blocks), max(map(len, blocks))
    keyed = lambda df: df.select("*", F.posexplode(_parts("code", blocks)).alias("block", "part"))
    table = keyed(every.select("code")).withColumnRenamed("code", "other")
    members = units.select(F.col("code").alias("other"), F.col("fold").alias("_f"), F.col("n").alias("_own"))
    todo, found, out, tried = units.select("code", "fold"), None, [], 0
    for s in range(width + 1):
        tried += m * math.comb(width, s)
        if worth * tried >= n or s == width:
            out.append(_scanned(todo, units, k))
            break
        change = F.explode(F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for c in itertools.combinations(range(width), s)]))
        probe = keyed(todo.select("code").distinct()).withColumn("_x", change).withColumn("part", F.col("part").bitwiseXOR(F.col("_x"))).drop("_x")
        met = probe.join(table, ["block", "part"]).select("code", "other").distinct()
        met = met.withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("other"))).cast("int"))
        found = tmp.write(met if found is None else found.join(todo.select("code").distinct(), "code", "left_semi").unionByName(met).distinct(), "found")
        # Members of other folds at each distance, and the distance that holds the k-th.
        mine = todo.join(found, "code").join(every.select(F.col("code").alias("other"), "n"), "other").join(members.withColumnRenamed("_f", "fold"), ["other", "fold"], "left")
        at = mine.groupBy("code", "fold", "distance").agg(F.sum(F.col("n") - F.coalesce("_own", F.lit(0))).alias("c")).where("c > 0")
        held = at.withColumn("_sum", F.sum("c").over(W.partitionBy("code", "fold").orderBy("distance")))
        far = held.groupBy("code", "fold").agg(F.min(F.when(F.col("_sum") >= k, F.col("distance"))).alias("far"))
        done = far.where(F.col("far") <= m * (s + 1) - 1)
        done = tmp.write(done, "done")
        out.append(done.join(found, "code").where("distance <= far").select("code", "fold", "other", "distance"))
        todo = tmp.write(todo.join(done.select("code", "fold"), ["code", "fold"], "left_anti"), "todo")
        if todo.isEmpty():
            break
    return reduce(lambda x, y: x.unionByName(y), out)


def retrieval(codes: DataFrame, k: int, folds: int = 5) -> DataFrame:
    """``id, other, distance, hit``: the k nearest codes of other folds, exactly, ties by id (J30); codes (id, group, y, code) with ``fold``, or else folds of whole groups."""
    c = codes if "fold" in codes.columns else codes.withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(folds)))
    c = Scratch(codes.sparkSession, "retrieval").write(c.select("id", F.col("fold").cast("long").alias("fold"), "y", F.col("code").cast("long").alias("code")), "codes")
    # Of a code's members in a fold only the first k can be anyone's.
    first = c.withColumn("_r", F.row_number().over(W.partitionBy("code", "fold").orderBy("id"))).where(F.col("_r") <= k).select(F.col("code").alias("other_code"), F.col("fold").alias("_f"), F.col("id").alias("other"), F.col("y").alias("_y"))
    near = near_codes(c.select("code", "fold"), k).withColumnRenamed("other", "other_code")
    best = near.join(first, "other_code").where("fold <> _f").withColumn("_r", F.row_number().over(W.partitionBy("code", "fold").orderBy("distance", "other"))).where(F.col("_r") <= k)
    return c.join(best.select("code", "fold", "other", "distance", "_y"), ["code", "fold"]).select("id", "other", "distance", (F.col("y") == F.col("_y")).alias("hit"))


def retrieval_scores(found: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: precision at k, the base rate of the class, and the lift."""
    p = found.agg(F.avg(F.col("hit").cast("double")).alias("precision"))
    n = codes.groupBy("y").agg(F.count("*").alias("n"))
    base = n.crossJoin(n.agg(F.sum("n").alias("_t"))).agg(F.sum((F.col("n") / F.col("_t")) ** 2).alias("base_rate"))  # one row
    return p.crossJoin(base).withColumn("lift", F.col("precision") / F.col("base_rate"))


def desplit_pairs(obs: DataFrame, k: int, r: float, tip: int, cell: float, ratio: float = 1.0) -> DataFrame:
    """``a, b, y, side, rank, id``: merge pairs with the nearest points of each end's own fragment, nearest first."""
    p = merge_pairs(obs, k, r, ratio)
    ends = p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = knn(obs.join(ends, "id", "left_semi"), obs, tip, cell, key="seg").select(F.col("a").alias("_q"), F.col("b").alias("id"), "rank")
    left = p.join(near, p["a"] == near["_q"]).select("a", p["b"], "y", F.lit("a").alias("side"), "rank", "id")
    right = p.join(near, p["b"] == near["_q"]).select("a", p["b"], "y", F.lit("b").alias("side"), "rank", "id")
    return left.unionByName(right)


def proximity_scores(pairs: DataFrame, obs: DataFrame, scale_nm: float) -> DataFrame:
    """Adds ``score`` = exp(-distance / scale): the baseline that embeddings must beat."""
    end = lambda k, p: obs.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    j = pairs.join(end("a", "p"), "a").join(end("b", "q"), "b")
    return j.withColumn("score", F.exp(-distance(("px", "py", "pz"), ("qx", "qy", "qz")) / scale_nm)).select(*pairs.columns, "score")
