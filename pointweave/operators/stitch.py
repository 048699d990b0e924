"""Tiles, super fragments, and stitching them across tiles."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import cosine, norm, ratio
from pointweave.operators.components import connected_components
from pointweave.operators.connect import majority
from pointweave.operators.shared import BLOCKS, dealt
from pointweave.operators.spatial import XYZ, nearest_of_groups
from pointweave.sources.scratch import Scratch


def tile_grid(obs: DataFrame, rows: int, columns: int, halo: float, axes: tuple[str, str] | None = None) -> DataFrame:
    """``id, tile_id, core``: tiles of equal counts on the two widest axes; each observation has one core tile and copies wherever a halo covers it."""
    if axes is None:
        spans = obs.agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
        axes = tuple(sorted(XYZ, key=lambda c: -(spans[c] or 0.0))[:2])

    def cuts(c: str, n: int) -> list[float]:
        if n == 1:
            return []
        shares = ", ".join(str(k / n) for k in range(1, n))
        return obs.agg(F.expr(f"percentile({c}, array({shares}))").alias("p")).first()["p"] or []

    sides = [cuts(axes[0], rows), cuts(axes[1], columns)]
    owner = [reduce(lambda a, b: a + b, [(F.col(c) > F.lit(x)).cast("int") for x in xs], F.lit(0)) for c, xs in zip(axes, sides)]
    out = obs.withColumn("_o0", owner[0]).withColumn("_o1", owner[1])
    for k, (c, xs) in enumerate(zip(axes, sides)):
        # The tiles whose bounds, widened by the halo, hold the point lie in a row.
        low = reduce(lambda a, b: a + b, [(F.col(c) - halo > F.lit(x)).cast("int") for x in xs], F.lit(0))
        high = reduce(lambda a, b: a + b, [(F.col(c) + halo > F.lit(x)).cast("int") for x in xs], F.lit(0))
        out = out.withColumn(f"_t{k}", F.explode(F.sequence(low, high)))
    return out.select("id", (F.col("_t0") * columns + F.col("_t1")).alias("tile_id"), ((F.col("_t0") == F.col("_o0")) & (F.col("_t1") == F.col("_o1"))).alias("core"))


def super_fragments(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Super fragments of each tile's clusters, and their keys (A47); parts (tile_id, cluster, key, atom, label, has_soma, dna).

    ``super_id, tile_id, cluster_id, n_obs, n_atoms, has_soma, majority_label, dna`` (mean unit vector) and ``super_id, key``.
    """
    sound = parts.where("cluster >= 0").withColumn("super_id", F.xxhash64("tile_id", "cluster"))
    base = sound.groupBy("super_id").agg(F.first("tile_id").alias("tile_id"), F.first("cluster").alias("cluster_id"), F.count("*").alias("n_obs"), F.countDistinct("atom").alias("n_atoms"), F.bool_or("has_soma").alias("has_soma"))
    best = majority(sound, "super_id", "label", None, 0).select("super_id", F.col("label").alias("majority_label"))
    axes = sound.where("dna is not null").select("super_id", F.posexplode("dna").alias("pos", "v")).groupBy("super_id", "pos").agg(F.sum("v").alias("v"))
    dna = axes.groupBy("super_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("d")).select("super_id", F.transform("d", lambda x: x["v"]).alias("dna"))
    dna = dna.select("super_id", F.transform("dna", lambda v: v / F.greatest(norm("dna"), F.lit(1e-12))).alias("dna"))
    supers = base.join(best, "super_id", "left").join(dna, "super_id", "left").na.fill(0, ["majority_label"])
    return supers, sound.select("super_id", "key").distinct()


def shared_key_links(supers: DataFrame, keys: DataFrame, min_shared: int, exclude: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """``i, j, shared``: supers of different tiles that share ``min_shared`` keys or more, each the other's best in its tile (J17); ties by id; a key of many supers is spread over tasks."""
    held = keys.join(exclude.select("key"), "key", "left_anti") if exclude is not None else keys
    held = held.join(supers.select("super_id", "tile_id"), "super_id")
    left, right = dealt(held, "key", "super_id", block)
    a, b = left.select("key", *BLOCKS, F.col("super_id").alias("i"), F.col("tile_id").alias("ti")), right.select("key", *BLOCKS, F.col("super_id").alias("j"), F.col("tile_id").alias("tj"))
    n = a.join(b, ["key", *BLOCKS]).where("ti <> tj").groupBy("i", "ti", "j", "tj").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    mine = n.withColumn("_r", F.row_number().over(W.partitionBy("i", "tj").orderBy(F.desc("shared"), "j"))).where("_r = 1")
    return mine.alias("x").join(mine.select(F.col("i").alias("_j"), F.col("j").alias("_i")), (F.col("x.i") == F.col("_i")) & (F.col("x.j") == F.col("_j"))).where("x.i < x.j").select("x.i", "x.j", "x.shared")


def stitch_candidates(ends: DataFrame, supers: DataFrame, r: float) -> DataFrame:
    """``i, j, end_i, end_j, gap, cos, score``: the nearest endpoints of two supers of different tiles within r (J18); ends (id, super_id, x, y, z)."""
    e = ends.join(supers.select("super_id", F.col("tile_id").alias("t")), "super_id").select("id", F.col("super_id").alias("g"), "t", *XYZ)
    near = nearest_of_groups(e, e, r, (F.col("ga") < F.col("gb")) & (F.col("ta") != F.col("tb")))
    best = near.select(F.col("ga").alias("i"), F.col("gb").alias("j"), F.col("a").alias("end_i"), F.col("b").alias("end_j"), F.col("d").alias("gap"))
    dna = supers.select("super_id", "dna")
    out = best.join(dna.select(F.col("super_id").alias("i"), F.col("dna").alias("_a")), "i").join(dna.select(F.col("super_id").alias("j"), F.col("dna").alias("_b")), "j")
    out = out.withColumn("cos", F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1.0).otherwise(cosine("_a", "_b")))
    return out.withColumn("score", (1 - F.col("gap") / r) * (F.col("cos") + 1) / 2).drop("_a", "_b")


def capped_candidates(found: DataFrame, most: int, max_rounds: int = 1000) -> DataFrame:
    """Candidates by falling score as long as both supers have fewer than ``most`` (J18); ties by ids.

    A round keeps every candidate that is, at both ends, among the first of those not yet decided that still have room: all
    earlier ones could be kept and it would fit.  Those of a full super go.  Only the first ``most`` rows of a super are ever ranked together.
    """
    tmp = Scratch(found.sparkSession, "capped")
    todo, kept = tmp.write(found, "todo"), []
    for _ in range(max_rounds):
        key = F.struct((-F.col("score")).alias("o"), "i", "j").alias("e")
        ends = todo.select(F.explode(F.array("i", "j")).alias("s"), key)
        first = ends.withColumn("_r", F.row_number().over(W.partitionBy("s").orderBy("e"))).where(F.col("_r") <= most)
        taken = [k.select(F.explode(F.array("i", "j")).alias("s")) for k in kept]
        held = reduce(lambda x, y: x.unionByName(y), taken).groupBy("s").agg(F.count("*").alias("_n")) if kept else None
        fits = first.join(held, "s", "left").where(F.col("_r") + F.coalesce("_n", F.lit(0)) <= most) if kept else first
        new = fits.groupBy("e").agg(F.count("*").alias("_c")).where("_c = 2").select("e.i", "e.j")
        new = tmp.write(todo.join(new, ["i", "j"], "left_semi"), "kept")
        kept.append(new)
        full = reduce(lambda x, y: x.unionByName(y), [k.select(F.explode(F.array("i", "j")).alias("s")) for k in kept]).groupBy("s").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("s")
        left = todo.join(new.select("i", "j"), ["i", "j"], "left_anti")
        for c in ("i", "j"):
            left = left.join(full.select(F.col("s").alias(c)), c, "left_anti")
        todo = tmp.write(left.select(*found.columns), "todo")
        if todo.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), kept)
    raise RuntimeError(f"candidates did not settle in {max_rounds} rounds")


REASONS = ("cycle", "endpoint_used", "soma_cannot_link", "obs_cap", "below_min_score")
_PENDING = "o double, i long, j long, end_i long, end_j long, forced boolean, ca long, cb long, na long, nb long, sa boolean, sb boolean, used boolean"
_ORDER = ["o", "i", "j", "end_i", "end_j"]


def _prefix(tmp: Scratch, pending: DataFrame, limit: int) -> DataFrame:
    """The first rows in order, as many as can be decided at once, with ``comp``: no joined group of clusters has more than ``limit`` rows.

    Tries all rows, then ever shorter prefixes; ``limit`` rows are one group whatever they connect.
    """
    share = 1.0
    while True:
        part = pending if share == 1.0 else pending.where(F.col("o") < pending.agg(F.percentile_approx("o", share)).first()[0])
        if part.limit(limit + 1).count() <= limit:
            first = part if share == 1.0 else pending.orderBy(*_ORDER).limit(limit)
            return first.withColumn("comp", F.lit(0).cast("long"))
        # A row whose endpoint is used joins nothing: it is decided with its group if both ends are in one, and alone else.
        comp = connected_components(part.where("not used").select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        named = part.join(comp.select(F.col("node").alias("ca"), F.col("component").alias("_a")), "ca", "left").join(comp.select(F.col("node").alias("cb"), F.col("component").alias("_b")), "cb", "left")
        named = tmp.write(named.withColumn("comp", F.when(F.col("_a") == F.col("_b"), F.col("_a"))).drop("_a", "_b"), "groups")
        largest = named.where("comp is not null").groupBy("comp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= limit:
            return named
        share /= 8


def _solver(max_obs: int | None):
    """Decides the rows of a group one after another."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ORDER)
        parent, size, soma = {}, {}, {}
        for c, n, s in (("ca", "na", "sa"), ("cb", "nb", "sb")):
            for k, x, y in zip(pdf[c].tolist(), pdf[n].tolist(), pdf[s].tolist()):
                parent[k], size[k], soma[k] = k, x, y

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        used: set[tuple[int, int]] = set()
        out, grown = [], set()
        for r in pdf.itertuples(index=False):
            a, b = find(r.ca), find(r.cb)
            ends = {(r.i, r.end_i), (r.j, r.end_j)}
            if a == b:
                why = "already_joined" if r.forced else "cycle"
            elif r.forced:
                why = "joined"
            elif r.used or ends & used:
                why = "endpoint_used"
            elif soma[a] and soma[b]:
                why = "soma_cannot_link"
            elif max_obs is not None and size[a] + size[b] > max_obs:
                why = "obs_cap"
            else:
                why = "joined"
                used |= ends
            conflict = bool(why == "joined" and soma[a] and soma[b])
            if why == "joined":
                keep, gone = min(a, b), max(a, b)
                parent[gone], size[keep], soma[keep] = keep, size[a] + size[b], soma[a] or soma[b]
                grown |= {a, b}
            out.append((r.i, r.j, r.forced, why, conflict, r.o, r.end_i, r.end_j, 0, 0, 0, False))
        out += [(0, 0, False, "", False, 0.0, 0, 0, c, find(c), size[find(c)], soma[find(c)]) for c in grown]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SOLVED.split(", ")])

    return solve


_SOLVED = "i long, j long, forced boolean, decision string, soma_conflict boolean, o double, end_i long, end_j long, cluster long, to_cluster long, n long, soma boolean"


def stitch(supers: DataFrame, forced: DataFrame, candidates: DataFrame, min_score: float = 0.0, max_obs: int | None = None, group_limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Stitched supers and what was decided on each candidate.

    Forced pairs join first; candidates follow by score (ties by ids), and are turned down if they close a cycle, use
    an endpoint twice, would join two somata or pass ``max_obs`` observations, or score too low.

    The result is that of deciding one pair after another, for groups of any size.  A batch is a prefix of the order: it
    splits into groups of clusters that its pairs connect, which know nothing of each other, so each group is decided in a task of up
    to ``group_limit`` rows.  Then clusters are merged in a table, and what is left of the order follows; pairs within a cluster
    are cycles, and pairs of clusters with a soma each, which can never join, wait until the end for their reason.  One batch does where no group is
    larger than the limit; else each takes ``group_limit`` pairs at least.

    Returns ``super_id, cluster`` and ``i, j, forced, decision, soma_conflict``; the last marks forced pairs that joined two somata.
    A forced pair of one cluster is ``already_joined``.
    """
    tmp = Scratch(supers.sparkSession, "stitch")
    ids = lambda df: [F.col(c).cast("long").alias(c) for c in ("i", "j")]
    none = F.lit(0).cast("long")
    pairs = forced.select(*ids(forced), F.lit(True).alias("forced"), none.alias("end_i"), none.alias("end_j"), F.lit(float("-inf")).alias("o"))
    pairs = pairs.unionByName(candidates.select(*ids(candidates), F.lit(False).alias("forced"), F.col("end_i").cast("long").alias("end_i"), F.col("end_j").cast("long").alias("end_j"), (-F.col("score")).cast("double").alias("o")))
    state = supers.select(F.col("super_id").cast("long").alias("super_id"), F.col("n_obs").cast("long").alias("n"), F.coalesce("has_soma", F.lit(False)).alias("s"))
    every = pairs.join(state.select(F.col("super_id").alias("i"), F.col("n").alias("na"), F.col("s").alias("sa")), "i").join(state.select(F.col("super_id").alias("j"), F.col("n").alias("nb"), F.col("s").alias("sb")), "j")
    every = tmp.write(every.select("o", "i", "j", "end_i", "end_j", "forced", F.col("i").alias("ca"), F.col("j").alias("cb"), "na", "nb", "sa", "sb", F.lit(False).alias("used")), "pairs")
    low = ~F.col("forced") & (F.col("o") > -min_score)
    decided = [every.where(low).select("i", "j", "forced", F.lit("below_min_score").alias("decision"), F.lit(False).alias("soma_conflict"))]
    pending, label, doomed, taken = every.where(~low), state.select("super_id", F.col("super_id").alias("cluster")), [], []
    while True:
        same, never = F.col("ca") == F.col("cb"), ~F.col("forced") & F.col("sa") & F.col("sb") & (F.col("ca") != F.col("cb"))
        decided.append(pending.where(same).select("i", "j", "forced", F.when(F.col("forced"), "already_joined").otherwise("cycle").alias("decision"), F.lit(False).alias("soma_conflict")))
        doomed.append(pending.where(never))
        pending = tmp.write(pending.where(~same & ~never), "pending")
        if pending.isEmpty():
            break
        batch = tmp.write(_prefix(tmp, pending, group_limit), "batch")
        alone = batch.where("comp is null").select("i", "j", "forced", F.lit("endpoint_used").alias("decision"), F.lit(False).alias("soma_conflict"))
        solved = tmp.write(batch.where("comp is not null").groupBy("comp").applyInPandas(_solver(max_obs), _SOLVED), "solved")
        done = solved.where("decision <> ''")
        decided += [alone, done.select("i", "j", "forced", "decision", "soma_conflict")]
        moved = solved.where("decision = ''").select("cluster", "to_cluster", "n", "soma")
        label = tmp.write(label.join(moved.select("cluster", "to_cluster"), "cluster", "left").select("super_id", F.coalesce("to_cluster", "cluster").alias("cluster")), "labels")
        joined = done.where("decision = 'joined' and not forced")
        taken.append(joined.select(F.explode(F.array(F.struct(F.col("i").alias("s"), F.col("end_i").alias("e")), F.struct(F.col("j").alias("s"), F.col("end_j").alias("e")))).alias("k"), F.struct(*_ORDER).alias("by")).select("k.*", "by"))
        rest = pending.join(batch.select(*_ORDER, "forced"), [*_ORDER, "forced"], "left_anti")
        for c, n, s in (("ca", "na", "sa"), ("cb", "nb", "sb")):
            now = moved.select(F.col("cluster").alias(c), "to_cluster", F.col("n").alias("_n"), F.col("soma").alias("_s"))
            rest = rest.join(now, c, "left").withColumn(c, F.coalesce("to_cluster", c)).withColumn(n, F.coalesce("_n", n)).withColumn(s, F.coalesce("_s", s)).drop("to_cluster", "_n", "_s")
        for c in ("i", "j"):
            now = taken[-1].select(F.col("s").alias(c), F.col("e").alias(f"end_{c}"), F.lit(True).alias("_u")).distinct()
            rest = rest.join(now, [c, f"end_{c}"], "left").withColumn("used", F.col("used") | F.coalesce("_u", F.lit(False))).drop("_u")
        pending = tmp.write(rest.select(*[c.split()[0] for c in _PENDING.split(", ")]), "rest")
    never = reduce(lambda x, y: x.unionByName(y), doomed)
    if taken:  # whoever uses an endpoint earlier in the order is the reason
        first = reduce(lambda x, y: x.unionByName(y), taken).groupBy("s", "e").agg(F.min("by").alias("by"))
        for c in ("i", "j"):
            never = never.join(first.select(F.col("s").alias(c), F.col("e").alias(f"end_{c}"), F.col("by").alias(f"by_{c}")), [c, f"end_{c}"], "left")
        before = F.least("by_i", "by_j") < F.struct(*_ORDER)
    else:
        before = F.lit(False)
    decided.append(never.select("i", "j", "forced", F.when(before, "endpoint_used").otherwise("soma_cannot_link").alias("decision"), F.lit(False).alias("soma_conflict")))
    parts = supers.select("super_id").join(label, "super_id", "left").select("super_id", F.coalesce("cluster", "super_id").alias("cluster"))
    return parts, reduce(lambda x, y: x.unionByName(y), decided)


def two_level_stitch(parts: DataFrame, r: float, min_shared: int = 1, min_score: float = 0.0, max_obs: int | None = None, max_edges_per_super: int = 8) -> tuple[DataFrame, DataFrame]:
    """``id, cluster`` of every observation, and the decisions: clusters of tiles as super fragments, joined by shared keys and then by score.

    parts (id, key, tile_id, core, cluster, atom, label, has_soma, dna, x, y, z): the observations of each tile with its halo.
    """
    supers, keys = super_fragments(parts)
    forced = shared_key_links(supers, keys, min_shared)
    ends = parts.where("cluster >= 0").select(F.xxhash64("tile_id", "id").alias("id"), F.xxhash64("tile_id", "cluster").alias("super_id"), *XYZ)
    found = stitch_candidates(ends, supers, r).join(forced.select("i", "j"), ["i", "j"], "left_anti")
    joined, decisions = stitch(supers, forced, capped_candidates(found, max_edges_per_super), min_score, max_obs)
    held = keys.join(supers.select("super_id", "tile_id"), "super_id")
    return global_labels(parts.where("core").select("id", "key", "tile_id"), held, joined), decisions


def reject_counts(decisions: DataFrame) -> DataFrame:
    """``decision, n`` with a row for every reason (G11); forced pairs are no rejections."""
    names = decisions.sparkSession.createDataFrame([(r,) for r in (*REASONS, "joined")], "decision string")
    return names.join(decisions.where("not forced or decision = 'joined'").groupBy("decision").agg(F.count("*").alias("n")), "decision", "left").na.fill(0, ["n"])


def global_labels(owners: DataFrame, keys: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, cluster``: each observation's stitched cluster by its core tile, -1 if none (J33); owners (id, key, tile_id), keys (super_id, tile_id, key)."""
    j = owners.join(keys, ["tile_id", "key"], "left").join(parts, "super_id", "left")
    return j.groupBy("id").agg(F.coalesce(F.min("cluster"), F.lit(-1)).alias("cluster"))


def edge_precision(decisions: DataFrame, supers: DataFrame) -> DataFrame:
    """One row: share of joined pairs whose majority labels agree; label 0 is left out."""
    label = supers.select("super_id", "majority_label")
    j = decisions.join(label.select(F.col("super_id").alias("i"), F.col("majority_label").alias("_a")), "i").join(label.select(F.col("super_id").alias("j"), F.col("majority_label").alias("_b")), "j").where("_a <> 0 and _b <> 0")
    return j.agg(F.count("*").alias("n"), ratio(F.count_if(F.col("_a") == F.col("_b")), F.count("*"), float("nan")).alias("precision"))


def assembled_fraction(obs: DataFrame) -> DataFrame:
    """One row: share of labels in several tiles that lie whole in one cluster (A30); obs (label, tile_id, cluster)."""
    o = obs.where("label <> 0").groupBy("label").agg(F.countDistinct("tile_id").alias("t"), F.countDistinct("cluster").alias("c"), F.min("cluster").alias("m")).where("t >= 2")
    return o.agg(F.count("*").alias("n_objects"), ratio(F.count_if((F.col("c") == 1) & (F.col("m") >= 0)), F.count("*"), float("nan")).alias("assembled"))


def hypotheses(members: DataFrame) -> DataFrame:
    """``cluster, fragments, n_syn, regions, dna`` by size (A46); members (cluster, frag_id, syn_id, region_id, dna)."""
    base = members.groupBy("cluster").agg(F.collect_set("frag_id").alias("fragments"), F.countDistinct("syn_id").alias("n_syn"), F.collect_set("region_id").alias("regions"))
    axes = members.where("dna is not null").dropDuplicates(["cluster", "frag_id"]).select("cluster", F.posexplode("dna").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("v"))
    dna = axes.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("d")).select("cluster", F.transform("d", lambda x: x["v"]).alias("dna"))
    return base.join(dna, "cluster", "left").withColumn("fragments", F.array_sort("fragments")).withColumn("regions", F.array_sort("regions"))
