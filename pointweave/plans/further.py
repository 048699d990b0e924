"""More registered queries, in the same form."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import connect, graph, metrics, pairs, sequence, sides, skeleton, spatial, stitch, versions
from pointweave.plans.queries import ORACLE_SQL, QUERIES, query, rounded, shared_pairs
from pointweave.sources import boxes, synapses, worlds
from pointweave.sources.scratch import Scratch
from pointweave.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("select root_base as root, root_target as n_pre, cast(0 as bigint) as n_post, root_target as total from v_smap", "v_smap")
def s10_degree_table(m):
    return synapses.degree_table(m.select(F.col("root_base").alias("PT_Root_ID"), F.col("root_target").alias("out_degree")))


@query("select id, label from v_xyz where x between 1000 and 8000 and y between 1000 and 8000 and z between 0 and 900", "v_xyz")
def f5_slice_box(p):
    inside, _ = sides.slice_box(p, None, (1000, 1000, 0), (8000, 8000, 900))
    return inside.select("id", "label")


def _hash_order(column: str) -> str:
    """SQL: ``hash_order`` of a long column with seed 0, that is Spark's XXH64 of the long and then of the seed, as a signed number."""
    two, p1, p2, p3, p4, p5 = (f"{n}::uhugeint" for n in (2**64, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turned = lambda x, r: f"(({x} * {2**r}::uhugeint) % {two} + {x} // {2**(64 - r)}::uhugeint)"
    times = lambda x, p: f"(({x}) * {p} % {two})"
    steps = [
        f"{times(f'(({column}::hugeint + {2**64}::hugeint) % {2**64}::hugeint)::uhugeint', p2)}",
        times(turned("h", 31), p1),
        f"xor(({42 + 8}::uhugeint + {p5}) % {two}, h)",
        f"({times(turned('h', 27), p1)} + {p4}) % {two}",
        *(mixed := [f"xor(h, h // {2**33}::uhugeint)", times("h", p2), f"xor(h, h // {2**29}::uhugeint)", times("h", p3), f"xor(h, h // {2**32}::uhugeint)"]),
        f"(h + {p5} + 4::uhugeint) % {two}",
        f"({times(turned('h', 23), p2)} + {p3}) % {two}",
        *mixed,
        f"case when h >= {2**63}::uhugeint then h::hugeint - {2**64}::hugeint else h::hugeint end",
    ]
    sql = f"(select distinct {column} as k, {steps[0]} as h from v_obs)"
    for step in steps[1:]:
        sql = f"(select k, {step} as h from {sql})"
    return sql


@query(f"select syn_id, count(*) as sides from v_obs where syn_id in (select k from {_hash_order('syn_id')} order by h, k limit 1000000) group by 1", "v_obs")
def f6_capped(p):
    return sides.capped(p, 1_000_000).groupBy("syn_id").agg(F.count("*").alias("sides"))


@query("select id, x - 50 as lo_x, x + 50 as hi_x, y - 60 as lo_y, y + 60 as hi_y, z - 70 as lo_z, z + 70 as hi_z from v_xyz", "v_xyz")
def f8_boxes(p):
    return sides.box_around(p, (50.0, 60.0, 70.0)).select("id", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z")


@query(
    "select id from v_xyz a where sqrt(pow(greatest(4000 - x, x - 6000, 0), 2) + pow(greatest(4000 - y, y - 6000, 0), 2) + pow(greatest(0 - z, z - 997, 0), 2)) > 500 and seg not in (select seg from v_xyz where label = 7 and seg > 0)",
    "v_xyz",
)
def f16_seam_guard(p):
    return sides.without_seam(p, p.where("label = 7"), (4000, 4000, 0), (6000, 6000, 997), 500.0).select("id")


@query("select id, round(1 / (1 + exp(-(p - 0.5) / 2)), 6) as prob, round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) as odds from v_score", "v_score")
def f18_sigmoid(s):
    return rounded(s.select("id", C.sigmoid(F.col("p") - 0.5, 2.0).alias("prob"), C.log_odds("p").alias("odds")))


@query("select a.id, b.root_target is not null as known, coalesce(cast(b.root_target as double), 0) as first_value from v_obs a left join v_smap b on a.seg + 1 = b.root_base", "v_obs", "v_smap")
def j3_embedding_lookup(o, m):
    dna = m.select((F.col("root_base") - 1).alias("seg"), F.array(F.col("root_target").cast("float"), F.lit(1.0).cast("float")).alias("dna"))
    out = versions.with_embedding(o, dna, 2)
    return out.select("id", (F.col("dna")[1] == 1).alias("known"), F.col("dna")[0].cast("double").alias("first_value"))


@query("select a.id as src, b.id as dst from v_xyz a join v_xyz b on a.seg = b.seg and a.id <> b.id where a.seg > 0", "v_xyz")
def j8_same_segment_pairs(p):
    return spatial.same_segment_pairs(p)


@query(
    "with c as (select seg as id, avg(x) as x, avg(y) as y, avg(z) as z from v_xyz where seg <> 0 group by 1), s as (select a.id as a, b.id as b, 1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 150 as s from c a join c b on a.id < b.id where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 150) select least(p.id, q.id) as src, greatest(p.id, q.id) as dst, round(max(s), 6) as score from s join v_xyz p on p.seg = s.a join v_xyz q on q.seg = s.b group by 1, 2",
    "v_xyz",
)
def j12_group_scores(p):
    return spatial.group_scores(p, 150.0, F.round(1 - F.col("d") / 150.0, 6) + 0.0)  # rounded once for two groups, not for each pair of members


@query("select m.root_target as root_id, count(distinct s.nucleus_id) as somata from v_soma s join v_smap m on s.nucleus_id + 1 = m.root_base where m.root_target <> 0 group by 1", "v_soma", "v_smap")
def j14_soma_counts(s, m):
    return versions.soma_counts(s.select("nucleus_id", (F.col("nucleus_id") + 1).alias("sv")), m.select(F.col("root_base").alias("sv"), F.col("root_target").alias("root")))


@query("select p.root_base as root_id, s.x as done from v_smap p left join v_soma s on p.root_base = s.root_id", "v_smap", "v_soma")
def j16_proofread_status(m, s):
    return versions.with_proofread_status(m.select(F.col("root_base").alias("root_id")), s.select("root_id", F.col("x").alias("done")))


@query(
    "with e as (select seg as edit_id, case when seg % 2 = 0 then 'merge' else 'split' end as op, seg as a, seg + 1 as b from v_obs group by seg), k as (select seg, syn_id from v_obs) select e.edit_id, case when op = 'merge' then 1 else 0 end as together, x.syn_id as a, y.syn_id as b from e join k x on e.a = x.seg join k y on e.b = y.seg",
    "v_obs",
)
def j21_edit_pairs(o):
    e = o.select(F.col("seg").alias("edit_id")).distinct()
    both = F.array(F.col("edit_id"), F.col("edit_id") + 1)
    edits = e.select("edit_id", F.when(F.col("edit_id") % 2 == 0, "merge").otherwise("split").alias("op"), both.alias("before"), both.alias("after"))
    return versions.edits_to_pairs(edits, o, 1_000_000_000)


@query("select id as root, cast(least(floor(x / 2501.75), 3) * 4 + least(floor(y / 2493.25), 3) as bigint) as cell from v_xyz where id <> 0", "v_xyz")
def j23_stratified_roots(p):
    picked = pairs.stratified_roots(p.withColumnRenamed("id", "root"), (0, 0, 0), (10007, 9973, 997), (4, 4, 1), 1_000_000_000)
    return picked.select("root", F.col("cell").cast("long").alias("cell"))


@query("select o.id, min(coalesce(case when o.cluster >= 0 then o.cluster end, -1)) as cluster from v_obs o group by 1", "v_obs")
def j33_global_labels(o):
    tile = (F.col("id") % 4).alias("tile_id")
    supers = o.where("cluster >= 0").select((F.col("cluster") * 4 + F.col("id") % 4).alias("super_id"), tile, F.col("id").alias("key"), "cluster")
    return stitch.global_labels(o.select("id", F.col("id").alias("key"), tile), supers.select("super_id", "tile_id", "key"), supers.select("super_id", "cluster").distinct())


@query("select case when s.p >= 0.5 and s.y = 1 then 'tp' when s.p >= 0.5 then 'fp' when s.y = 1 then 'fn' else 'tn' end as kind, count(*) as n from v_score s group by 1", "v_score")
def a24_sampled_f1(s):
    r = metrics.sampled_pairs_f1(s.select((F.col("y") == 1).alias("true"), (F.col("p") >= 0.5).alias("pred")))
    total = s.agg(F.count("*").alias("all"))
    one = r.crossJoin(total).select(F.expr("stack(4, 'tp', tp, 'fp', fp, 'fn', fn, 'tn', all - tp - fp - fn) as (kind, n)"))  # one row each
    return one.where("n > 0")


@query(
    "with c as (select cluster, label, count(*) as n from v_obs where cluster <> 0 and label <> 0 group by 1, 2), b as (select cluster, label as called from (select *, row_number() over (partition by cluster order by n desc, label) as k from c) where k = 1), d as (select partner as cluster, seg % 9 as label, count(*) as n from v_obs where partner <> 0 and seg % 9 <> 0 group by 1, 2), e as (select cluster, label as called from (select *, row_number() over (partition by cluster order by n desc, label) as k from d) where k = 1), j as (select o.label, o.seg % 9 as l2, coalesce(b.called, 0) as c1, coalesce(e.called, 0) as c2 from v_obs o left join b on o.cluster = b.cluster left join e on o.partner = e.cluster) select count(*) as n_syn, round(sum(case when label = c1 and l2 = c2 then 1 else 0 end) / count(*), 6) as attribution_accuracy from j where label <> 0 and l2 <> 0",
    "v_obs",
)
def a27_dual_accuracy(o):
    post = o.select("syn_id", F.col("partner").alias("cluster"), (F.col("seg") % 9).alias("label"))
    return rounded(connect.dual_accuracy(o.select("syn_id", "cluster", "label"), post).select("n_syn", "attribution_accuracy"))


@query("select min(x) - 5 as lo_x, max(x) + 5 as hi_x, min(y) - 5 as lo_y, max(y) + 5 as hi_y, min(z) - 5 as lo_z, max(z) + 5 as hi_z from v_xyz", "v_xyz")
def a51_bounding_box(p):
    return synapses.bounding_box(p, 5.0)


@query(
    "select gap, margin, cos, cast(sum(case when p * 10 <= gap and y + 0.5 >= margin and p >= cos then 1 else 0 end) as bigint) as accepted, cast(sum(case when p * 10 <= gap and y + 0.5 >= margin and p >= cos and y = 1 then 1 else 0 end) as bigint) as \"right\", cast(sum(case when p * 10 <= gap and y + 0.5 >= margin and p >= cos then stratum else 0 end) as bigint) as mass from v_score, (select cast(5 as double) as gap union all select 10), (select cast(0 as double) as margin union all select 1), (select cast(0.2 as double) as cos union all select cast(0.6 as double)) group by 1, 2, 3",
    "v_score",
)
def a41_acceptance_sweep(s):
    panel = s.select((F.col("p") * 10).alias("g1"), (F.col("y") + 0.5).alias("ratio"), F.col("p").alias("cosine"), (F.col("y") == 1).alias("right"), F.col("stratum").alias("n_obs"))
    return metrics.acceptance_sweep(panel, [5, 10], [0, 1], [0.2, 0.6]).drop("precision").withColumn("cos", F.col("cos"))


@query(
    "select gate, count(*) as n, cast(sum(case when p = 1 then 1 else 0 end) as bigint) as pure, round(avg(p), 6) as purity, round(sum(p * stratum) / sum(stratum), 6) as mass_purity, cast(sum(stratum) as bigint) as mass from (select 'all' as gate, p, stratum from v_score union all select 'large', p, stratum from v_score where stratum >= 4) group by 1",
    "v_score",
)
def a42_scaffold_census(s):
    return rounded(metrics.scaffold_census(s.select(F.col("p").alias("purity"), F.col("stratum").alias("n_obs")), {"all": "true", "large": "n_obs >= 4"}))


@query(
    "with z as (select stratum as site, case when stddev_pop(p) over w > 0 then (p - avg(p) over w) / stddev_pop(p) over w else 0 end as z, y from v_score window w as (partition by stratum)), r as (select site, z, y, row_number() over (partition by site order by round(z, 9) desc, y desc) as k from z) select site, round(z, 6) as z, y = 1 as top_right from r where k = 1",
    "v_score",
)
def a45_panel(s):
    return rounded(metrics.panel_scores(s.select(F.col("stratum").alias("site"), F.col("p").alias("score"), (F.col("y") == 1).alias("right")))).select("site", "z", "top_right")


@query(
    "select threshold, cast(sum(case when p >= threshold then 1 else 0 end) as bigint) as proposed, cast(sum(case when p >= threshold then y * 2 - 1 else 0 end) as double) as net_pairs from v_score, (select cast(range as double) / 10 as threshold from range(1, 10)) group by 1",
    "v_score",
)
def a49_correction_gain(s):
    return metrics.correction_gain(s.select(F.col("p").alias("score"), (F.col("y") * 2 - 1).alias("gain"))).select("threshold", "proposed", "net_pairs")


@query("select cluster % 4 as tile_id, cluster as cluster_id, count(*) as n_obs, count(distinct seg) as n_atoms, max(case when label = 7 then 1 else 0 end) = 1 as has_soma from v_obs where cluster >= 0 group by 1, 2", "v_obs")
def a47_super_fragments(o):
    parts = o.select((F.col("cluster") % 4).alias("tile_id"), "cluster", F.col("id").alias("key"), F.col("seg").alias("atom"), "label", (F.col("label") == 7).alias("has_soma"), F.array(F.lit(1.0), F.col("value")).alias("dna"))
    supers, _ = stitch.super_fragments(parts)
    return supers.select("tile_id", "cluster_id", "n_obs", "n_atoms", "has_soma")


@query("select cluster, count(distinct syn_id) as n_syn, count(distinct seg) as n_fragments from v_obs group by 1", "v_obs")
def a46_hypotheses(o):
    members = o.select("cluster", F.col("seg").alias("frag_id"), "syn_id", (F.col("seg") % 3).alias("region_id"), F.array("value").alias("dna"))
    return stitch.hypotheses(members).select("cluster", "n_syn", F.size("fragments").cast("long").alias("n_fragments"))


@query("select seg, label, count(*) as n from v_obs where seg <> 0 and label <> 0 group by 1, 2", "v_obs")
def s19_seg_label(o):
    return worlds.seg_label(o)


@query(
    "select cast(floor(x / 2000) as bigint) + 5 * cast(floor(y / 2000) as bigint) as box_id, id from v_xyz where x < 10000 and y < 10000 and (x % 2000 <> 0 or x = 0) and (y % 2000 <> 0 or y = 0)",
    "v_xyz",
)
def s11_box_members(p):
    grid = boxes.box_grid((0, 0, 0), (10000, 10000, 2000), 2000.0, p.sparkSession)
    held = boxes.members(grid, p, 2000.0).where("x % 2000 <> 0 or x = 0").where("y % 2000 <> 0 or y = 0")
    return held.select("box_id", "id")


@query("select root, cast(sum(case when k = 0 then 1 else 0 end) as bigint) as n_pre, cast(sum(case when k = 1 then 1 else 0 end) as bigint) as n_post from (select user_id as root, 0 as k from events union all select event_id % 23, 1 from events) where root <> 0 group by 1", "v_obs")
def r1_running_counts(o):
    return jobs.root_counts(o, "seg", "partner")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.as_stream(spark, f"{folder}/events.parquet*", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", 1000)


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    return jobs.landed(stream, Scratch(stream.sparkSession, f"{name}-{uuid4().hex}").path("rows"), mode)


def r1_stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from the events as a stream."""
    return _drained(jobs.root_counts(_events(spark, folder).selectExpr("user_id as pre_root", "event_id % 23 as post_root")), "r1", "complete")


def r4_stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind, from a stream with a watermark."""
    edits = _events(spark, folder).selectExpr("ts", "event_type as op")
    return _drained(jobs.edit_rates(edits, "1 day", "30 days"), "r4", "complete").select(F.unix_timestamp("start").alias("start"), "op", "n")


QUERIES |= {"r1_stream_counts": r1_stream_counts, "r4_stream_rates": r4_stream_rates}
ORACLE_SQL["r1_stream_counts"] = ORACLE_SQL["r1_running_counts"]
ORACLE_SQL["r4_stream_rates"] = "select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as start, event_type as op, count(*) as n from events group by 1, 2"


@query("with s as (select seg as g, id, x, y, z, row_number() over (partition by seg order by id) - 1 as pos, count(*) over (partition by seg) as n from v_xyz) select g as \"group\", start, pos - start as k, x, z from (select *, unnest([pos // 4 * 4, pos // 4 * 4 - 4]) as start from s) where start >= 0 and start + 8 <= n", "v_xyz")
def v6_windows(p):
    rows = p.select(F.col("seg").alias("group"), (F.row_number().over(W.partitionBy("seg").orderBy("id")) - 1).alias("pos"), "x", "y", "z")
    return sequence.windows(rows, 8).select("group", "start", F.col("k").cast("long").alias("k"), "x", "z")


@query("select src, dst, p from v_edge where p between 0.4 and 0.6 order by abs(p - 0.5), src, dst, p limit 30", "v_edge")
def t3_boundary_edges(e):
    return graph.boundary_edges(e, 0.4, 0.6, 30).select("src", "dst", "p")


@query(
    f"with r as (select cast(id % 5 as bigint) as g, id, cust as pp, id % 997 as pq, cust % 700 as tp, (id * 11) % 811 as tq from v_part), e as (select distinct g, a, b from {shared_pairs('r', 'pp', 'pq')}), y as (select distinct g, a, b from {shared_pairs('r', 'tp', 'tq')}), j as (select coalesce(e.g, y.g) as g, case when e.a is null then 0 else 1 end as e, case when y.a is null then 0 else 1 end as y from e full join y on e.a = y.a and e.b = y.b), f as (select g, 2 * sum(e * y) / (sum(e) + sum(y)) as f from j group by 1) select 'or' as variant, round(avg(f), 6) as mean_f1, round(quantile_cont(f, 0.5), 6) as median_f1 from f",
    "v_part",
)
def a44_seg_baseline(r):
    rows = r.selectExpr("id % 5 as box_id", "cust as pre_seg", "id % 997 as post_seg", "cust % 700 as pre_root", "(id * 11) % 811 as post_root")
    return rounded(metrics.seg_baseline(rows).where("variant = 'or'"))


def _trees(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each segment's points in a chain by id, as a skeleton."""
    v = p.select(F.col("seg").alias("frag_id"), F.col("id").alias("vid"), "x", "y", "z", (F.col("id") % 50 + 50.0).alias("r"))
    e = v.withColumn("v", F.lead("vid").over(W.partitionBy("frag_id").orderBy("vid"))).where("v is not null").select("frag_id", F.col("vid").alias("u"), "v")
    return v, e


@query(
    "with s as (select seg, id, x, y, z, sqrt(pow(x - lead(x) over w, 2) + pow(y - lead(y) over w, 2) + pow(z - lead(z) over w, 2)) as l from v_xyz window w as (partition by seg order by id)) select seg as frag_id, count(*) as n_vertices, round(coalesce(sum(l), 0), 6) as cable, cast(0 as bigint) as branches, cast(case when count(*) > 1 then 2 else 0 end as bigint) as tips, cast(1 as bigint) as components, true as is_tree from s group by 1",
    "v_xyz",
)
def g6_shape(p):
    return rounded(skeleton.shape(*_trees(p))).select("frag_id", "n_vertices", "cable", "branches", "tips", "components", "is_tree")


@query(
    "with s as (select seg, id, sqrt(pow(x - lead(x) over w, 2) + pow(y - lead(y) over w, 2) + pow(z - lead(z) over w, 2)) as l from v_xyz window w as (partition by seg order by id)), m as (select seg, quantile_cont(l, 0.5) as m from s where l is not null group by 1) select s.seg as frag_id, cast(sum(case when l > greatest(5000, 1.2 * m) then 1 else 0 end) as bigint) as n_odd, cast(1 as bigint) as components, sum(case when l > greatest(5000, 1.2 * m) then 1 else 0 end) > 0 as odd from s join m on s.seg = m.seg group by 1",
    "v_xyz",
)
def g8_oddness(p):
    return skeleton.oddness(*_trees(p), factor=1.2)


@query("with d as (select seg, count(*) as n from v_xyz group by 1) select seg as frag_id, 2 as degree, cast(n - 2 as bigint) as n from d where n > 2 union all select seg, 1, 2 from d", "v_xyz")
def g5_degrees(p):
    return skeleton.degrees(*_trees(p)).groupBy("frag_id", F.col("degree").cast("int").alias("degree")).agg(F.count("*").alias("n"))


@query(None, "v_edge")
def g10_spanning_forest(e):
    return graph.spanning_forest(e.select("src", "dst", (F.col("p") + F.col("src") / 1e6 + F.col("dst") / 1e9).alias("w")))


@query("with s as (select seg, id, sqrt(pow(x - lead(x) over w, 2) + pow(y - lead(y) over w, 2) + pow(z - lead(z) over w, 2)) as l from v_xyz window w as (partition by seg order by id)) select seg as frag_id, round(sum(l), 4) as length from s group by 1", "v_xyz")
def g7_diameter(p):
    return rounded(skeleton.diameter(*_trees(p)), 4).select("frag_id", "length")
