"""Registered queries: each operator over whole tables, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import connect, graph, metrics, pairs, risk, sequence, sides, spatial, stitch, versions
from pointweave.plans.views import view, with_views
from pointweave.sources import synapses as syn
from pointweave.sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of the named views under its own name."""

    def register(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(*[view(spark, folder, v) for v in views])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums can't show; no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Sources and filters


@query("select id, x, y, z from v_xyz where x between 1000 and 6000 and y between 0 and 5000 and z between 100 and 900", "v_xyz")
def s1_region_scan(p):
    return syn.region_scan(p, (1000, 0, 100), (6000, 5000, 900), columns=["id", "x", "y", "z"])


@query("select id, cast(case when x >= 10000 then 4 else floor(x / 2000) end as int) as tile from v_xyz where x < 10008", "v_xyz")
def s3_x_tiles(p):
    return syn.with_tile(p, 0.0, 10000.0, 5).select("id", "tile")


@query("select id, min(x) as x, cast(min(t) as int) as tile from (select id, x, 0 as t from v_xyz where x <= 6000 union all select id, x, 1 from v_xyz where x >= 4000) group by id", "v_xyz")
def s3_tiled_dedup(p):
    first, second = p.where("x <= 6000").withColumn("tile", F.lit(0)), p.where("x >= 4000").withColumn("tile", F.lit(1))
    return syn.tiled_scan([first, second], "id").select("id", "x", "tile")


@query("select box_id, pre_root, post_root from v_pair where pre_root % 10 = 3 or (post_root - 1000000) % 10 = 3", "v_pair")
def s4_touching_roots(p):
    rows = p.withColumn("syn_id", F.monotonically_increasing_id())
    roots = connect.roots_of(p).where("(root < 1000000 and root % 10 = 3) or (root > 1000000 and (root - 1000000) % 10 = 3)")
    held = Scratch(p.sparkSession, "touching").write(rows, "rows")  # ids must not change between the two joins
    return syn.touching(held, roots).select("box_id", "pre_root", "post_root")


@query("select distinct root_id from v_soma where x between 0 and 5000 and y between 0 and 8000 and z between 0 and 900", "v_soma")
def s5_roots_in_box(s):
    return syn.roots_in_box(s, (0, 0, 0), (5000, 8000, 900))


@query("select cell_type, count(*) as n from v_type group by 1", "v_type")
def a52_type_census(t):
    return syn.type_census(t)


@query("select id, x * 4 as x_nm, z * 40 as z_nm from v_xyz", "v_xyz")
def f1_voxels_to_nm(p):
    return p.select("id", C.to_nm("x", 4).alias("x_nm"), C.to_nm("z", 40).alias("z_nm"))


@query(
    "select syn_id, 0 as side, seg, label from (select syn_id, seg, label from v_obs where seg > 0) union all select syn_id, 1 as side, partner as seg, cluster + 1 as label from v_obs where partner > 0",
    "v_obs",
)
def f2_long_sides(o):
    wide = o.select("syn_id", F.col("seg").alias("pre_seg"), F.col("label").alias("pre_root"), F.col("partner").alias("post_seg"), (F.col("cluster") + 1).alias("post_root"))
    return sides.sides(wide).withColumn("side", F.col("side").cast("int"))


@query(
    "with c as (select r, count(*) as n from (select pre_root as r from v_pair union all select post_root from v_pair) group by 1 having count(*) >= 30) select pre_root, post_root, count(*) as n from v_pair where pre_root in (select r from c) and post_root in (select r from c) group by 1, 2",
    "v_pair",
)
def f3_clutter_filter(p):
    return sides.clutter_filter(p, 30).groupBy("pre_root", "post_root").agg(F.count("*").alias("n"))


@query("select o.syn_id, o.seg, o.label from v_obs o join (select seg from v_obs where seg > 0 and label > 0 group by seg having count(*) >= 9) k on o.seg = k.seg where o.label > 0", "v_obs")
def f4_sliver_filter(o):
    return sides.sliver_filter(o, 9).select("syn_id", "seg", "label")


@query("select o.syn_id from v_obs o join (select seg, side from v_obs where seg <> 0 and label <> 0 group by 1, 2 having count(*) >= 5) k on o.seg = k.seg and o.side = k.side where o.label <> 0", "v_obs")
def f22_half_partitions(o):
    return sides.half_partitions(o, 5).select("syn_id")


@query(
    "with c as (select id, cast(floor(x / 500) as bigint) as bx, cast(floor(y / 800) as bigint) as byy from v_xyz), e as (select min(bx) as x0, max(bx) as x1, min(byy) as y0 from c) select id, (byy - y0) * (x1 - x0 + 1) + bx - x0 as bin from c, e",
    "v_xyz",
)
def f9_xy_bins(p):
    return sides.xy_bins(p, 500.0, 800.0).select("id", "bin")


@query(
    "with c as (select id, cast(floor(x / 2000) as bigint) as bin from v_xyz), d as (select distinct bin from c), m as (select quantile_cont(bin, 0.5) as m from d) select id, case when bin > m then 'test' else 'train' end as split from c, m",
    "v_xyz",
)
def f10_split_by_bin(p):
    return sides.split_by_bin(p.withColumn("bin", F.floor(F.col("x") / 2000))).select("id", "split")


@query("select id, (cast(round_even(x / 16, 0) as bigint) * 1000003 + cast(round_even(y / 16, 0) as bigint)) * 1000003 + cast(round_even(z / 16, 0) as bigint) as key from v_xyz", "v_xyz")
def f11_stable_key(p):
    return p.select("id", C.stable_key("x", "y", "z").alias("key"))


@query("select o.syn_id, o.cluster, round(1.0 / n, 6) as weight from v_obs o join (select label, count(distinct cluster) as n from v_obs group by 1) k on o.label = k.label", "v_obs")
def f12_overlap_weights(o):
    return rounded(sides.overlap_weights(o, "cluster", "label").select("syn_id", "cluster", "weight"))


@query(
    "with s as (select root_id % 5 as k, root_id, count(*) as n from v_soma group by 1, 2) select root_id, case when k = 1 then 'NAMED' when k >= 2 then 'MULTI' when n >= 1 then 'BIG-NOSOMA' else 'ANON' end as tier from s",
    "v_soma",
)
def f14_tiers(s):
    return s.groupBy("root_id").agg(F.count("*").alias("n")).select("root_id", C.tier_of(F.col("root_id") % 5, "n", 1).alias("tier"))


@query("select syn_id, case when seg = 0 then -syn_id else seg end as cluster from v_obs", "v_obs")
def f19_seg_partition(o):
    return sides.seg_partition(o.drop("cluster")).select("syn_id", "cluster")


# Versions


@query(
    "select pre, post, count(*) as n from (select coalesce(a.root_target, 0) as pre, coalesce(b.root_target, 0) as post from v_pair p left join v_smap a on p.pre_root = a.root_base left join v_map b on p.post_root = b.root_base) where pre <> 0 and post <> 0 group by 1, 2",
    "v_pair",
    "v_smap",
    "v_map",
)
def j1_root_remap(p, s, m):
    return versions.remap(p, s.unionByName(m)).groupBy(F.col("pre_root").alias("pre"), F.col("post_root").alias("post")).agg(F.count("*").alias("n"))


@query(
    "select e.id, coalesce((select arg_max(l.id, l.id) from v_obs l where l.seg = e.seg and l.id <= e.id - 5), 0) as root from v_obs e",
    "v_obs",
)
def j2_root_as_of(o):
    lineage = o.select(F.col("seg").alias("sv"), F.col("id").alias("root"), F.col("id").alias("ts"))
    asked = o.select("id", F.col("seg").alias("sv"), (F.col("id") - 5).alias("at"))
    return versions.root_as_of(asked, lineage).select("id", "root")


@query("select label, seg, count(*) as n from v_obs where label <> 0 and seg <> 0 group by 1, 2", "v_obs")
def a11_fragment_breakdown(o):
    return versions.fragment_breakdown(o)


@query("select n_segs, count(*) as n_labels from (select label, count(distinct seg) as n_segs from v_obs where label <> 0 and seg <> 0 group by 1) group by 1", "v_obs")
def a48_fragmentation(o):
    return versions.fragmentation(o)


@query(
    "with d as (select distinct seg, label from v_obs where seg <> 0 and label <> 0) select (select count(*) from v_obs) as n_sides, (select count(*) from v_obs where label <> 0) as labelled_sides, (select count(distinct seg) from d) as n_segs, (select count(*) from (select seg from d group by 1 having count(*) > 1)) as split_segs, (select count(distinct label) from d) as n_labels, (select count(*) from (select label from d group by 1 having count(*) > 1)) as merge_targets",
    "v_obs",
)
def a12_edit_summary(o):
    return versions.edit_summary(o)


@query(
    "with k as (select root_target, count(*) as n from v_map where root_target <> 0 group by 1) select * from (select 'total' as kind, cast(0 as bigint) as key, count(*) as n from v_map union all select 'survived', 0, count(*) from v_map where root_target <> 0 union all select 'lost', 0, count(*) from v_map where root_target = 0 union all select 'in_degree', least(n, 41), count(*) from k group by 2) union all select * from (select 'merge' as kind, root_target as key, n from k order by n desc, root_target limit 5)",
    "v_map",
)
def a13_remap_report(m):
    return versions.remap_report(m, top=5, bins=40)


_FINE = "select syn_id % 300 as seg, case when syn_id % 300 < 100 then syn_id % 300 + 1 else (syn_id % 300) // 3 + 200 end as label, case when syn_id % 300 % 5 = 0 then syn_id % 300 + 500 else (syn_id % 300) % 17 end as cluster from v_obs"


def _fine(o: DataFrame) -> DataFrame:
    s = F.col("syn_id") % 300
    return o.select(s.alias("seg"), F.when(s < 100, s + 1).otherwise(F.floor(s / 3) + 200).alias("label"), F.when(s % 5 == 0, s + 500).otherwise(s % 17).alias("cluster"))


@query(
    f"with f as ({_FINE}), d as (select distinct seg, label from f where seg <> 0 and label <> 0), nl as (select label, count(*) as n from d group by 1) select seg, count(*) = 1 and max(n) = 1 as complete from d join nl on d.label = nl.label group by seg",
    "v_obs",
)
def a14_completeness_true(o):
    return versions.completeness_true(_fine(o))


@query(
    f"with f as ({_FINE}), d as (select distinct seg, cluster from f where seg <> 0 and cluster <> -1), nl as (select cluster, count(*) as n from d group by 1) select seg, count(*) = 1 and max(n) = 1 as complete from d join nl on d.cluster = nl.cluster group by seg",
    "v_obs",
)
def a15_completeness_pred(o):
    return versions.completeness_pred(_fine(o))


@query(
    f"with f as ({_FINE}), d as (select distinct seg, label from f where seg <> 0), nl as (select label, count(*) as n from d group by 1), t as (select seg, count(*) = 1 and max(n) = 1 as c from d join nl on d.label = nl.label group by seg), e as (select distinct seg, cluster from f where seg <> 0), ne as (select cluster, count(*) as n from e group by 1), p as (select seg, count(*) = 1 and max(n) = 1 as c from e join ne on e.cluster = ne.cluster group by seg), b as (select t.c as t, p.c as p from t join p on t.seg = p.seg), s as (select count(*) as n, sum(case when t and p then 1 else 0 end) as tp, sum(case when not t and p then 1 else 0 end) as fp, sum(case when t and not p then 1 else 0 end) as fn, sum(case when not t and not p then 1 else 0 end) as tn from b) select n, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn, round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round((tp + tn) / n, 6) as accuracy, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from s",
    "v_obs",
)
def a16_completeness_scores(o):
    f = _fine(o)
    return rounded(versions.completeness_scores(versions.completeness_true(f), versions.completeness_pred(f)))


_LINKS = "(select distinct seg, label from v_obs where seg <> 0 and label <> 0)"


@query(f"select 'false_split' as kind, a.label as \"group\", a.seg as a, b.seg as b from {_LINKS} a join {_LINKS} b on a.label = b.label and a.seg < b.seg union all select 'false_merge', a.seg, a.label, b.label from {_LINKS} a join {_LINKS} b on a.seg = b.seg and a.label < b.label", "v_obs")
def j22_edit_pairs(o):
    return versions.edit_pairs(o)


@query(
    "with c as (select seg, label, count(*) as n from v_obs where seg <> 0 and label <> 0 group by 1, 2) select seg, cast(sum(n) as bigint) as n, count(*) as n_labels, cast(sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) as bigint) as error from c group by 1 having sum(n) >= 9 and count(*) > 1",
    "v_obs",
)
def a53_correctable(o):
    return versions.correctable(o, 9)


# Connectomes


@query(
    "with s as (select pre_root as root, 1 as a, 0 as b from v_pair union all select post_root, 0, 1 from v_pair) select s.root, cast(sum(a) as bigint) as n_pre, cast(sum(b) as bigint) as n_post, cast(sum(a + b) as bigint) as total, max(case when m.root_id is null then 0 else 1 end) = 1 as has_soma from s left join (select distinct root_id from v_soma) m on s.root = m.root_id group by 1",
    "v_pair",
    "v_soma",
)
def a1_synapse_counts(p, s):
    return connect.synapse_counts(p, somata=s)


@query("select root, total from (select root, count(*) as total from (select pre_root as root from v_pair union all select post_root from v_pair) group by 1) order by total desc, root limit 50", "v_pair")
def t2_top_roots(p):
    return connect.top_roots(connect.synapse_counts(p), 50).select("root", "total")


@query(
    "select m.root_target as root, cast(sum(case when s.k = 0 then 1 else 0 end) as bigint) as n_pre, cast(sum(case when s.k = 1 then 1 else 0 end) as bigint) as n_post, count(*) as total from (select pre_root as root, 0 as k from v_pair union all select post_root, 1 from v_pair) s join v_map m on s.root = m.root_base where m.root_target <> 0 group by 1",
    "v_pair",
    "v_map",
)
def a2_remapped_degrees(p, m):
    return connect.degrees_after_remap(connect.synapse_counts(p), m)


@query("select pre_root as pre, post_root as post, count(*) as n_syn from v_pair where pre_root > 0 and post_root > 0 and pre_root <> post_root group by 1, 2", "v_pair")
def a3_directed_edges(p):
    return connect.directed_edges(p)


@query("select cluster as pre, partner as post, count(*) as n_syn from v_obs where cluster <> 0 and partner <> 0 group by 1, 2", "v_obs")
def a4_connectome(o):
    return connect.connectome(o, "cluster", "partner")


@query(
    "with d as (select cluster as pre, partner as post, count(*) as n from v_obs where cluster <> 0 and partner <> 0 group by 1, 2) select least(pre, post) as a, greatest(pre, post) as b, cast(sum(n) as bigint) as n_syn from d where pre <> post group by 1, 2 having sum(n) >= 20",
    "v_obs",
)
def a5_undirected_edges(o):
    return connect.undirected_edges(connect.connectome(o, "cluster", "partner"), 20)


@query("select a.cluster as pre, b.partner as post, count(*) as n_syn from v_obs a join v_obs b on a.syn_id = b.syn_id where a.cluster >= 0 group by 1, 2", "v_obs")
def a6_cell_connectivity(o):
    return connect.cell_connectivity(o, o.select("syn_id", "cluster"), o.select("syn_id", F.col("partner").alias("cluster")))


@query(
    "select cast(sum(n * (n - 1) / 2) as bigint) as positive_pairs from (select count(*) as n from v_pair where pre_root <> 0 group by pre_root union all select count(*) from v_pair where post_root <> 0 group by post_root)",
    "v_pair",
)
def a7_positive_pairs(p):
    return connect.positive_pairs(p)


@query(
    "select cast(sum(case when a = 1 and b = 1 then 1 else 0 end) as bigint) as \"both\", cast(sum(case when b = 0 then 1 else 0 end) as bigint) as pre_only, cast(sum(case when a = 0 then 1 else 0 end) as bigint) as post_only from (select syn_id, max(case when seg > 20 then 1 else 0 end) as a, max(case when label > 20 then 1 else 0 end) as b from v_obs group by 1) where a + b > 0",
    "v_obs",
)
def j13_side_coverage(o):
    return connect.side_coverage(o.where("seg > 20"), o.where("label > 20"))


@query(
    "with c as (select cluster, label, count(*) as n from v_obs where cluster <> 0 and label <> 0 group by 1, 2), r as (select cluster, label, n, sum(n) over (partition by cluster) as size, row_number() over (partition by cluster order by n desc, label) as k from c) select cluster, label, n, cast(size as bigint) as size, round(n / size, 6) as purity from r where k = 1",
    "v_obs",
)
def a43_scaffold_purity(o):
    return rounded(connect.majority(o))


_CALLED = "c as (select cluster, label, count(*) as n from v_obs where cluster <> 0 and label <> 0 group by 1, 2), b as (select cluster, label as called from (select cluster, label, row_number() over (partition by cluster order by n desc, label) as k from c) where k = 1), m as (select o.*, coalesce(b.called, 0) as called from v_obs o left join b on o.cluster = b.cluster)"


@query(
    f"with {_CALLED}, t as (select distinct label as pre, partner as post from v_obs where label <> 0 and partner <> 0), p as (select distinct called as pre, partner as post from m where called <> 0 and partner <> 0), x as (select (select count(*) from t join p on t.pre = p.pre and t.post = p.post) as tp, (select count(*) from t) as nt, (select count(*) from p) as np) select (select count(*) from m where label <> 0 and cluster <> 0) as n_obs, round((select sum(case when called = label then 1 else 0 end) / count(*) from m where label <> 0 and cluster <> 0), 6) as attribution_accuracy, tp as directed_tp, np - tp as directed_fp, nt - tp as directed_fn, round(tp / np, 6) as directed_precision, round(tp / nt, 6) as directed_recall from x",
    "v_obs",
)
def a26_connectome_accuracy(o):
    return rounded(connect.connectome_accuracy(o)).select("n_obs", "attribution_accuracy", "directed_tp", "directed_fp", "directed_fn", "directed_precision", "directed_recall")


@query("select distinct root from (select pre_root as root from v_pair union all select post_root from v_pair)", "v_pair")
def u1_all_roots(p):
    return connect.roots_of(p)


@query(
    "with j as (select case when pre_root % 3 = 0 then 'NAMED' else 'ANON' end as pre_tier, case when post_root % 4 = 0 then 'MULTI' else 'ANON' end as post_tier from v_pair) select pre_tier, post_tier, count(*) as n, round(count(*) / (select count(*) from j), 6) as share from j group by cube (pre_tier, post_tier)",
    "v_pair",
)
def a40_tier_matrix(p):
    pre = p.select(F.col("pre_root").alias("root")).distinct().withColumn("tier", F.when(F.col("root") % 3 == 0, "NAMED").otherwise("ANON"))
    post = p.select(F.col("post_root").alias("root")).distinct().withColumn("tier", F.when(F.col("root") % 4 == 0, "MULTI").otherwise("ANON"))
    return rounded(connect.tier_matrix(p, pre, post))


# Metrics

_PAIR_SUMS = "select cast(coalesce(sum(n * (n - 1) / 2), 0) as double) as s"


@query(
    f"with r as (select pred, true_id from v_part where pred <> -1 and true_id <> 0), b as ({_PAIR_SUMS} from (select count(*) as n from r group by pred, true_id)), p as ({_PAIR_SUMS} from (select count(*) as n from r group by pred)), t as ({_PAIR_SUMS} from (select count(*) as n from r group by true_id)) select (select count(*) from r) as n_obs, b.s as \"both\", p.s as pred_pairs, t.s as true_pairs, round(b.s / p.s, 6) as \"precision\", round(b.s / t.s, 6) as recall, round(2 * b.s / (p.s + t.s), 6) as f1 from b, p, t",
    "v_part",
)
def a20_pairwise(r):
    return rounded(metrics.pairwise(r, true="true_id")).select("n_obs", "both", "pred_pairs", "true_pairs", "precision", "recall", "f1")


@query(
    f"with r as (select grp, pred, true_id from v_part where pred <> -1 and true_id <> 0), b as (select grp, sum(n * (n - 1) / 2) as s from (select grp, count(*) as n from r group by grp, pred, true_id) group by 1), t as (select grp, sum(n * (n - 1) / 2) as s from (select grp, count(*) as n from r group by grp, true_id) group by 1) select max(b.s / t.s) >= 0.9 as covered, round(max(b.s / t.s), 6) as best_recall from b join t on b.grp = t.grp",
    "v_part",
)
def a31_coverage_at_k(r):
    return rounded(metrics.coverage_at_k(r, "grp", pred="pred", true="true_id"))


@query(
    f"with r as (select pred, true_id as t from v_part where true_id <> 0), c as (select pred, t, count(*) as n from r group by 1, 2), a as (select pred, sum(n) as n from c group by 1), d as (select t, sum(n) as n from c group by 1), k as (select sum(n) as n from c), s as (select (select sum(n * (n - 1) / 2) from c) as b, (select sum(n * (n - 1) / 2) from a) as p, (select sum(n * (n - 1) / 2) from d) as q, (select n * (n - 1) / 2 from k) as w), h as (select (select -sum(d.n / k.n * ln(d.n / k.n)) from d, k) as ht, (select -sum(a.n / k.n * ln(a.n / k.n)) from a, k) as hp, (select -sum(c.n / k.n * ln(c.n / a.n)) from c join a on c.pred = a.pred, k) as htp, (select -sum(c.n / k.n * ln(c.n / d.n)) from c join d on c.t = d.t, k) as hpt) select cast(k.n as bigint) as n_obs, (select count(*) from a) as n_pred, (select count(*) from d) as n_true, round((b - p * q / w) / ((p + q) / 2 - p * q / w), 6) as ari, round(1 - htp / ht, 6) as homogeneity, round(1 - hpt / hp, 6) as completeness, round(2 * (1 - htp / ht) * (1 - hpt / hp) / ((1 - htp / ht) + (1 - hpt / hp)), 6) as v_measure from s, h, k",
    "v_part",
)
def a22_partition_scores(r):
    return rounded(metrics.partition_scores(r, true="true_id"))


def shared_pairs(rows: str, pre: str, post: str, by: str = "g") -> str:
    """SQL: pairs of rows (of one ``by``) that share the first id, and that share the second, none of them 0."""
    one = lambda c, k: f"select a.{by} as g, a.id as a, b.id as b, {k} as k from {rows} a join {rows} b on a.{by} = b.{by} and a.{c} = b.{c} and a.id < b.id where a.{c} <> 0"
    return f"({one(pre, 0)} union all {one(post, 1)})"


@query(
    f"with r as (select 0 as g, id, cust as pp, id % 997 as pq, cust % 700 as tp, (id * 11) % 811 as tq from v_part), e as {shared_pairs('r', 'pp', 'pq')}, y as {shared_pairs('r', 'tp', 'tq')}, es as (select a, b, max(case when k = 0 then 1 else 0 end) as p, max(k) as q from e group by 1, 2), ys as (select a, b, max(case when k = 0 then 1 else 0 end) as p, max(k) as q from y group by 1, 2), j as (select coalesce(es.p, 0) as ep, coalesce(es.q, 0) as eq, coalesce(ys.p, 0) as yp, coalesce(ys.q, 0) as yq from es full join ys on es.a = ys.a and es.b = ys.b), v as (select 'pre' as variant, ep as e, yp as y from j union all select 'post', eq, yq from j union all select 'or', greatest(ep, eq), greatest(yp, yq) from j union all select 'and', ep * eq, yp * yq from j), n as (select variant, cast(sum(e * y) as double) as tp, cast(sum(e * (1 - y)) as double) as fp, cast(sum(y * (1 - e)) as double) as fn from v group by 1) select variant, tp, fp, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as \"precision\", round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from n",
    "v_part",
)
def a23_line_graph(r):
    return rounded(metrics.line_graph(r.selectExpr("cust as pred_pre", "id % 997 as pred_post", "cust % 700 as true_pre", "(id * 11) % 811 as true_post")))


@query(
    "with j as (select a.label = b.label as y, a.cluster = b.cluster as e, etype = 0 as z from v_edge v join v_node a on v.src = a.node join v_node b on v.dst = b.node where a.label <> 0 and b.label <> 0), n as (select count(*) as n_edges, cast(sum(case when y and e then 1 else 0 end) as bigint) as tp, cast(sum(case when not y and e then 1 else 0 end) as bigint) as fp, cast(sum(case when y and not e then 1 else 0 end) as bigint) as fn, cast(sum(case when not y and not e then 1 else 0 end) as bigint) as tn, sum(case when z then 1 else 0 end) as z, sum(case when z and not y then 1 else 0 end) as zc, sum(case when z and not y and not e then 1 else 0 end) as zs from j) select n_edges, tp, fp, fn, tn, round(case when tp + fp = 0 then 1 else tp / (tp + fp) end, 6) as merge_precision, round(case when tp + fn = 0 then 1 else tp / (tp + fn) end, 6) as merge_recall, round(fp / n_edges, 6) as over_merge_rate, round(fn / n_edges, 6) as under_merge_rate, round(zc / z, 6) as frankenmerge_rate, round(zs / zc, 6) as frankenmerge_split_recall, round((select sum(case when cluster < 0 then 1 else 0 end) / count(*) from v_node), 6) as abstain_rate from n",
    "v_edge",
    "v_node",
)
def a21_edge_merge(e, n):
    return rounded(metrics.edge_merge(e, n)).drop("merge_f1")


@query(
    "with l as (select distinct seg, label from v_obs where seg <> 0 and label <> 0), k as (select distinct seg, cluster from v_obs where seg <> 0 and cluster <> -1), r as (select distinct cluster, label from k join l on k.seg = l.seg), fn as (select count(*) as n from l group by label), fc as (select count(*) as n from k group by cluster), cn as (select count(*) as n from r group by label) select (select count(distinct seg) from v_obs where seg <> 0) as n_fragments, (select count(distinct label) from v_obs where label <> 0) as n_neurons, (select count(distinct cluster) from v_obs where cluster <> -1) as n_clusters, (select count(*) from v_obs) as n_obs, (select count(*) from (select cluster from r group by 1 having count(*) > 1)) as false_merge_clusters, (select round(avg(n), 6) from fn) as frags_per_neuron_mean, (select round(quantile_cont(n, 0.5), 6) from fn) as frags_per_neuron_median, (select max(n) from fn) as frags_per_neuron_max, (select round(avg(n), 6) from fc) as frags_per_cluster_mean, (select round(quantile_cont(n, 0.5), 6) from fc) as frags_per_cluster_median, (select max(n) from fc) as frags_per_cluster_max, (select round(avg(n), 6) from cn) as clusters_per_neuron_mean, (select round(quantile_cont(n, 0.5), 6) from cn) as clusters_per_neuron_median, (select max(n) from cn) as clusters_per_neuron_max",
    "v_obs",
)
def a17_population(o):
    return rounded(metrics.population(o)).drop("merges_needed", "merges_predicted")


@query(
    "with c as (select grp as component, pred, true_id, count(*) as n from v_part group by 1, 2, 3), b as (select component, sum(n * (n - 1) / 2) as s, sum(n) as n from c group by 1), p as (select component, sum(n * (n - 1) / 2) as s from (select component, pred, sum(n) as n from c group by 1, 2) group by 1), t as (select component, sum(n * (n - 1) / 2) as s from (select component, true_id, sum(n) as n from c group by 1, 2) group by 1) select b.component, cast(b.n * (b.n - 1) / 2 as double) as pairs, cast(p.s + t.s - 2 * b.s as double) as wrong from b join p on b.component = p.component join t on b.component = t.component",
    "v_part",
)
def a25_rand_disagreement(r):
    return metrics.rand_disagreement(r.select(F.col("grp").alias("component"), "pred", F.col("true_id").alias("true")))


@query(
    "with m as (select seg, count(distinct label) as l from v_obs group by 1 having count(distinct label) > 1), x as (select distinct seg from (select seg, cluster from v_obs where cluster >= 0 group by 1, 2 having count(distinct label) > 1)) select count(*) as n_parents, cast(sum(case when x.seg is null then 1 else 0 end) as bigint) as n_separated, round(sum(case when x.seg is null then 1 else 0 end) / count(*), 6) as separation from m left join x on m.seg = x.seg",
    "v_obs",
)
def a29_franken_separation(o):
    return rounded(metrics.franken_separation(o, "seg"))


@query(
    "with c as (select box_id, k, r, count(*) as n from (select box_id, 0 as k, pre_root as r from v_pair union all select box_id, 1, post_root from v_pair) group by 1, 2, 3) select box_id, cast(sum(case when k = 0 then 1 else 0 end) as bigint) as n_pre_roots, cast(sum(case when k = 1 then 1 else 0 end) as bigint) as n_post_roots, max(n) as max_root_size, round(count(*) / (sum(n) / 2), 6) as root_density, round(sum(case when n > 1 then 1 else 0 end) / count(*), 6) as multi_root_fraction, round(100 * sum(case when n > 1 then 1 else 0 end) / (sum(n) / 2), 6) as tangledness from c group by 1",
    "v_pair",
)
def a8_tangledness(p):
    return rounded(metrics.tangledness(p))


@query("select side, count(*) as n_cells from (select distinct cast(side as double) as side, floor(x / side), floor(y / side), floor(z / side) from v_xyz, (select 500 as side union all select 2000)) group by 1", "v_xyz")
def a10_occupied_cells(p):
    return metrics.occupied_cells(p, [500, 2000])


@query(
    "with c as (select seg, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from v_xyz group by 1) select count(*) as n_groups, round(sum(case when least(x, y, z, 10007 - x, 9973 - y, 997 - z) <= 490 then 1 else 0 end) / count(*), 6) as clipped, round(sum(case when n = 1 then 1 else 0 end) / count(*), 6) as single, round(quantile_cont(n, 0.5), 6) as median_n, round(quantile_cont(n, 0.1), 6) as p10_n from c",
    "v_xyz",
)
def a19_boundary_clip(p):
    return rounded(metrics.boundary_clip(p, (0, 0, 0), (10007, 9973, 997), 490.0))


@query(
    "with b as (select cast(least(floor(p * 15), 14) as int) as bin, p, y from v_score), k as (select cast(range as int) as bin from range(15)) select k.bin, count(b.p) as n, round(avg(b.p), 6) as confidence, round(avg(b.y), 6) as accuracy from k left join b on k.bin = b.bin group by 1",
    "v_score",
)
def a33_reliability(s):
    return rounded(metrics.reliability(s))


@query("with b as (select count(*) as n, avg(p) as c, avg(y) as a from v_score group by least(floor(p * 15), 14)) select round(sum(n * abs(c - a)) / sum(n), 6) as ece from b", "v_score")
def a33_calibration_error(s):
    return rounded(metrics.calibration_error(s))


@query(
    "with d as (select stratum, p as s, cast(sum(y) as double) as a, cast(sum(1 - y) as double) as b from v_score group by 1, 2), r as (select stratum, a, b, coalesce(sum(b) over (partition by stratum order by s rows between unbounded preceding and 1 preceding), 0) as u from d) select stratum, round(sum(a * (u + b / 2)) / (sum(a) * sum(b)), 6) as auc from r group by 1",
    "v_score",
)
def a32_roc_auc(s):
    return rounded(metrics.roc_auc(s, "p", by=["stratum"]))


@query(
    "with t as (select range / 100.0 as threshold from range(101)), n as (select threshold, sum(case when p >= threshold and y = 1 then 1 else 0 end) as tp, sum(case when p >= threshold and y = 0 then 1 else 0 end) as fp, sum(case when p < threshold and y = 1 then 1 else 0 end) as fn from v_score, t group by 1) select round(threshold, 6) as threshold, cast(tp as bigint) as tp, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from n order by 2 * tp / (2 * tp + fp + fn) desc, threshold limit 1",
    "v_score",
)
def a32_best_f1(s):
    return rounded(metrics.best_f1_threshold(s, "p")).select("threshold", "tp", "f1")


# Risk


@query(
    "with b as (select src as obs, dst as other, p from v_edge union all select dst, src, p from v_edge), j as (select b.obs, max(case when n.cluster = m.cluster then p end) as i, max(case when n.cluster <> m.cluster then p end) as o from b join v_node n on b.obs = n.node join v_node m on b.other = m.node group by 1) select n.node as obs, n.cluster, round(coalesce(i, 0) - coalesce(o, 0), 6) as confidence from v_node n left join j on n.node = j.obs",
    "v_edge",
    "v_node",
)
def a36_confidence(e, n):
    return rounded(risk.confidence(e, n))


@query(
    "with b as (select src as obs, dst as other, p from v_edge union all select dst, src, p from v_edge), w as (select obs, cluster, sum(cast(p as decimal(20,10))) as w from b join v_node m on b.other = m.node group by 1, 2), t as (select obs, sum(w) as t from w group by 1) select w.obs, w.cluster, round(cast(w as double) / cast(t as double), 6) as p from w join t on w.obs = t.obs where t > 0",
    "v_edge",
    "v_node",
)
def a37_soft_membership(e, n):
    return rounded(risk.soft_membership(e, n))


def _decided(e: DataFrame, n: DataFrame) -> DataFrame:
    return risk.decisions(risk.confidence(e, n), risk.entropy(risk.soft_membership(e, n), n), 50)


_DECIDED = "b as (select src as obs, dst as other, p from v_edge union all select dst, src, p from v_edge), j as (select b.obs, max(case when n.cluster = m.cluster then p end) as i, max(case when n.cluster <> m.cluster then p end) as o from b join v_node n on b.obs = n.node join v_node m on b.other = m.node group by 1), w as (select obs, m.cluster, sum(p) as w from b join v_node m on b.other = m.node group by 1, 2), t as (select obs, sum(w) as t from w group by 1), h as (select w.obs, -sum(w / t * ln(w / t + 1e-9)) as h from w join t on w.obs = t.obs where t > 0 group by 1), c as (select n.node as obs, n.cluster, coalesce(i, 0) - coalesce(o, 0) as conf, coalesce(h.h, 0) / ln(50) as rs from v_node n left join j on n.node = j.obs left join h on n.node = h.obs), d as (select obs, cluster, greatest(0, -conf) as rm, rs, conf, 5 * greatest(0, -conf) + rs as loss, case when cluster < 0 then 'ABSTAIN' when conf > 0.3 then 'CONFIDENT_MERGE' when -conf > 0.15 then 'REVIEW_MERGE' when rs > 0.4 then 'REVIEW_SPLIT' else 'CONFIDENT_MERGE' end as action from c)"


@query(f"with {_DECIDED} select obs, cluster, round(rm, 6) + 0 as risk_merge, round(rs, 6) + 0 as risk_split, round(loss, 6) + 0 as expected_loss, action from d", "v_edge", "v_node")
def a38_decisions(e, n):
    return rounded(_decided(e, n)).select("obs", "cluster", "risk_merge", "risk_split", "expected_loss", "action")


@query(f"with {_DECIDED} select seg, count(*) as n_obs, round(avg(loss), 6) + 0 as mean_loss, round(max(loss), 6) + 0 as max_loss, cast(sum(case when action = 'CONFIDENT_MERGE' then 0 else 1 end) as bigint) as n_review from d join v_node n on d.obs = n.node group by 1", "v_edge", "v_node")
def a39_fragment_risk(e, n):
    return rounded(risk.fragment_risk(_decided(e, n), n.select(F.col("node").alias("obs"), "seg")))


@query(f"with {_DECIDED} select action, count(*) as n, round(count(*) / (select count(*) from d), 6) as share from d group by 1", "v_edge", "v_node")
def a39_risk_summary(e, n):
    return rounded(risk.risk_summary(_decided(e, n)))


@query(f"with {_DECIDED} select obs, action, round(loss, 6) + 0 as expected_loss from d where action <> 'CONFIDENT_MERGE' order by loss desc, obs limit 40", "v_edge", "v_node")
def t1_review_queue(e, n):
    return rounded(risk.review_queue(_decided(e, n), 40).select("obs", "action", "expected_loss"))


# Space

_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"select a.id as a, b.id as b, round({_DIST}, 6) as d from v_xyz a join v_xyz b on a.id < b.id where {_DIST} <= 300", "v_xyz")
def j7_radius_pairs(p):
    return rounded(spatial.self_radius_pairs(p, 300.0))


@query(f"with d as (select a.id as a, b.id as b, {_DIST} as d, row_number() over (partition by a.id order by {_DIST}, b.id) as k from v_xyz a join v_xyz b on a.id <> b.id) select a, b, round(d, 6) as d, cast(k as int) as rank from d where k <= 5", "v_xyz")
def j6_knn(p):
    return rounded(spatial.knn(p, p, 5, 250.0))


@query(f"with d as (select a.id as a, b.id as b, {_DIST} as d, row_number() over (partition by a.id order by {_DIST}, b.id) as k from v_xyz a join v_xyz b on a.seg = b.seg and a.id <> b.id) select a as id, round(avg(d), 6) as spacing from d where k <= 3 group by 1", "v_xyz")
def v11_local_density(p):
    return rounded(spatial.local_density(p, 3, 500.0))


@query(f"select a.seg, count(distinct b.nucleus_id) as somata from v_xyz a join v_soma b on {_DIST} <= 900 group by 1", "v_xyz", "v_soma")
def j5_somata_near(p, s):
    return spatial.somata_near(p, s.withColumnRenamed("nucleus_id", "id"), 900.0)


@query(
    "with b as (select seg, min(x) - 50 as x0, max(x) + 50 as x1, min(y) - 50 as y0, max(y) + 50 as y1, min(z) - 50 as z0, max(z) + 50 as z1, avg(x) as mx, avg(y) as my, avg(z) as mz from v_xyz group by 1), d as (select b.seg as frag_id, n.nucleus_id, sqrt((n.x - mx) * (n.x - mx) + (n.y - my) * (n.y - my) + (n.z - mz) * (n.z - mz)) as d from b join v_soma n on n.x between x0 and x1 and n.y between y0 and y1 and n.z between z0 and z1), r as (select *, row_number() over (partition by frag_id order by d, nucleus_id) as k from d) select frag_id, nucleus_id, round(d, 6) as d from r where k = 1",
    "v_xyz",
    "v_soma",
)
def j4_nearest_soma(p, s):
    return rounded(spatial.nearest_soma(p.withColumnRenamed("seg", "frag_id"), s, 50.0, 2000.0))


@query(
    f"with d as (select a.seg as frag, b.label as anchor, min({_DIST}) as gap from v_xyz a join v_xyz b on {_DIST} <= 700 group by 1, 2), r as (select frag, anchor, gap, row_number() over w as k, lead(gap) over w as nxt from d window w as (partition by frag order by gap, anchor)) select frag, anchor, round(gap, 6) as gap, cast(k as int) as rank from r where k <= 3",
    "v_xyz",
)
def j20_nearest_anchors(p):
    return rounded(spatial.nearest_anchors(p.withColumnRenamed("seg", "group"), p.withColumnRenamed("label", "group"), 700.0, 3)).select("frag", "anchor", "gap", "rank")


@query(
    f"with c as (select seg as id, avg(x) as x, avg(y) as y, avg(z) as z from v_xyz where seg <> 0 group by 1), d as (select a.id as a, b.id as b, {_DIST} as d, row_number() over (partition by a.id order by {_DIST}, b.id) as k from c a join c b on a.id <> b.id) select a as \"group\", b as other, round(d, 6) as d from d where k = 1",
    "v_xyz",
)
def j34_nearest_other_group(p):
    return rounded(spatial.nearest_other_group(p, 500.0))


@query(
    f"with e as (select a.seg as fa, b.seg as fb, min({_DIST}) as d from v_xyz a join v_xyz b on a.seg < b.seg where {_DIST} <= 400 group by 1, 2) select fa, fb, round(d, 6) as d, round(1 - d / 400, 6) as score from e",
    "v_xyz",
)
def j19_fragment_edges(p):
    ends = spatial.endpoint_pairs(p.withColumnRenamed("seg", "frag"), 400.0)
    return rounded(spatial.fragment_edge_scores(ends, p.sparkSession.createDataFrame([], "frag long, dna array<double>"), 400.0))


@query(
    f"with e as (select a.seg as fa, b.seg as fb, min({_DIST}) as d from v_xyz a join v_xyz b on a.seg < b.seg where {_DIST} <= 600 group by 1, 2), s as (select fa, fb, round(1 - d / 600, 9) as score from e), n as (select fa, fb, row_number() over (partition by x order by score desc, fa, fb) as k from (select fa, fb, score, fa as x from s union all select fa, fb, score, fb from s)) select distinct fa, fb from n where k <= 2",
    "v_xyz",
)
def v12_capped_degree(p):
    ends = spatial.endpoint_pairs(p.withColumnRenamed("seg", "frag"), 600.0).withColumn("score", F.round(1 - F.col("d") / 600, 9))
    return spatial.capped_degree(ends, 2).select("fa", "fb")


@query("select a.g as ga, b.g as gb, count(*) as shared from (select distinct seg as g, partner as p from v_obs where seg <> 0 and partner <> 0) a join (select distinct seg as g, partner as p from v_obs where seg <> 0 and partner <> 0) b on a.p = b.p and a.g < b.g group by 1, 2", "v_obs")
def j11_shared_partners(o):
    return spatial.shared_partners(o)


# Graphs

_REACH = "with recursive e as (select src as a, dst as b from v_edge {w} union select dst, src from v_edge {w}), r(node, low) as (select node, node from v_node union select e.b, r.low from r join e on r.node = e.a) "


@query(_REACH.format(w="") + "select node, min(low) as cluster from r where node in (select node from v_node) group by 1", "v_edge", "v_node")
def g1_components(e, n):
    return graph.components(n, e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


@query(_REACH.format(w="where p >= 0.5") + "select node, min(low) as cluster from r where node in (select node from v_node) group by 1", "v_edge", "v_node")
def g27_threshold_clusters(e, n):
    return graph.threshold_clusters(n, e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi"), 0.5)


@query(None, "v_edge", "v_node")
def g2_correlation_clusters(e, n):
    inside = e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.correlation_clusters(n, graph.signed_weights(inside))


@query(None, "v_edge", "v_node")
def g3_greedy_clusters(e, n):
    return graph.greedy_clusters(n, e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi"))


@query("select e.src, e.dst, cast(a.label = b.label as int) as y, a.label <> 0 and b.label <> 0 as known from v_edge e join v_node a on e.src = a.node join v_node b on e.dst = b.node", "v_edge", "v_node")
def g21_labelled_edges(e, n):
    return graph.labelled_edges(e, n).select("src", "dst", "y", "known")


@query("select e.src, e.dst, cast(case when a.seg = 0 or b.seg = 0 then 0.5 when a.seg = b.seg then 1.0 else 0.0 end as double) as seg_connectivity from v_edge e join v_node a on e.src = a.node join v_node b on e.dst = b.node", "v_edge", "v_node")
def j35_seg_agreement(e, n):
    return graph.edge_targets(e, n).select("src", "dst", "seg_connectivity")


@query(
    "with recursive e as (select src as a, dst as b from v_edge union select dst, src from v_edge), r(tile, node, k) as (select label, node, 0 from v_node union select r.tile, e.b, r.k + 1 from r join e on r.node = e.a where r.k < 2) select tile, node, min(k) = 0 as core from r group by 1, 2",
    "v_edge",
    "v_node",
)
def j31_k_hop(e, n):
    return graph.k_hop(e, n.select(F.col("label").alias("tile"), "node"), 2)


@query(
    "select label as cluster, count(*) as n, round(case when count(*) > 1 then (sum(x / l) * sum(x / l) + sum(y / l) * sum(y / l) + sum(z / l) * sum(z / l) - count(*)) / (count(*) * (count(*) - 1)) else 1 end, 6) as cohesion from (select label, x, y, z, sqrt(x * x + y * y + z * z) as l from v_xyz) where l > 0 group by 1",
    "v_xyz",
)
def g19_cohesion(p):
    return rounded(graph.cohesion(p.select(F.col("label").alias("cluster"), F.array("x", "y", "z").alias("dna"))))


@query("with l as (select cluster, dense_rank() over (order by min(node)) - 1 as c from v_node where cluster >= 0 group by cluster) select n.node, coalesce(l.c, n.cluster) as cluster from v_node n left join l on n.cluster = l.cluster", "v_node")
def v13_contiguous(n):
    return graph.contiguous(n)


# Stitching


@query(
    "with k as (select distinct cluster as s, cluster % 4 as t, label as key from v_obs where cluster >= 0), n as (select a.s as i, a.t as ti, b.s as j, b.t as tj, count(*) as shared from k a join k b on a.key = b.key and a.t <> b.t group by 1, 2, 3, 4 having count(*) >= 3), m as (select * from (select *, row_number() over (partition by i, tj order by shared desc, j) as r from n) where r = 1) select x.i, x.j, x.shared from m x join m y on x.i = y.j and x.j = y.i where x.i < x.j",
    "v_obs",
)
def j17_shared_key_links(o):
    placed = o.where("cluster >= 0")
    supers = placed.select(F.col("cluster").alias("super_id"), (F.col("cluster") % 4).alias("tile_id")).distinct()
    return stitch.shared_key_links(supers, placed.select(F.col("cluster").alias("super_id"), F.col("label").alias("key")).distinct(), 3)


@query("with o as (select label, count(distinct seg % 5) as t, count(distinct cluster) as c, min(cluster) as m from v_obs where label <> 0 group by 1 having count(distinct seg % 5) >= 2) select count(*) as n_objects, round(sum(case when c = 1 and m >= 0 then 1 else 0 end) / count(*), 6) as assembled from o", "v_obs")
def a30_assembled_fraction(o):
    return rounded(stitch.assembled_fraction(o.select("label", (F.col("seg") % 5).alias("tile_id"), "cluster")))


@query(
    "with q as (select quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from v_xyz), t as (select id, x, y, mx, my, case when x > mx then 1 else 0 end as ox, case when y > my then 1 else 0 end as oy from v_xyz, q), g as (select range as k from range(2)) select id, a.k * 2 + b.k as tile_id, a.k = ox and b.k = oy as core from t, g a, g b where (a.k = 0 and x - 400 <= mx or a.k = 1 and x + 400 > mx) and (b.k = 0 and y - 400 <= my or b.k = 1 and y + 400 > my)",
    "v_xyz",
)
def f20_tile_grid(p):
    return stitch.tile_grid(p, 2, 2, 400.0, ("x", "y")).withColumn("tile_id", F.col("tile_id").cast("long"))


# Sequences


def _chain(p: DataFrame) -> DataFrame:
    return p.select(F.col("seg").alias("group"), F.col("id").alias("pos"), "x", "y", "z")


_STEP = "s as (select seg as g, id, x, y, z, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)), 0) as step from v_xyz window w as (partition by seg order by id))"


@query(f"with {_STEP} select g as \"group\", id as pos, round(step, 6) as step, round(sum(step) over (partition by g order by id rows unbounded preceding), 6) as arc from s", "v_xyz")
def v2_steps(p):
    return rounded(sequence.steps(_chain(p))).select("group", "pos", "step", "arc")


@query(f"with {_STEP}, e as (select g, count(*) as n, sum(step) as l, arg_min(x, id) as ax, arg_min(y, id) as ay, arg_min(z, id) as az, arg_max(x, id) as bx, arg_max(y, id) as byy, arg_max(z, id) as bz from s group by 1) select g as \"group\", round(case when n < 2 then 1 else l / greatest(sqrt(pow(ax - bx, 2) + pow(ay - byy, 2) + pow(az - bz, 2)), 1e-9) end, 6) as tortuosity from e", "v_xyz")
def v3_tortuosity(p):
    return rounded(sequence.tortuosity(_chain(p)))


@query(None, "v_xyz")
def v1_pca_order(p):
    return rounded(sequence.pca_order(p.withColumn("group", F.col("seg"))).select("group", "id", "pos", "u"), 3)


@query(None, "v_xyz")
def v5_bigram_features(p):
    ordered = sequence.pca_order(p.withColumn("group", F.col("seg")))
    return rounded(sequence.bigram_features(sequence.tokens(ordered), ordered), 6)


# Pairs


@query(None, "v_xyz")
def j25_merge_pairs(p):
    return rounded(pairs.merge_pairs(p, 4, 3000.0))


@query(None, "v_obs")
def j29_label_pairs(o):
    return pairs.label_pairs(o, 2000)


@query("select group_id, y, count(*) as n from (select seg as group_id, 1 as y from v_xyz group by seg having count(*) >= 2) group by 1, 2", "v_xyz")
def j27_root_halves(p):
    return pairs.halves(p).groupBy(F.col("seg").alias("group_id")).agg(F.max("half").alias("y")).where("y = 1").withColumn("n", F.lit(1).cast("long"))


@query("select id, case when axon = ' True ' then 'easy' when axon = 'yes' then 'medium' else 'hard' end as difficulty from v_proof", "v_proof")
def f13_difficulty(p):
    return p.select("id", C.difficulty("axon", "dendrite").alias("difficulty"))


def pair_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How well base ids partition the observations against later ids, with the edit summary."""
    o = view(spark, folder, "v_obs")
    scores = metrics.pairwise(o, pred="seg", true="label", ignore_pred=0)
    return rounded(scores.crossJoin(versions.edit_summary(o)))  # one row each
