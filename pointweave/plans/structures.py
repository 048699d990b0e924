"""Registered queries on files, skeletons, chains, pairs and features, in the same form."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import connect, graph, metrics, models, pairs, sequence, sides, skeleton, spatial, stitch, versions
from pointweave.plans.further import ORACLE_SQL, QUERIES, _trees
from pointweave.plans.queries import query, rounded
from pointweave.sources import boxes, synapses
from pointweave.sources.scratch import Scratch
from pointweave.sources.tables import read_table
from pointweave.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES"]


def _gap(a: str, b: str) -> str:
    """SQL: distance of the points of two aliases."""
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def _reach(nodes: str, links: str) -> str:
    """SQL, after ``with recursive``: ``low`` (node, cluster), the lowest node reached over links (a, b) either way."""
    return f"""lk as ({links}), bo as (select a, b from lk union select b, a from lk),
        re(node, low) as (select node, node from ({nodes}) union select bo.b, re.low from re join bo on re.node = bo.a),
        low as (select node, min(low) as cluster from re group by 1)"""


#: Each segment's points in order of their ids, k from 0.
_ROWS = "rw as (select seg, id, x, y, z, label, row_number() over (partition by seg order by id) - 1 as k from v_xyz)"


def _rows(p: DataFrame) -> DataFrame:
    return p.select(F.col("seg").alias("group"), "id", "label", "x", "y", "z", (F.row_number().over(W.partitionBy("seg").orderBy("id")) - 1).alias("pos"))


#: A binary tree of each segment's points: vertex k hangs on vertex (k - 1) / 2.
_HEAP = f"{_ROWS}, hp as (select c.seg, c.k, c.id as vid, p.id as parent, {_gap('c', 'p')} as len from rw c left join rw p on c.seg = p.seg and c.k > 0 and p.k = (c.k - 1) // 2)"


def _heap(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = _rows(p).select(F.col("group").alias("frag_id"), F.col("id").alias("vid"), "x", "y", "z", (F.col("id") % 50 + 50.0).alias("r"), "pos")
    up = v.select("frag_id", F.col("vid").alias("u"), F.col("pos").alias("_p"))
    e = v.where("pos > 0").select("frag_id", F.col("vid").alias("v"), F.floor((F.col("pos") - 1) / 2).alias("_p")).join(up, ["frag_id", "_p"]).select("frag_id", "u", "v")
    return v.drop("pos"), e


# Files


@query("select id, x from v_xyz where id % 2 = 0 and x between 0 and 5000 and y between 0 and 9000 and z between 0 and 900", "v_xyz")
def s2_valid_columns(p):
    return synapses.region_scan(p.withColumn("valid", F.col("id") % 2 == 0), (0, 0, 0), (5000, 9000, 900), columns=["id", "x"])


@query("select id, seg, x from v_xyz", "v_xyz")
def s6_headerless_csv(p):
    tmp = Scratch(p.sparkSession, "csv")
    rows, header = tmp.path("rows"), tmp.path("header")
    p.select("id", "seg", "x").write.option("compression", "gzip").csv(rows)
    p.sparkSession.createDataFrame([("id, seg,x",)], "value string").write.text(header)
    return synapses.headerless_csv(p.sparkSession, rows, header, {"id": "long", "seg": "long", "x": "double"})


@query("select pre_root as pre, post_root as post, count(*) as n from v_pair group by 1, 2", "v_pair")
def s7_resolved_columns(p):
    raw = p.withColumnRenamed("pre_root", "PRE_PT_Root_ID")
    return synapses.renamed(raw, {"pre": ["pre_root", "pre_pt_root_id"], "post": ["post_root"]}, ("pre", "post")).groupBy("pre", "post").agg(F.count("*").alias("n"))


@query("select nucleus_id, root_id, x * 4 as x, z * 40 as z from v_soma where nucleus_id % 7 <> 0 and nucleus_id % 5 <> 0", "v_soma")
def s8_nuclei(s):
    path = Scratch(s.sparkSession, "nuclei").path("csv")
    root = F.when(F.col("nucleus_id") % 7 == 0, "none").when(F.col("nucleus_id") % 5 == 0, "0").otherwise(F.col("root_id").cast("string"))
    s.select(F.col("nucleus_id").alias("id"), root.alias("pt_root_id"), F.col("x").alias("pt_position_x"), F.col("y").alias("pt_position_y"), F.col("z").alias("pt_position_z")).write.option("header", True).csv(path)
    return synapses.nuclei(s.sparkSession, path, (4, 4, 40)).select("nucleus_id", "root_id", "x", "z")


def _cell_types(spark: SparkSession, folder: str) -> DataFrame:
    path = Scratch(spark, "types").path("csv")
    raw = spark.read.parquet(f"{folder}/customer.parquet").selectExpr("if(c_custkey % 9 = 0, 'x', cast(c_custkey as string)) as pt_root_id", "c_mktsegment as type")
    raw.write.option("header", True).csv(path)
    return synapses.cell_types(spark, path)


QUERIES["s9_cell_types"] = _cell_types
ORACLE_SQL["s9_cell_types"] = "select c_custkey as root_id, c_mktsegment as cell_type from customer where c_custkey % 9 <> 0"


def _box_set(p: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Points in a grid of boxes, written as a dataset."""
    spark = p.sparkSession
    grid = boxes.box_grid((0, 0, 0), (10000, 10000, 2000), 2000.0, spark)
    inside = p.where("(x % 2000 <> 0 or x = 0) and (y % 2000 <> 0 or y = 0)").withColumn("pre_root", F.col("seg")).withColumn("post_root", F.col("label"))
    held = boxes.members(grid, inside, 2000.0)
    path = Scratch(spark, "boxes").path("set")
    boxes.write_boxes(held, grid, path)
    return grid, held, path


_BOXED = "bx as (select *, cast(floor(x / 2000) as bigint) + 5 * cast(floor(y / 2000) as bigint) as box_id from v_xyz where x < 10000 and y < 10000 and (x % 2000 <> 0 or x = 0) and (y % 2000 <> 0 or y = 0))"
_PAIRED = f"""{_BOXED}, sd as (select box_id, 0 as s, seg as r from bx where seg <> 0 union all select box_id, 1, label from bx where label <> 0),
    pr as (select box_id, sum(n * (n - 1) // 2) as pos from (select box_id, s, r, count(*) as n from sd group by 1, 2, 3) group by 1),
    ct as (select b.box_id, count(*) as n, max(pos) as pos from bx b join pr on b.box_id = pr.box_id group by 1)"""


@query(f"with {_PAIRED} select b.box_id, b.id from bx b join ct on b.box_id = ct.box_id where ct.n between 50 and 70 and ct.pos >= 30", "v_xyz")
def s12_boxes_within_limits(p):
    _, _, path = _box_set(p)
    return boxes.read_boxes(p.sparkSession, path, 50, 70, 30).select(F.col("box_id").cast("long").alias("box_id"), "id")


@query(f"with {_PAIRED} select box_id, n as n_synapses, cast(pos as bigint) as n_positive_pairs from ct", "v_xyz")
def s11_catalogue(p):
    _, _, path = _box_set(p)
    return p.sparkSession.read.parquet(f"{path}/catalogue").where("n_synapses > 0").select("box_id", "n_synapses", F.col("n_positive_pairs").cast("long").alias("n_positive_pairs"))


@query(f"with {_BOXED} select 117 as seg_version, 943 as label_version, cast(count(distinct box_id) as bigint) as in_catalogue, cast(count(distinct box_id) as bigint) as with_data, cast(0 as bigint) as incomplete from bx", "v_xyz")
def s17_audit(p):
    _, _, path = _box_set(p)
    return boxes.audit(p.sparkSession, path, 117, 943)


@query(f"with {_BOXED}, g as (select range as box_id from range(25)) select box_id, (box_id % 5 + 0.5) * 2000 as x, (box_id // 5 + 0.5) * 2000 as y from g where box_id not in (select box_id from bx where box_id % 2 = 0)", "v_xyz")
def s18_boxes_to_do(p):
    grid, held, _ = _box_set(p)
    path = Scratch(p.sparkSession, "boxes").path("half")
    some = held.select("box_id").where("box_id % 2 = 0").distinct()
    boxes.write_boxes(held.join(some, "box_id", "left_semi"), grid.join(some, "box_id", "left_semi"), path)
    return boxes.todo(grid, p.sparkSession, path).select("box_id", "x", "y")


@query("with s as (select seg, id, lead(id) over (partition by seg order by id) as v from v_xyz) select seg as frag_id, count(*) as n_vertices, count(v) as n_edges from s group by 1", "v_xyz")
def s13_fragment_tables(p):
    v, e = _trees(p)
    path = Scratch(p.sparkSession, "fragments").path("set")
    boxes.write_fragments(path, v, e, v.select("frag_id").distinct())
    v, e, f = boxes.read_fragments(p.sparkSession, path)
    count = lambda df, n: df.groupBy("frag_id").agg(F.count("*").alias(n))
    return f.join(count(v, "n_vertices"), "frag_id").join(count(e, "n_edges"), "frag_id", "left").na.fill(0, ["n_edges"])


@query("select root_base, root_target from v_map", "v_map")
def s14_tsv(m):
    path = Scratch(m.sparkSession, "tsv").path("map")
    synapses.write_tsv(m, path)
    return synapses.read_tsv(m.sparkSession, path, "root_base long, root_target long")


@query("select root_id, 'https://host/base/mesh/' || root_id as mesh_url, 'https://host/base/skeleton/' || root_id as skeleton_url from v_soma", "v_soma")
def s15_assets(s):
    return synapses.with_assets(s.select("root_id"), "https://host/base")


@query(f"with {_ROWS} select seg as example, k, x, z from rw", "v_xyz")
def s16_examples(p):
    path = Scratch(p.sparkSession, "examples").path("set")
    boxes.write_examples(_rows(p).select(F.col("group").alias("example"), F.col("pos").alias("k"), "x", "y", "z"), path)
    back = p.sparkSession.read.parquet(path).select("example", F.posexplode("points").alias("k", "p"))
    return back.select("example", "k", F.col("p")[0].alias("x"), F.col("p")[2].alias("z"))


@query("select label as frag_id, id as vid from v_xyz where label in (select label from v_xyz group by 1 having count(*) >= 38)", "v_xyz")
def s20_min_vertices(p):
    return skeleton.min_vertices(p.select(F.col("label").alias("frag_id"), F.col("id").alias("vid")), 38)


# Filters and samples


@query("select id, cast(case when x >= 10000 then 4 else floor(x / 2000) end as int) as tile from v_xyz where x between 0 and 10007", "v_xyz")
def f7_x_tile(p):
    return p.select("id", C.x_tile("x", 0.0, 10000.0, 5).alias("tile"))


@query("select id, seg from v_xyz", "v_xyz")
def f15_versions(p):
    return sides.check_versions(p.withColumn("seg_version", F.lit(117)).withColumn("label_version", F.lit(943)), 117, 943).select("id", "seg")


_CHAIN = f"{_ROWS}, ch as (select a.seg, a.id as u, b.id as v, {_gap('a', 'b')} as len from rw a join rw b on a.seg = b.seg and b.k = a.k + 1)"


@query(f"with {_CHAIN}, m as (select seg, quantile_cont(len, 0.5) as m from ch group by 1) select ch.seg as frag_id, u, v, len > greatest(4000, 1.5 * m) as odd from ch join m on ch.seg = m.seg", "v_xyz")
def f17_odd_edges(p):
    return skeleton.odd_edges(skeleton.edge_lengths(*_trees(p)), 1.5, 4000.0).select("frag_id", "u", "v", "odd")


@query("select count(*) as n, count(*) as inside from v_xyz", "v_xyz")
def f21_random_boxes(p):
    n = p.count()
    made = sides.random_boxes(p.sparkSession, n, (0, 0, 0), (100, 200, 300), 3)
    return made.agg(F.countDistinct("box_id").alias("n"), F.count_if(C.in_box(("x", "y", "z"), (0, 0, 0), (100, 200, 300))).alias("inside"))


@query("select root_id from v_soma where root_id % 3 = 1 and x < 8000", "v_soma")
def t4_sampled_roots(s):
    types = s.select("root_id", (F.col("root_id") % 3).cast("string").alias("cell_type"))
    return synapses.sample_roots(s.select("root_id", "x"), 1_000_000, types, ["1"], "x < 8000").select("root_id")


@query("select count(*) as n, least(count(*), 40) as sampled from v_soma", "v_soma")
def t5_sample_size(s):
    return s.agg(F.count("*").alias("n")).crossJoin(synapses.sample_roots(s, 40).agg(F.countDistinct("nucleus_id").alias("sampled")))  # one row each


@query("select s.root_id, p.id from v_soma s join v_xyz p on abs(p.x - s.x) <= 900 and abs(p.y - s.y) <= 900 and abs(p.z - s.z) <= 900", "v_soma", "v_xyz")
def t6_neighbourhoods(s, p):
    return boxes.neighbourhoods(s.select("root_id", "x", "y", "z"), p, 900.0, 1000.0).select("root_id", "id")


@query("select s.root_id as box_id, p.id from v_soma s join v_xyz p on p.x between s.x - 500 and s.x + 700 and p.y between s.y and s.y + 900 and p.z between s.z - 400 and s.z", "v_soma", "v_xyz")
def j32_points_in_boxes(s, p):
    box = s.selectExpr("root_id as box_id", "x - 500 as lo_x", "x + 700 as hi_x", "y as lo_y", "y + 900 as hi_y", "z - 400 as lo_z", "z as hi_z")
    return spatial.points_in_boxes(box, p, 800.0).select("box_id", "id")


# Sets


@query("select syn_id, case when a and b then 'both' when a then 'first' else 'second' end as seen from (select syn_id, seg > 20 as a, label > 20 as b from v_obs) where a or b", "v_obs")
def u2_seen_on_both_sides(o):
    a, b = o.where("seg > 20").select("syn_id"), o.where("label > 20").select("syn_id")
    tell = lambda df, name: df.withColumn("seen", F.lit(name))
    return tell(a.intersect(b), "both").unionByName(tell(a.subtract(b), "first")).unionByName(tell(b.subtract(a), "second"))


_EDGE_SETS = "t as (select distinct label as pre, partner as post from v_obs where label <> 0 and partner <> 0), e as (select distinct cluster as pre, partner as post from v_obs where cluster <> 0 and partner <> 0)"


@query(
    f"with {_EDGE_SETS} select (select count(*) from (from t intersect from e)) as tp, (select count(*) from (from e except from t)) as fp, (select count(*) from (from t except from e)) as fn from (select 1)",
    "v_obs",
)
def u3_edge_sets(o):
    t, e = (connect.connectome(o, c, "partner").select("pre", "post") for c in ("label", "cluster"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.intersect(e), "tp").crossJoin(n(e.subtract(t), "fp")).crossJoin(n(t.subtract(e), "fn"))  # one row each


@query("select src % 2 as region, src, dst from v_edge", "v_edge", "v_node")
def u4_regional_union(e, n):
    graphs = [(str(r), n.where(F.col("node") % 2 == r), e.where(F.col("src") % 2 == r)) for r in (0, 1)]
    _, edges = graph.regional_union(graphs)
    return edges.select(F.col("src.region_id").cast("long").alias("region"), F.col("src.node").alias("src"), F.col("dst.node").alias("dst"))


@query("select seg, min(id) as id from v_xyz group by 1", "v_xyz")
def u5_one_per_id(p):
    return sides.one_per_id(p.select("seg", "id"), "seg", "id")


# Joins


_NEAR_LABEL = "frag_pairs as (select distinct label as fa, label + 1 as fb from v_xyz)"


@query(f"with {_NEAR_LABEL} select a.id as src, b.id as dst from frag_pairs f join v_xyz a on a.label = f.fa join v_xyz b on b.label = f.fb", "v_xyz")
def j9_adjacent_pairs(p):
    both = p.select(F.col("label").alias("fa"), (F.col("label") + 1).alias("fb")).distinct()
    return spatial.adjacent_obs_pairs(both, p.select("id", F.col("label").alias("frag")))


_DNA = "d as (select node, cast(seg + 1 as double) as u, cast(label as double) as v from v_node)"


@query(
    f"with {_DNA} select src, dst, etype, case when etype = 0 then 1 else 0 end as same_seg, case when etype = 1 then 1 else 0 end as spatial, case when etype = 2 then 1 else 0 end as endpoint, round((a.u * b.u + a.v * b.v) / (sqrt(a.u * a.u + a.v * a.v) * sqrt(b.u * b.u + b.v * b.v)), 6) as cos from v_edge e join d a on e.src = a.node join d b on e.dst = b.node",
    "v_edge",
    "v_node",
)
def j10_typed_edges(e, n):
    dna = n.select(F.col("node").alias("id"), F.array((F.col("seg") + 1).cast("double"), F.col("label").cast("double")).alias("dna"))
    return rounded(spatial.typed_edges(*[e.where(F.col("etype") == k) for k in range(3)], dna))


@query("select l.root_base as root, s.root_id is not null as has_soma from v_smap l left join (select distinct root_id from v_soma) s on l.root_base = s.root_id", "v_smap", "v_soma")
def j15_with_soma(m, s):
    return connect.with_soma(m.select(F.col("root_base").alias("root")), s)


@query(
    f"""with e as (select id, seg, seg % 4 as tile, x, y, z from v_xyz),
    n as (select least(a.seg, b.seg) as i, greatest(a.seg, b.seg) as j, {_gap('a', 'b')} as d from e a join e b on a.seg <> b.seg and a.tile <> b.tile and a.id < b.id where {_gap('a', 'b')} <= 900),
    m as (select i, j, min(d) as gap from n group by 1, 2)
    select i, j, round(gap, 6) as gap, round((1 - gap / 900) * (((i + 1) * (j + 1) + 9) / (sqrt((i + 1) * (i + 1) + 9) * sqrt((j + 1) * (j + 1) + 9)) + 1) / 2, 6) as score from m""",
    "v_xyz",
)
def j18_stitch_candidates(p):
    supers = p.select(F.col("seg").alias("super_id"), (F.col("seg") % 4).alias("tile_id"), F.array((F.col("seg") + 1).cast("double"), F.lit(3.0)).alias("dna")).distinct()
    return rounded(stitch.stitch_candidates(p.select("id", F.col("seg").alias("super_id"), "x", "y", "z"), supers, 900.0)).select("i", "j", "gap", "score")


@query("select a.id as a, b.id as b, case when a.label = b.label then 1 else 0 end as y from v_xyz a join v_xyz b on a.seg = b.seg and a.id < b.id where a.seg > 0 and a.label <> 0 and b.label <> 0", "v_xyz")
def j24_split_pairs(p):
    return pairs.split_pairs(p)


def _nearest(name: str, left: str, right: str, where: str, k: int, r: float) -> str:
    """SQL: table ``name`` (a, b, d, rn) of the k nearest within r."""
    return f"{name} as (select * from (select a.id as a, b.id as b, {_gap('a', 'b')} as d, row_number() over (partition by a.id order by {_gap('a', 'b')}, b.id) as rn from {left} a join {right} b on a.id <> b.id and {where} where {_gap('a', 'b')} <= {r}) where rn <= {k})"


_MERGE = f"""ob as (select * from v_xyz where label <> 0 and seg <> 0), {_nearest('kp', 'ob', 'ob', 'a.label = b.label and a.seg <> b.seg', 2, 3500)},
    ps as (select distinct least(a, b) as a, greatest(a, b) as b, d from kp), an as (select * from ob where id in (select a from ps)),
    {_nearest('kn', 'an', 'ob', 'a.label <> b.label', 2, 3500)}, ng as (select distinct least(a, b) as a, greatest(a, b) as b, d from kn),
    mp as (select a, b, d, 1 as y from ps union all select a, b, d, 0 from ng)"""


@query(f"with {_MERGE} select a, b, round(d, 6) as d, y from mp", "v_xyz")
def j25_all_merge_pairs(p):
    return rounded(pairs.merge_pairs(p, 2, 3500.0, 100.0))


@query(
    f"""with {_MERGE}, {_nearest('tp', '(select * from v_xyz where id in (select a from mp union select b from mp))', 'v_xyz', 'a.seg = b.seg', 2, 1e9)}
    select mp.a, mp.b, y, 'a' as side, cast(rn as int) as rank, tp.b as id from mp join tp on mp.a = tp.a union all select mp.a, mp.b, y, 'b', cast(rn as int), tp.b from mp join tp on mp.b = tp.a""",
    "v_xyz",
)
def j36_desplit_pairs(p):
    return pairs.desplit_pairs(p, 2, 3500.0, 2, 800.0, 100.0)


@query(
    f"""with pt as (select id, seg as part, seg % 6 as label, id % 700 as syn_id, x, y, z from v_xyz), ow as (select distinct part, label from pt),
    cn as (select part as id, label, avg(x) as x, avg(y) as y, avg(z) as z from pt group by 1, 2), {_nearest('kn', 'cn', 'cn', 'a.label <> b.label', 2, 5000)},
    ev as (select a.part as pa, b.part as pb, 1 as y from ow a join ow b on a.label = b.label and a.part < b.part where a.label <> 0 union all select distinct least(a, b), greatest(a, b), 0 from kn),
    sh as (select distinct a.part as pa, b.part as pb from pt a join pt b on a.syn_id = b.syn_id and a.part < b.part),
    kp as (select * from ev where not exists (select 1 from sh where sh.pa = ev.pa and sh.pb = ev.pb))
    select kp.pa, kp.pb, kp.y, round(min({_gap('a', 'b')}), 6) as d from kp join pt a on a.part = kp.pa join pt b on b.part = kp.pb group by 1, 2, 3""",
    "v_xyz",
)
def j26_partition_pairs(p):
    parts = p.select("id", F.col("seg").alias("part"), (F.col("seg") % 6).alias("label"), (F.col("id") % 700).alias("syn_id"), "x", "y", "z")
    return rounded(pairs.partition_merge_pairs(parts, 400.0, 2, 5000.0)).select("pa", "pb", "y", "d")


@query(
    f"""with c as (select label as id, avg(x) as x, avg(y) as y, avg(z) as z from v_xyz group by 1 having count(*) >= 2), {_nearest('kn', 'c', 'c', 'true', 1, 1e9)}
    select count(*) as n, round(avg(y), 6) as positive_share from (select 1.0 as y from c union all select 0.0 from (select distinct least(a, b), greatest(a, b) from kn))""",
    "v_xyz",
)
def j28_class_balance(p):
    return rounded(pairs.class_balance(pairs.cluster_examples(p, 500.0, "label")))


_CODES = "cd as (select id, seg as grp, label % 4 as y, seg % 3 as fold, (id * 7919) % 65536 + 65536 * ((id * 104729) % 65521) + 4294967296 * ((id * 1299709) % 2147483647) as code from v_xyz)"


@query(
    f"""with {_CODES}, j as (select a.id, b.id as other, a.y = b.y as hit, bit_count(xor(a.code, b.code)) as distance from cd a join cd b on a.fold <> b.fold)
    select id, other, cast(distance as int) as distance, hit from (select *, row_number() over (partition by id order by distance, other) as rn from j) where rn <= 2""",
    "v_xyz",
)
def j30_retrieval(p):
    codes = p.select("id", F.col("seg").alias("group"), (F.col("label") % 4).alias("y"), (F.col("seg") % 3).alias("fold"), F.expr("(id * 7919) % 65536 + 65536 * ((id * 104729) % 65521) + 4294967296 * ((id * 1299709) % 2147483647)").alias("code"))
    return pairs.retrieval(codes, 2).select("id", "other", F.col("distance").cast("int").alias("distance"), "hit")


_EDITS = "ed as (select seg as edit_id, case when seg % 2 = 0 then 'merge' else 'split' end as op, seg as a, seg + 1 as b from v_obs group by seg)"


@query(f"with {_EDITS} select e.edit_id, x.syn_id as a, y.syn_id as b, case when op = 'merge' then 1 else 0 end as together from ed e join v_obs x on e.a = x.seg join v_obs y on e.b = y.seg", "v_obs")
def j37_all_edit_pairs(o):
    e = o.select(F.col("seg").alias("edit_id")).distinct()
    both = F.array(F.col("edit_id"), F.col("edit_id") + 1)
    edits = e.select("edit_id", F.when(F.col("edit_id") % 2 == 0, "merge").otherwise("split").alias("op"), both.alias("before"), both.alias("after"))
    return versions.edits_to_pairs(edits, o, 1_000_000_000)


@query(
    "select m.root_target as root_id, count(distinct s.nucleus_id) as somata from v_soma s join v_smap m on s.nucleus_id + 1 = m.root_base where m.root_target <> 0 and m.root_target in (select distinct seg from v_xyz where x < 3000) group by 1",
    "v_soma",
    "v_smap",
    "v_xyz",
)
def j38_somata_of_a_region(s, m, p):
    here = p.where("x < 3000").select(F.col("seg").alias("root_id")).distinct()
    counts = versions.soma_counts(s.select("nucleus_id", (F.col("nucleus_id") + 1).alias("sv")), m.select(F.col("root_base").alias("sv"), F.col("root_target").alias("root")))
    return counts.join(here, "root_id", "left_semi")


@query("select seg, cast(2 * least(50, (count(*) * (count(*) - 1)) // 2) as bigint) as n from v_xyz where seg > 0 group by 1", "v_xyz")
def j8_capped_pairs(p):
    """How many pairs a segment gives where the cap acts."""
    found = spatial.same_segment_pairs(p, 50)
    return found.distinct().join(p.select(F.col("id").alias("src"), "seg"), "src").groupBy("seg").agg(F.count("*").alias("n"))


@query(
    """with n as (select label as frag, count(*) as n from v_xyz group by 1)
    select a.frag as fa, b.frag as fb, cast(least(30, a.n * b.n) as bigint) as n from n a join n b on b.frag = a.frag + 1""",
    "v_xyz",
)
def j9_capped_pairs(p):
    """How many pairs two adjacent fragments give where the cap acts."""
    obs = p.select("id", F.col("label").alias("frag"))
    pairs_of_frags = obs.select(F.col("frag").alias("fa"), (F.col("frag") + 1).alias("fb")).distinct()
    found = spatial.adjacent_obs_pairs(pairs_of_frags, obs, 30).distinct()
    own = lambda c, f: obs.select(F.col("id").alias(c), F.col("frag").alias(f))
    return found.join(own("src", "fa"), "src").join(own("dst", "fb"), "dst").groupBy("fa", "fb").agg(F.count("*").alias("n"))


# Metrics


@query("with q as (select quantile_cont(x, [0.25, 0.5, 0.75]) as e from v_xyz) select id, (case when x > e[1] then 1 else 0 end + case when x > e[2] then 1 else 0 end + case when x > e[3] then 1 else 0 end) as bin, cast(1 as bigint) as splits from v_xyz, q", "v_xyz")
def a9_spatial_split(p):
    out = metrics.spatial_split(p, "x", 4)
    return out.select("id", F.col("bin").cast("int").alias("bin"), F.size(F.collect_set("split").over(W.partitionBy("bin"))).cast("long").alias("splits"))


@query("select 'points.n' as metric, cast(count(*) as double) as value from v_xyz union all select 'points.top', max(x) from v_xyz union all select 'segs.n', count(distinct seg) from v_xyz", "v_xyz")
def a18_report(p):
    return metrics.report({"points": p.agg(F.count("*").alias("n"), F.max("x").alias("top")), "segs": p.agg(F.countDistinct("seg").alias("n"))})


@query(
    "select count(*) as n, round(sum(case when a.label = b.label then 1 else 0 end) / count(*), 6) as \"precision\" from v_edge e join v_node a on e.src = a.node join v_node b on e.dst = b.node where a.label <> 0 and b.label <> 0",
    "v_edge",
    "v_node",
)
def a28_edge_precision(e, n):
    return rounded(stitch.edge_precision(e.select(F.col("src").alias("i"), F.col("dst").alias("j")), n.select(F.col("node").alias("super_id"), F.col("label").alias("majority_label"))))


@query(
    """with recursive d as (select p * 6 - 3.5 as z, cast(y as double) as y from v_score where id % 5 = 0),
    n(step, beta) as (
        select 0, cast(1 as double)
        union all
        select n.step + 1, n.beta - sum(z * (1 / (1 + exp(-n.beta * z)) - y)) / sum(z * z / (1 + exp(-n.beta * z)) * (1 - 1 / (1 + exp(-n.beta * z)))) from n, d where n.step < 25 group by n.step, n.beta
    ),
    b as (select beta from n where step = 25)
    select round(1 / max(beta), 6) as temperature, round(avg(greatest(beta * z, 0) - beta * z * y + ln(1 + exp(-abs(beta * z)))), 6) as nll from d, b""",
    "v_score",
)
def a34_temperature(s):
    rows = s.select("id", (F.col("p") * 6 - 3).alias("logit"), "y")
    t, nll = metrics.fit_temperature(rows, held=F.col("id") % 5 == 0, bias=-0.5)
    return rounded(s.sparkSession.createDataFrame([(float(t), float(nll))], "temperature double, nll double"))


@query(
    f"""with recursive {_reach('select node from v_node', 'select src as a, dst as b from v_edge where p >= 0.8')},
    c as (select l.cluster, n.label from low l join v_node n on l.node = n.node where n.label <> 0),
    s as (select (select sum(n * (n - 1) / 2) from (select count(*) as n from c group by cluster, label)) as tp, (select sum(n * (n - 1) / 2) from (select count(*) as n from c group by cluster)) as pp, (select sum(n * (n - 1) / 2) from (select count(*) as n from c group by label)) as tt)
    select cast(0.8 as double) as threshold, round(2 * tp / (pp + tt), 6) as f1 from s""",
    "v_edge",
    "v_node",
)
def a35_calibrated_threshold(e, n):
    found = graph.calibrated_threshold(n, e, [0.8])
    return rounded(e.sparkSession.createDataFrame([(float(t), float(f)) for f, t in found], "threshold double, f1 double"))


_TOKENS = "tk as (select seg as g, k as pos, case (id * 7 + k) % 4 when 0 then 'F' when 1 then 'B' when 2 then 'L' else 'R' end as token from rw)"
_MODEL = """gr as (select g % 2 as half, token as first, lead(token) over (partition by g order by pos) as second from tk), al as (select a.t as first, b.t as second, h.h as half from (select unnest(['F', 'B', 'L', 'R']) as t) a, (select unnest(['F', 'B', 'L', 'R']) as t) b, (select unnest([0, 1]) as h) h),
    nn as (select al.half, al.first, al.second, count(gr.first) as n from al left join gr on al.half = gr.half and al.first = gr.first and al.second = gr.second group by 1, 2, 3),
    mo as (select *, (n + 1) / (sum(n) over (partition by half, first) + 4) as p from nn)"""


def _tokens(p: DataFrame) -> DataFrame:
    k = (F.col("id") * 7 + F.col("pos")) % 4
    return _rows(p).select("group", "pos", F.element_at(F.array(*[F.lit(t) for t in "FBLR"]), (k + 1).cast("int")).alias("token"))


@query(f"with {_ROWS}, {_TOKENS}, {_MODEL} select first, second, cast(n as bigint) as n, round(p, 6) as p from mo where half = 0", "v_xyz")
def a50_bigram_model(p):
    return rounded(sequence.bigram_model(_tokens(p).where(F.col("group") % 2 == 0)))


@query(f"with {_ROWS}, {_TOKENS}, {_MODEL}, k as (select a.first, sum(a.n) as f, sum(a.p * ln(a.p / b.p)) as k from mo a join mo b on a.first = b.first and a.second = b.second where a.half = 0 and b.half = 1 group by 1) select round(sum(f * k) / sum(f), 6) as kl from k", "v_xyz")
def a50_grammar_divergence(p):
    t = _tokens(p)
    return rounded(sequence.grammar_divergence(*[sequence.bigram_model(t.where(F.col("group") % 2 == h)) for h in (0, 1)]))


# Chains


_STEP = f"{_ROWS}, st as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy, z - lag(z) over w as dz from rw window w as (partition by seg order by k)), sl as (select *, sqrt(dx * dx + dy * dy + dz * dz) as step from st)"
_TURN = f"""{_STEP}, tn as (select *, case when step > 0 and lag(step) over w > 0 then acos(least(1, greatest(-1, (dx * lag(dx) over w + dy * lag(dy) over w + dz * lag(dz) over w) / (step * lag(step) over w)))) else 0 end as turn
    from sl window w as (partition by seg order by k))"""


@query(
    f"""with {_ROWS}, d as (select seg, k, lead(x) over w - x as du, lead(y) over w - y as dv, lead(z) over w - z as dw from rw window w as (partition by seg order by k)),
    s as (select *, case when du * du + dv * dv + dw * dw > 0 then du / sqrt(du * du + dv * dv + dw * dw) else 0 end as share from d where du is not null)
    select seg as "group", k as pos, case when share > 0.4 then 'F' when share < -0.4 then 'B' when dv >= 0 then 'L' else 'R' end as token from s""",
    "v_xyz",
)
def v4_tokens(p):
    return sequence.tokens(_rows(p).withColumnsRenamed({"x": "u", "y": "v", "z": "w"}))


@query(
    f"""with {_ROWS}, n as (select seg, max(k) as last from rw group by 1), e as (select seg as edit_id, case when seg % 2 = 0 then 'split' else 'merge' end as op, seg as l, seg + 1 as r from n)
    select e.edit_id, case when op = 'split' then 1 else 0 end as label, 2 - (n.last - w.k) as k, x, y, z from e join n on e.l = n.seg join rw w on w.seg = e.l where w.k > n.last - 3
    union all select e.edit_id, case when op = 'split' then 1 else 0 end, 3 + w.k, x, y, z from e join rw w on w.seg = e.r where w.k < 3""",
    "v_xyz",
)
def v7_junction_windows(p):
    rows = _rows(p)
    edits = rows.select(F.col("group").alias("edit_id")).distinct().select("edit_id", F.when(F.col("edit_id") % 2 == 0, "split").otherwise("merge").alias("op"), F.col("edit_id").alias("left"), (F.col("edit_id") + 1).alias("right"))
    return sequence.junction_windows(edits, rows, 3)


@query(
    f"""with {_ROWS}, c as (select a.seg, a.id as a, b.id as b, a.x as ax, a.y as ay, a.z as az, b.x - a.x as vx, b.y - a.y as vy, b.z - a.z as vz, {_gap('a', 'b')} as l
        from rw a join rw b on a.seg = b.seg and b.k = a.k + 1),
    t as (select c.*, ((o.x - ax) * vx + (o.y - ay) * vy + (o.z - az) * vz) / (l * l) as t, o.x as ox, o.y as oy, o.z as oz from c join v_xyz o on o.seg = c.seg where l >= 1e-6),
    f as (select a, b, least(floor(t * 6), 5) as bin from t
        where t >= 0 and t <= 1 and sqrt(pow(ox - ax - t * vx, 2) + pow(oy - ay - t * vy, 2) + pow(oz - az - t * vz, 2)) <= greatest(0.15 * l, 500)
        union select a, b, 0 from c where l >= 1e-6 union select a, b, 5 from c where l >= 1e-6),
    n as (select a, b, count(distinct bin) as n from f group by 1, 2)
    select c.a, c.b, round(coalesce(n / 6, 1), 6) as occupancy from c left join n on c.a = n.a and c.b = n.b""",
    "v_xyz",
)
def v8_gap_occupancy(p):
    rows = _rows(p)
    a = rows.select("group", "pos", F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = rows.select("group", (F.col("pos") - 1).alias("pos"), F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    ends = a.join(b, ["group", "pos"]).withColumnRenamed("group", "seg").drop("pos")
    return rounded(sequence.gap_occupancy(ends, p))


_TIPS = f"""{_nearest('kn', 'v_xyz', 'v_xyz', 'a.seg = b.seg', 2, 1e9)}, cn as (select kn.a as id, avg(d) as spacing, avg(o.x) as x, avg(o.y) as y, avg(o.z) as z from kn join v_xyz o on kn.b = o.id group by 1),
    tp as (select p.id, p.seg, p.x, p.y, p.z, coalesce((p.x - c.x) / nullif({_gap('p', 'c')}, 0), 0) as tx, coalesce((p.y - c.y) / nullif({_gap('p', 'c')}, 0), 0) as ty, coalesce((p.z - c.z) / nullif({_gap('p', 'c')}, 0), 0) as tz, c.spacing from v_xyz p join cn c on p.id = c.id)"""


@query(f"with {_TIPS} select id, round(tx, 6) as tx, round(ty, 6) as ty, round(tz, 6) as tz, round(spacing, 6) as spacing from tp", "v_xyz")
def v9_tip_directions(p):
    return rounded(sequence.tip_directions(p, p, 2, 800.0))


@query(
    f"""with {_TIPS}, j as (select a.id as a, b.id as b, {_gap('a', 'b')} as gap, a.tx as atx, a.ty as aty, a.tz as atz, b.tx as btx, b.ty as bty, b.tz as btz, b.x - a.x as vx, b.y - a.y as vy, b.z - a.z as vz, a.spacing as sa, b.spacing as sb from tp a join tp b on b.id = a.id + 1)
    select a, b, round(gap, 6) as gap, round((vx * atx + vy * aty + vz * atz) / gap, 6) + 0 as align_a, round(-(vx * btx + vy * bty + vz * btz) / gap, 6) + 0 as align_b, round(-(atx * btx + aty * bty + atz * btz), 6) + 0 as opposed, round(least(sa, sb) / greatest(sa, sb), 6) as spacing_ratio, round(gap / greatest(sa, sb), 6) as rel_gap from j""",
    "v_xyz",
)
def v9_continuation(p):
    tips = p.select("id", "x", "y", "z").join(sequence.tip_directions(p, p, 2, 800.0), "id")
    ends = tips.select(F.col("id").alias("a")).join(tips.select((F.col("id") - 1).alias("a"), F.col("id").alias("b")), "a")
    return rounded(sequence.continuation(ends, tips)).select("a", "b", "gap", "align_a", "align_b", "opposed", "spacing_ratio", "rel_gap")


@query(f"select a.seg as pa, b.seg as pb, round(min({_gap('a', 'b')}), 6) as d from v_xyz a join v_xyz b on b.seg = a.seg + 1 group by 1, 2", "v_xyz")
def v10_part_gaps(p):
    parts = p.withColumn("part", F.col("seg"))
    ends = p.select(F.col("seg").alias("pa"), (F.col("seg") + 1).alias("pb")).distinct()
    return rounded(pairs.part_gaps(ends, parts, 300.0))


@query(
    f"""with {_TURN}, r as (select *, ln(greatest(id % 50 + 1, 1e-6)) as log_r from tn)
    select seg as "group", k as pos, round(case when k > 0 then ln(greatest(step, 1e-6)) else 0 end, 6) as log_step, round(case when k > 0 and lead(k) over w is not null then lead(turn) over w else 0 end, 6) as turn, round(log_r, 6) as log_r, round(coalesce(log_r - lag(log_r) over w, 0), 6) as dlog_r
    from r window w as (partition by seg order by k)""",
    "v_xyz",
)
def v14_intrinsic(p):
    return rounded(sequence.intrinsic(_rows(p).withColumn("r", F.col("id") % 50 + 1.0)))


@query(
    f"""with {_TURN}, j as (select *, lead(step) over w as after, lead(turn) over w as tu, lead(label) over w as nl, count(*) over (partition by seg) as n, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz, lead(x) over w as qx, lead(y) over w as qy, lead(z) over w as qz from tn window w as (partition by seg order by k))
    select seg as "group", k as pos, round(step, 6) as step_before, round(after, 6) as step_after, round(after / greatest(step, 1e-9), 6) as ratio, round(tu, 6) as turn, round(sqrt(pow(px - qx, 2) + pow(py - qy, 2) + pow(pz - qz, 2)), 6) as span, coalesce(nl <> label and nl <> 0 and label <> 0, false) as seam from j where n >= 4 and k > 0 and after is not null""",
    "v_xyz",
)
def v15_junctions(p):
    return rounded(sequence.junctions(_rows(p)))


@query(f"with {_ROWS} select seg as \"group\", k as pos, coalesce(lead(label) over w <> label and lead(label) over w <> 0 and label <> 0, false) as seam from rw window w as (partition by seg order by k)", "v_xyz")
def v16_seams(p):
    return sequence.seams(_rows(p)).select("group", "pos", "seam")


# Skeletons


_WALK = f"{_HEAP}, wk(seg, vid, depth, len, path) as (select seg, vid, 0, cast(0 as double), [vid] from hp where k = 0 union all select h.seg, h.vid, w.depth + 1, w.len + h.len, list_append(w.path, h.vid) from wk w join hp h on h.parent = w.vid)"


@query(f"with recursive {_WALK} select seg as frag_id, vid, cast(row_number() over (partition by seg order by path) - 1 as int) as pos, round(len, 6) as depth_nm from wk", "v_xyz")
def v17_depth_order(p):
    return rounded(skeleton.depth_order(*_heap(p)))


@query(f"with recursive {_WALK}, o as (select seg, vid, row_number() over (partition by seg order by path) - 1 as pos, count(*) over (partition by seg) as n from wk) select seg as frag_id, vid, cast(least(3, pos * 4 // n) as int) as piece from o", "v_xyz")
def g13_pieces(p):
    return skeleton.pieces(*_heap(p), 4)


@query("select seg as frag_id, id as vid from v_xyz", "v_xyz")
def g14_leaf_paths(p):
    return skeleton.leaf_paths(*_trees(p), 1).select("frag_id", "vid")


@query(f"with recursive {_WALK} select w.seg as frag_id, w.vid as id, h.parent as parent_id, round(h.len, 6) as path_length, w.depth as depth from wk w join hp h on w.vid = h.vid", "v_xyz")
def g23_obs_tree(p):
    v, e = _heap(p)
    return rounded(skeleton.obs_tree(v, e, v.select("frag_id", "vid", F.col("vid").alias("id"))))


@query(f"with recursive {_WALK} select w.seg as frag_id, w.vid as id, w.path[len(w.path) - 1] as parent_id, w.depth from wk w", "v_xyz")
def g17_parents_of_observations(p):
    v, e = _heap(p)
    return skeleton.obs_tree(v, e, v.select("frag_id", "vid", F.col("vid").alias("id"))).select("frag_id", "id", "parent_id", "depth")


@query(f"with recursive {_WALK} select w.seg as frag_id, max(w.depth) as deepest, round(max(w.len), 6) as farthest from wk w group by 1", "v_xyz")
def g18_tree_depths(p):
    v, e = _heap(p)
    tree = skeleton.obs_tree(v, e, v.select("frag_id", "vid", F.col("vid").alias("id")))
    far = skeleton.depth_order(v, e).groupBy("frag_id").agg(F.max("depth_nm").alias("farthest"))
    return rounded(tree.groupBy("frag_id").agg(F.max("depth").alias("deepest")).join(far, "frag_id"))


@query(
    f"""with recursive {_HEAP}, dg as (select v, count(*) as d from (select vid as v from hp where parent is not null union all select parent from hp where parent is not null) group by 1),
    tc as (select vid as e, vid as v from hp where parent is not null union all select vid, parent from hp where parent is not null),
    {_reach('select vid as node from hp where parent is not null', 'select s.e as a, t.e as b from tc s join tc t on s.v = t.v and s.e < t.e join dg on dg.v = s.v and dg.d <= 2')}
    select h.seg as frag_id, tc.v as vid, low.cluster as lowest from tc join low on tc.e = low.node join hp h on tc.v = h.vid group by 1, 2, 3""",
    "v_xyz",
)
def g9_atoms(p):
    v, e = _heap(p)
    found = skeleton.atoms(v, e, 1e9)
    # An atom is named by the lowest lower end of its edges.
    lower = e.select("frag_id", F.col("u").alias("vid"), F.col("v").alias("end")).unionByName(e.select("frag_id", F.col("v").alias("vid"), F.col("v").alias("end")))
    both = found.join(lower, ["frag_id", "vid"]).groupBy("frag_id", "atom", "end").agg(F.count("*").alias("n")).where("n = 2").groupBy("frag_id", "atom").agg(F.min("end").alias("lowest"))
    return found.join(both, ["frag_id", "atom"]).select("frag_id", "vid", "lowest")


@query(
    f"""with {_ROWS}, s as (select seg, id, k, (k * k) % 3 as label from rw), c as (select a.seg, a.k, b.label, count(*) filter (b.k <= a.k) as l, count(*) filter (b.k > a.k) as r from s a join s b on a.seg = b.seg group by 1, 2, 3),
    w as (select seg, k, sum(l) as nl, sum(r) as nr, sum(l * (l - 1) / 2) as sl, sum(r * (r - 1) / 2) as sr, sum((l + r) * (l + r - 1) / 2) as sa, sum(l * r) as x from c group by 1, 2),
    g as (select seg, k, (nl + nr) * (nl + nr - 1) / 2 - sa as before, nl * (nl - 1) / 2 - sl + nr * (nr - 1) / 2 - sr + x as after from w where nr > 0),
    b as (select *, row_number() over (partition by seg order by before - after desc, k) as rn from g where before > after)
    select b.seg as frag_id, 0 as step, u.id as u, v.id as v, cast(before as double) as before, cast(after as double) as after from b join s u on u.seg = b.seg and u.k = b.k join s v on v.seg = b.seg and v.k = b.k + 1 where rn = 1""",
    "v_xyz",
)
def g15_best_cuts(p):
    labels = _rows(p).select(F.col("group").alias("frag_id"), F.col("id").alias("vid"), ((F.col("pos") * F.col("pos")) % 3).alias("label"), F.lit(1).alias("n"))
    return skeleton.best_cuts(*_trees(p), labels, 1)


@query(
    """with recursive e as (select src as a, dst as b, cast(round(p * 100) as int) as c from v_edge union select dst, src, cast(round(p * 100) as int) from v_edge),
    r(node, cost, source) as (select node, 0, node from v_node where node % 50 = 0 union select e.b, r.cost + e.c, r.source from r join e on r.node = e.a where r.cost + e.c <= 90)
    select node, cast(min(cost) as double) as cost, arg_min(source, cost * 1000000 + source) as source from r group by 1""",
    "v_edge",
    "v_node",
)
def g16_cheapest_bridge(e, n):
    costs = e.select("src", "dst", F.round(F.col("p") * 100).alias("cost"))
    return graph.cheapest_bridge(costs, n.where("node % 50 = 0").select("node"), n, 90.0)


@query(
    f"""with recursive d as (select node, cast(seg + 1 as double) as u, cast(label + 1 as double) as v from v_node),
    {_reach('select node from v_node', 'select e.src as a, e.dst as b from v_edge e join d a on e.src = a.node join d b on e.dst = b.node where (a.u * b.u + a.v * b.v) / (sqrt(a.u * a.u + a.v * a.v) * sqrt(b.u * b.u + b.v * b.v)) >= 0.99')} select node, cluster from low""",
    "v_edge",
    "v_node",
)
def g20_embedding_clusters(e, n):
    nodes = n.select("node", F.array((F.col("seg") + 1).cast("double"), (F.col("label") + 1).cast("double")).alias("dna"))
    return graph.embedding_clusters(nodes, e, 0.99)


@query(
    f"with recursive {_reach('select node from v_node', 'select e.src as a, e.dst as b from v_edge e where e.src % 5 = e.dst % 5 union select a.node, b.node from v_node a join (select seg, min(node) as node from v_node where seg > 0 group by 1) b on a.seg = b.seg')} select node, cluster from low",
    "v_edge",
    "v_node",
)
def g4_tiled_clusters(e, n):
    return graph.tiled_clusters(n.select("node", (F.col("node") % 5).alias("tile"), "seg"), e.select("src", "dst", F.lit(1.0).alias("w")))


@query(f"with {_nearest('kn', 'v_xyz', 'v_xyz', 'a.seg = b.seg', 1, 1e9)} select distinct least(a, b) as src, greatest(a, b) as dst, round(d, 6) as w from kn", "v_xyz")
def g25_cloud_forest(p):
    return rounded(skeleton.cloud_forest(p, 1, 800.0))


@query(
    f"with {_nearest('kn', 'v_xyz', 'v_xyz', 'a.seg = b.seg', 1, 1e9)}, f as (select distinct p.seg, least(a, b) as src, greatest(a, b) as dst, d from kn join v_xyz p on kn.a = p.id), m as (select seg, quantile_cont(d, 0.5) as m from f group by 1) select f.seg, cast(sum(case when d > greatest(500, 1.5 * m) then 1 else 0 end) as bigint) as n_odd from f join m on f.seg = m.seg group by 1",
    "v_xyz",
)
def g12_long_bridges(p):
    return skeleton.long_bridges(p, 1, 800.0, 1.5, 500.0)


@query(f"with s as (select id, seg % 4 as part, x, y, z from v_xyz), j as (select a.part, a.id as a, b.id as b, {_gap('a', 'b')} as d from s a join s b on a.part <> 0 and b.part = 0) select part, a, b, round(d, 6) as d from (select *, row_number() over (partition by part order by d, a, b) as rn from j) where rn = 1", "v_xyz")
def g22_part_bridges(p):
    return rounded(skeleton.part_bridges(p.select("id", (F.col("seg") % 4).alias("part"), "x", "y", "z"), 300.0))


@query(f"with {_nearest('kn', 'v_xyz', 'v_xyz', 'a.seg = b.seg', 3, 1e9)} select distinct least(a, b) as src, greatest(a, b) as dst from kn", "v_xyz")
def g24_cloud_edges(p):
    return skeleton.cloud_fragment(p, 800.0)[0]


@query(
    "with c as (select seg, avg(x) as mx, avg(y) as my, avg(z) as mz, max(x) - min(x) as sx, max(y) - min(y) as sy, max(z) - min(z) as sz from v_xyz group by 1), t as (select p.seg, p.id, case when sx >= greatest(sy, sz) then x when sy >= greatest(sx, sz) then y else z end as t, sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)) as d from v_xyz p join c on p.seg = c.seg) select seg, arg_min(id, t) as first_end, arg_max(id, t) as last_end, round(avg(d), 6) as radius from t group by 1",
    "v_xyz",
)
def g24_cloud_ends(p):
    return rounded(skeleton.cloud_ends(p))


@query(
    f"with recursive {_reach('select id as node from v_xyz', f'select a.id as a, b.id as b from v_xyz a join v_xyz b on a.seg = b.seg and a.id < b.id where ' + _gap('a', 'b') + ' <= 1500')} select p.seg, low.cluster as part, count(*) as n, round(avg(p.x), 6) as x from low join v_xyz p on low.node = p.id group by 1, 2",
    "v_xyz",
)
def g26_partial_neurons(p):
    return rounded(skeleton.partial_neurons(p, 1500.0)).select("seg", "part", "n", "x")


# Features


@query(
    f"""with {_HEAP}, dg as (select seg, v, count(*) as d from (select seg, vid as v from hp where parent is not null union all select seg, parent from hp where parent is not null) group by 1, 2),
    d as (select rw.seg, count(*) as n_vertices, cast(sum(case when d >= 3 then 1 else 0 end) as bigint) as branches, cast(sum(case when d = 1 then 1 else 0 end) as bigint) as tips, max(d) as max_degree, cast(sum(case when rw.id % 50 + 50 >= 98 then 1 else 0 end) as bigint) as big_vertices from rw left join dg on dg.v = rw.id group by 1),
    l as (select seg, round(sum(len), 4) as cable, round(max(len), 6) as longest from hp group by 1) select d.seg as frag_id, n_vertices, branches, tips, max_degree, big_vertices, cable, longest from d join l on d.seg = l.seg""",
    "v_xyz",
)
def m3_topology(p):
    out = models.topology_features(*_heap(p), 98.0, 1.0)
    return rounded(out.withColumn("cable", F.round("cable", 4))).select("frag_id", "n_vertices", "branches", "tips", "max_degree", "big_vertices", "cable", "longest")


@query("select node, round(avg(p), 6) as mean_f from (select e.src as node, cast(n.label as double) as p from v_edge e join v_node n on e.dst = n.node union all select e.dst, cast(n.label as double) from v_edge e join v_node n on e.src = n.node) group by 1", "v_edge", "v_node")
def m6_neighbour_means(e, n):
    return rounded(models.neighbour_means(e, n.select("node", F.col("label").cast("double").alias("f")), ["f"]))


@query("select id, round((x * z + y * y) / (sqrt(x * x + y * y) * sqrt(z * z + y * y)), 6) as cos from v_xyz where x * x + y * y > 0 and z * z + y * y > 0", "v_xyz")
def m7_cosine(p):
    rows = p.where("x * x + y * y > 0 and z * z + y * y > 0")
    return rounded(rows.select("id", C.cosine(F.array("x", "y"), F.array("z", "y")).alias("cos")))


@query(None, "v_xyz")
def m1_shape_embedding(p):
    return models.shape_embedding(p.select(F.col("seg").alias("group"), "id", "x", "y", "z", F.lit(10.0).alias("r"))).select("group", "dna")


@query(None, "v_xyz")
def m2_cloud_features(p):
    return models.cloud_features(p.select("id", F.col("seg").alias("group"), "x", "y", "z"), 1500.0)


@query(None, "v_xyz")
def m4_seam_descriptor(p):
    v, e = _heap(p)
    return models.seam_descriptor(v, e, v.select("frag_id", "vid", (F.col("vid") % 2).alias("side")), 2)


@query(None, "v_score")
def m5_stratum_auc(s):
    rows = s.select(F.col("id").alias("group"), "p", (F.col("p") * F.col("p")).alias("q"), "y", "stratum")
    return models.stratum_auc(models.cross_validated(rows, ["p", "q"], folds=2))


@query(None, "v_xyz")
def g11_stitch(p):
    supers = p.groupBy(F.col("seg").alias("super_id")).agg(F.count("*").alias("n_obs"), F.bool_or(F.col("id") % 400 == 0).alias("has_soma"))
    tiled = supers.select("super_id", (F.col("super_id") % 4).alias("tile_id"), F.array((F.col("super_id") + 1).cast("double"), F.lit(3.0)).alias("dna"))
    found = stitch.stitch_candidates(p.select("id", F.col("seg").alias("super_id"), "x", "y", "z"), tiled, 900.0)
    forced = supers.where("super_id % 9 = 1").select(F.col("super_id").alias("i"), (F.col("super_id") + 1).alias("j"))
    return stitch.stitch(supers, forced, found, 0.3, 400)[0]


@query(None, "v_xyz")
def g11_two_level_stitch(p):
    """Tiles with halos, clusters of each tile as super fragments, links by shared keys and by endpoints, and every observation's stitched cluster."""
    tiles = stitch.tile_grid(p, 2, 2, 400.0, ("x", "y"))
    parts = tiles.join(p, "id").select("id", F.col("id").alias("key"), "tile_id", "core", F.col("seg").alias("cluster"), F.col("id").alias("atom"), "label", (F.col("id") % 400 == 0).alias("has_soma"), F.array((F.col("seg") + 1).cast("double"), F.lit(3.0)).alias("dna"), "x", "y", "z")
    return stitch.two_level_stitch(parts, 300.0, min_shared=2, min_score=0.3, max_obs=400)[0]


# Streams


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.as_stream(spark, f"{folder}/events.parquet*", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", 1000)


def r2_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The events, written once by a job that is run twice."""
    tmp = Scratch(spark, f"ingest-{uuid4().hex}")
    path, mark = tmp.path("boxes"), tmp.path("checkpoint")
    for _ in range(2):
        rows = _events(spark, folder).select("event_id", "user_id")
        jobs.ingest_boxes(rows, lambda df: df.write.mode("append").parquet(path), mark).awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint").parquet(path)


def r3_first_of_each(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tiles deliver them, three days a tile: again in the next tile, and again seven tiles on, long after the watermark of five days.

    The job stops after each tile and goes on from its checkpoint with the next.
    """
    tmp = Scratch(spark, f"first-{uuid4().hex}")
    tiles, mark, out = tmp.path("tiles"), tmp.path("checkpoint"), tmp.path("rows")
    events = read_table(spark, folder, "events").select("event_id", "ts", F.floor(F.unix_timestamp("ts") / 259200).alias("own"))
    again = F.array(*[F.struct(F.lit(n).alias("after"), F.expr(f"interval {h} hours").alias("later")) for n, h in ((0, 0), (0, 1), (1, 2), (7, 21 * 24))])
    told = events.withColumn("_a", F.explode(again)).select("event_id", (F.col("ts") + F.col("_a.later")).alias("ts"), (F.col("own") + F.col("_a.after")).alias("tile"))
    parted = tmp.path("told")
    told.write.partitionBy("tile").parquet(parted)  # read and dealt once, however many tiles
    told = spark.read.schema("event_id bigint, ts timestamp, tile bigint").parquet(parted)
    for tile in sorted(r["tile"] for r in told.select("tile").distinct().collect()):
        told.where(F.col("tile") == tile).drop("tile").write.mode("append").parquet(tiles)
        first = jobs.first_of_each(jobs.as_stream(spark, tiles, "event_id bigint, ts timestamp", 1000), "event_id", "ts", "5 days")
        jobs.landed(first, out, "append")
    return spark.read.schema("event_id bigint").parquet(out)


def _edit_log(events: DataFrame) -> DataFrame:
    """A third of the events as merges and splits of their user's eight labels."""
    a = F.expr("(event_id div 3) % 8")
    b = F.expr("((event_id div 3) % 8 + 1 + (event_id div 24) % 7) % 8")
    label = lambda k: F.col("user_id") * 8 + k
    return events.where("event_id % 3 = 0").select(F.col("event_id").alias("edit_id"), "ts", F.when(F.col("event_id") % 2 == 0, "merge").otherwise("split").alias("op"), label(a).alias("a"), label(b).alias("b"))


def r4_edit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pairs of an ordered log of merges and splits, as far as a watermark of five days has settled it."""
    events = read_table(spark, folder, "events")
    labels = events.select(F.col("event_id").alias("id"), (F.col("user_id") * 8 + F.col("event_id") % 4).alias("label"))
    moved = events.select("user_id", F.col("event_id").alias("edit_id")).where("edit_id % 3 = 0 and edit_id % 2 = 1").join(events.select("user_id", F.col("event_id").alias("id")), "user_id").where("(id + edit_id div 3) % 3 = 0").select("edit_id", "id")
    path = Scratch(spark, f"log-{uuid4().hex}").path("log")
    jobs.follow_edits(jobs.settled_edits(_edit_log(_events(spark, folder)), "5 days"), labels, moved, path).awaitTermination()
    return spark.read.schema("edit_id long, op string, i long, j long, y int").parquet(f"{path}/pairs/*")


QUERIES |= {"r2_ingest": r2_ingest, "r3_first_of_each": r3_first_of_each, "r4_edit_log": r4_edit_log}
ORACLE_SQL |= {
    "r2_ingest": "select event_id, user_id from events",
    "r3_first_of_each": "select event_id from events union all select event_id from events",
    "r4_edit_log": """with recursive
    e as (select event_id as edit_id, user_id as u, ts, case when event_id % 2 = 0 then 'merge' else 'split' end as op,
        user_id * 8 + (event_id // 3) % 8 as a, user_id * 8 + ((event_id // 3) % 8 + 1 + (event_id // 24) % 7) % 8 as b from events where event_id % 3 = 0),
    s as (select *, row_number() over (partition by u order by ts, edit_id) as k from e
        where epoch_us(ts) <= (select max(epoch_us(ts)) // 1000 * 1000 - 432000000000 from e)),
    st(u, k, id, label) as (select user_id, 0, event_id, user_id * 8 + event_id % 4 from events
        union all select st.u, st.k + 1, st.id, case when op = 'merge' and label = b then a when op = 'split' and label = a and (id + edit_id // 3) % 3 = 0 then b else label end
        from st join s on s.u = st.u and s.k = st.k + 1),
    m as (select edit_id, op, label = b as far, id, row_number() over (partition by edit_id, label order by id) as r
        from s join st on st.u = s.u and st.k = case when op = 'merge' then s.k - 1 else s.k end and label in (a, b))
    select m.edit_id, m.op, least(m.id, o.id) as i, greatest(m.id, o.id) as j, case when m.op = 'merge' then 1 else 0 end as y
    from m join m o on m.edit_id = o.edit_id and o.far and not m.far and m.r <= 10 and o.r <= 10""",
}
