"""Views of the driver's tables as synapses, observations, partitions, edges and points, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.sources.tables import read_table

#: name -> (table, columns in SQL that both engines read alike, condition)
VIEWS = {
    "v_pair": ("lineitem", "l_suppkey + 1 as pre_root, l_partkey + 1000001 as post_root, l_returnflag as box_id", "true"),
    "v_obs": ("events", "event_id as syn_id, event_id as id, cast(event_id % 2 as int) as side, user_id as seg, (event_id * 7 + user_id) % 97 as label, (user_id * 3 + event_id % 3) % 40 - 1 as cluster, event_id % 23 as partner, value as value", "true"),
    "v_part": ("orders", "o_orderkey as id, o_custkey % 500 - 1 as pred, o_orderkey % 37 as true_id, o_custkey % 11 as grp, o_custkey + 1 as cust", "true"),
    "v_map": ("part", "p_partkey + 1000001 as root_base, cast(case when p_size = 1 then 0 else p_size end as bigint) as root_target", "true"),
    "v_smap": ("supplier", "s_suppkey + 1 as root_base, cast(s_nationkey as bigint) as root_target", "true"),
    "v_edge": ("part", "p_partkey as src, cast(case when p_partkey % 40 = 0 then floor(p_partkey / 2) else floor(p_partkey / 12) * 12 + (p_partkey * p_partkey) % 12 end as bigint) as dst, cast((p_partkey * 37) % 100 as double) / 100 as p, cast(p_partkey % 3 as int) as etype", "true"),
    "v_node": ("part", "p_partkey as node, cast(floor(p_partkey / 6) as bigint) % 60 as seg, cast(floor(p_partkey / 30) as bigint) % 45 as label, cast(floor(p_partkey / 20) as bigint) % 50 - 1 as cluster", "true"),
    "v_xyz": ("customer", "c_custkey as id, cast((c_custkey * 7919) % 10007 as double) as x, cast((c_custkey * 104729) % 9973 as double) as y, cast((c_custkey * 1299709) % 997 as double) as z, c_custkey % 25 as seg, c_custkey % 40 as label", "true"),
    "v_score": ("orders", "o_orderkey as id, cast((o_orderkey * 7919) % 1000 as double) / 1000 as p, cast(case when (o_orderkey * 31) % 1000 < (o_orderkey * 7919) % 1000 then 1 else 0 end as int) as y, o_custkey % 7 as stratum", "true"),
    "v_type": ("part", "p_type as cell_type", "true"),
    "v_proof": ("orders", "o_orderkey as id, case when o_orderkey % 2 = 0 then ' True ' when o_orderkey % 3 = 0 then 'yes' else 'f' end as axon, case when o_orderkey % 2 = 0 then '1' else 'no' end as dendrite", "true"),
    "v_soma": ("supplier", "s_suppkey as nucleus_id, s_suppkey * 2 + 1 as root_id, cast((s_suppkey * 7919) % 10007 as double) as x, cast((s_suppkey * 104729) % 9973 as double) as y, cast((s_suppkey * 1299709) % 997 as double) as z", "true"),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table, columns, where = VIEWS[name]
    return read_table(spark, folder, table).where(where).selectExpr(*[c.strip() for c in _split(columns)])


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def with_views(sql: str, *names: str) -> str:
    """The SQL with these views in front."""
    heads = ",\n".join(f"{n} as (select {VIEWS[n][1]} from {VIEWS[n][0]} where {VIEWS[n][2]})" for n in names)
    if sql.lstrip().lower().startswith("with recursive"):
        return f"with recursive {heads},\n{sql.lstrip()[len('with recursive'):]}"
    if sql.lstrip().lower().startswith("with"):
        return f"with {heads},\n{sql.lstrip()[len('with'):]}"
    return f"with {heads}\n{sql}"
