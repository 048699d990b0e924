import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.operators import edits, pairs, sequence
from pointweave.sources.scratch import Scratch
from pointweave.streaming import jobs

EDITS = "edit_id long, ts timestamp, op string, a long, b long"


def plain(labels, log, moved, cap):
    """The same fold over the whole snapshot, one edit after another."""
    held, sides = {}, {}
    for i, label in labels:
        held.setdefault(label, set()).add(i)
    for edit, _, op, a, b in sorted(log, key=lambda e: (e[1], e[0])):
        x, y = held.setdefault(a, set()), held.setdefault(b, set())
        if op == "split":
            leave = x & moved.get(edit, set())
            x -= leave
            y |= leave
        for side, ids in enumerate((x, y)):
            if ids:
                sides[edit, op, side] = (len(ids), sorted(ids)[:cap])
        if op == "merge":
            x |= y
            held[b] = set()
    return {(i, label) for label, ids in held.items() for i in ids}, sides


def test_edits_apply_in_order_whatever_the_parts(spark):
    rng = random.Random(5)
    labels = [(i, rng.choice([7] * 20 + list(range(40)))) for i in range(900)]
    log, moved = [], {}
    for n in range(150):
        a, b = rng.sample(range(36), 2) if n % 3 else rng.sample([1, 2, 3, 7], 2)
        log.append((n, rng.randrange(60), rng.choice(["merge", "split"]), a, b))
        moved[n] = set(rng.sample(range(1000), 300))
    want, sides = plain(labels, log, moved, 4)
    frame = spark.createDataFrame([(e, t, op, a, b) for e, t, op, a, b in log] * 2, "edit_id long, t long, op string, a long, b long").withColumn("ts", F.timestamp_seconds("t"))
    odd = spark.createDataFrame([(900, None, "merge", 1, 2), (901, None, "rename", 1, 3), (None, None, "merge", 1, 3), (902, None, "merge", 5, 5)], "edit_id long, t long, op string, a long, b long").withColumn("ts", F.timestamp_seconds(F.lit(30)))
    odd = odd.where("op = 'rename' or a = b").unionByName(odd.where("edit_id = 900").withColumn("ts", F.lit(None).cast("timestamp"))).unionByName(odd.where("edit_id is null"))
    moves = spark.createDataFrame([(e, i) for e, ids in moved.items() for i in ids] + [(3, None), (None, 4)], "edit_id long, id long")
    points = spark.createDataFrame(labels + labels[:50] + [(None, 7), (5000, None)], "id long, label long").withColumn("part", F.lit("clash")).withColumn("family", F.lit("clash"))
    for chunk in (50_000, 100):
        after, got = edits.apply_edits(points, frame.unionByName(odd), moves, 4, chunk)
        assert {tuple(r) for r in after.select("id", "label").collect()} == want
        assert {(r["edit_id"], r["op"], r["side"]): (r["size"], r["ids"]) for r in got.collect()} == sides
    assert edits.apply_edits(points.limit(0), frame, moves)[0].count() == 0
    assert {tuple(r) for r in edits.apply_edits(points, frame.limit(0), moves)[0].collect()} == set(labels)


def test_a_part_is_read_in_runs():
    """Points of a label and what an edit moves are taken at once; each edit is one step."""
    rows = [(1, 0, None, None, 7, None, 0, i) for i in range(1000)] + [(1, 0, None, None, 8, None, 0, i) for i in range(3)]
    rows += [(1, 0, 5, "split", 7, 8, 1, i) for i in range(500)] + [(1, 0, 5, "split", 7, 8, 2, None), (1, 0, 6, "merge", 7, 8, 2, None), (1, 1, None, None, 8, None, 0, 1)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], edits._ROWS)
    assert edits._runs(batch) == [0, 1000, 1003, 1503, 1504, 1505]
    assert edits._runs(batch.slice(0, 0)) == [] and list(edits._fold(4)(iter([batch.slice(0, 0)])))[0].num_rows == 0
    sides = [r for out in edits._fold(4)(iter([batch.slice(0, 200), batch.slice(200)])) for r in out.to_pylist() if r["label"] is None]
    assert [(r["edit_id"], r["side"], r["size"], r["ids"]) for r in sides] == [(5, 0, 500, [500, 501, 502, 503]), (5, 1, 500, [0, 1, 2, 3]), (6, 0, 500, [500, 501, 502, 503]), (6, 1, 500, [0, 1, 2, 3])]


def test_pairs_of_edits(spark):
    labels = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, label long")
    log = spark.createDataFrame([(1, 5, "merge", 10, 20), (2, 6, "split", 10, 30)], "edit_id long, t long, op string, a long, b long").withColumn("ts", F.timestamp_seconds("t"))
    after, sides = edits.apply_edits(labels, log, spark.createDataFrame([(2, 3), (2, 2)], "edit_id long, id long"))
    assert {tuple(r) for r in edits.edit_pairs(sides).select("edit_id", "i", "j", "y").collect()} == {(1, 1, 3, 1), (1, 2, 3, 1), (2, 1, 2, 0), (2, 1, 3, 0)}
    assert {tuple(r) for r in after.collect()} == {(1, 10), (2, 30), (3, 30)}


def test_a_stream_of_edits_waits_for_late_ones(spark):
    path = Scratch(spark, "log").path("log")
    labels = spark.createDataFrame([(i, i) for i in range(8)], "id long, label long")
    moved = spark.createDataFrame([(2, 1)], "edit_id long, id long")
    say = lambda rows: spark.createDataFrame(rows, "edit_id long, t long, op string, a long, b long").select("edit_id", F.timestamp_seconds("t").alias("ts"), "op", "a", "b").coalesce(1).write.mode("append").parquet(path + "-in")

    def run():
        stream = jobs.settled_edits(jobs.as_stream(spark, path + "-in", EDITS), "100 seconds")
        jobs.follow_edits(stream, labels, moved, path).awaitTermination()
        return {r["edit_id"] for r in spark.read.parquet(f"{path}/pairs/*").collect()}

    say([(1, 1000, "merge", 0, 1), (3, 1090, "merge", 0, 2)])
    assert run() == set()  # both may still be preceded by others
    say([(2, 1050, "split", 0, 5), (2, 1050, "split", 0, 5), (4, 1400, "merge", 3, 4)])  # edit 2 comes after edit 3, and twice
    assert run() == {1, 2, 3}
    say([(5, 1100, "merge", 6, 7), (6, 1600, "merge", 6, 3)])  # edit 5 is too late
    assert run() == {1, 2, 3, 4}
    folders = [int(r["p"].rsplit("/", 2)[-2]) for r in spark.read.parquet(f"{path}/labels/*").select(F.input_file_name().alias("p")).distinct().collect()]
    last = spark.read.parquet(f"{path}/labels/{max(folders)}")
    assert {tuple(r) for r in last.collect()} == {(0, 0), (1, 5), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)}


def test_first_of_each_across_batches_and_restarts(spark):
    path = Scratch(spark, "first").path("in")
    got = []
    for rows in ([(1, 0), (1, 5), (2, 10)], [(1, 20), (3, 200)], [(4, 2000)], [(1, 2010), (2, 2020), (2, 2030)]):
        spark.createDataFrame(rows, "syn_id long, t long").select("syn_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        jobs.landed(jobs.first_of_each(jobs.as_stream(spark, path, "syn_id long, ts timestamp"), late="10 minutes"), path + "-out", "append")
        got.append(sorted(r["syn_id"] for r in spark.read.parquet(path + "-out").collect()))
    assert got == [[1, 2], [1, 2, 3], [1, 2, 3, 4], [1, 1, 2, 2, 3, 4]]


def test_state_of_restarted_streams_lies_outside_the_heap(spark):
    path = Scratch(spark, "state").path("in")
    spark.range(50).select(F.col("id").alias("syn_id"), F.timestamp_seconds("id").alias("ts")).write.parquet(path)
    jobs.landed(jobs.first_of_each(jobs.as_stream(spark, path, "syn_id long, ts timestamp")), path + "-out", "append")
    offsets = spark.read.text(path + "-out-checkpoint/offsets/0").where("value like '%providerClass%'").first()["value"]
    assert "RocksDBStateStoreProvider" in offsets and "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_gap_occupancy_by_brute_force(spark):
    rng = random.Random(2)
    obs = [(i, i % 3, *(rng.uniform(-4000, 4000) * (k < 2 or i % 2) for k in range(3))) for i in range(400)]
    obs += [(400, 0, *obs[0][2:]), (401, 0, *(float(v) for v in (4096, 0, 0))), (402, 0, 8192.0, 0.0, 0.0)]
    at = {o[0]: o for o in obs}
    ends = [tuple(rng.sample([o[0] for o in obs if o[1] == s], 2)) for s in range(3) for _ in range(60)] + [(0, 400), (401, 402)]
    frame = spark.createDataFrame(obs, "id long, seg long, x double, y double, z double")
    asked = spark.createDataFrame([(a, b, at[a][1], *at[a][2:], *at[b][2:]) for a, b in ends], "a long, b long, seg long, ax double, ay double, az double, bx double, by double, bz double")
    got = {(r["a"], r["b"]): r["occupancy"] for r in sequence.gap_occupancy(asked, frame, share=0.15, floor_nm=200.0).collect()}
    for a, b in ends:
        p, q = at[a][2:], at[b][2:]
        size = math.dist(p, q)
        bins = {0, 5}
        for o in obs if size else ():
            t = sum((o[2 + k] - p[k]) * (q[k] - p[k]) for k in range(3)) / size**2
            if o[1] == at[a][1] and 0 <= t <= 1 and math.dist(o[2:], [p[k] + t * (q[k] - p[k]) for k in range(3)]) <= max(0.15 * size, 200.0):
                bins.add(min(5, int(t * 6)))
        assert got[a, b] == (len(bins) / 6 if size else 1.0)


@pytest.mark.parametrize("few", [1, 4])
def test_gap_occupancy_in_a_crowd(spark, few):
    """Far more points in a cell than first answer, most of them off the tube; the cells of tubes are not broadcast; a segment without points has its ends."""
    rng = random.Random(few)
    obs = [(i, 0, *(rng.uniform(0, 900) for _ in range(3))) for i in range(600)] + [(600, 0, 0.0, 0.0, 0.0), (601, 0, 900.0, 900.0, 900.0)] + [(602 + i, 0, 300.0 + i % 2, 900.0, 0.0) for i in range(200)]
    ends = [(600, 601), (0, 1), (2, 3), (4, 5)]
    frame = spark.createDataFrame(obs, "id long, seg long, x double, y double, z double")
    asked = spark.createDataFrame([(a, b, 0, *obs[a][2:], *obs[b][2:]) for a, b in ends] + [(7, 8, 9, 0.0, 0.0, 0.0, 900.0, 0.0, 0.0)], "a long, b long, seg long, ax double, ay double, az double, bx double, by double, bz double")
    got = {(r["a"], r["b"]): r["occupancy"] for r in sequence.gap_occupancy(asked, frame, share=0.01, floor_nm=30.0, few=few).collect()}
    assert got.pop((7, 8)) == 2 / 6
    for a, b in ends:
        p, q = obs[a][2:], obs[b][2:]
        size, bins = math.dist(p, q), {0, 5}
        for o in obs:
            t = sum((o[2 + k] - p[k]) * (q[k] - p[k]) for k in range(3)) / size**2
            if 0 <= t <= 1 and math.dist(o[2:], [p[k] + t * (q[k] - p[k]) for k in range(3)]) <= max(0.01 * size, 30.0):
                bins.add(min(5, int(t * 6)))
        assert got[a, b] == len(bins) / 6


def test_cells_of_tubes_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, float(i * 37 % 1000), float(i * 53 % 1000), 0.0) for i in range(50)], "id long, seg long, x double, y double, z double")
    asked = rows.where("id < 5").selectExpr("id as a", "id + 1 as b", "seg", "x as ax", "y as ay", "z as az", "1000 - x as bx", "y as by", "z as bz")
    plans, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, label))
    made = sequence.gap_occupancy(asked, rows)
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    tubes = [p for p in plans if "array_distinct" in p]
    assert tubes and all("SortMergeJoin" in p and "array_distinct" not in b for p in tubes for b in p.split("BroadcastExchange")[1:])


def test_part_gaps_by_brute_force(spark):
    rng = random.Random(4)
    middle = [tuple(rng.uniform(0, 20_000) for _ in range(3)) for _ in range(12)]
    pts = [(g, *(m + rng.gauss(0, 300) for m in middle[g])) for g in range(12) for _ in range(rng.randint(1, 60))]
    pts += [(12, *pts[0][1:]), (13, -5.0e5, 0.0, 0.0), (13, None, 0.0, 0.0)]
    every = [(a, b) for a in range(14) for b in range(14) if a != b] + [(1, 99)]
    frame = spark.createDataFrame(pts, "part long, x double, y double, z double")
    for cell in (100.0, 1e7):
        got = {(r["pa"], r["pb"]): r["d"] for r in pairs.part_gaps(spark.createDataFrame(every * 2, "pa long, pb long"), frame, cell).collect()}
        assert got.keys() == set(every[:-1])
        for a, b in every[:-1]:
            want = min(math.dist(p[1:], q[1:]) for p in pts if p[0] == a and None not in p for q in pts if q[0] == b and None not in q)
            assert abs(got[a, b] - want) < 1e-6
    assert pairs.part_gaps(spark.createDataFrame(every, "pa long, pb long"), frame.limit(0), 100.0).count() == 0
