"""Ordered merges and splits of labels, applied to a snapshot."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.components import connected_components
from pointweave.sources.scratch import Scratch

_ROWS = ["family", "part", "edit_id", "op", "a", "b", "kind", "id"]
_POINT, _MOVE, _EDIT = 0, 1, 2


class _Group:
    """The ids of a label: a set, and a heap that may still hold ids which have left."""

    def __init__(self):
        self.ids, self.heap = set(), []

    def add(self, ids) -> None:
        for i in ids:
            if i not in self.ids:
                self.ids.add(i)
                heapq.heappush(self.heap, i)

    def first(self, n: int) -> list[int]:
        out: list[int] = []
        while self.heap and len(out) < n:
            i = heapq.heappop(self.heap)
            if i in self.ids and (not out or out[-1] != i):
                out.append(i)
        for i in out:
            heapq.heappush(self.heap, i)
        return out


def _runs(batch: pa.RecordBatch) -> list[int]:
    """Where runs of points of a label, or of what an edit moves, begin; an edit is a run of its own."""
    if not batch.num_rows:
        return []
    kind = batch.column(6).to_numpy()
    new = (kind == _EDIT) | (kind != np.roll(kind, 1))
    for c in (0, 1, 2, 4):
        value = pc.fill_null(batch.column(c), -1).to_numpy()  # a point has no edit: here its null need not differ from an id
        new |= value != np.roll(value, 1)
    new[0] = True
    return np.flatnonzero(new).tolist()


def _fold(cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies each part's edits in order to its points; holds the points of one part."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [("edit_id", pa.int64()), ("op", pa.string()), ("side", pa.int32()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("label", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def last(held: dict[int, _Group]) -> list[tuple]:
        return [(None, None, None, len(g.ids), list(g.ids), label) for label, g in held.items() if g.ids]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, moving = None, {}, []
        for batch in batches:
            out: list[tuple] = []
            at, ids = _runs(batch), batch.column(7)
            starts = batch.take(pa.array(at, pa.int64())).select(range(7))
            for lo, hi, family, part, edit_id, op, a, b, kind in zip(at, [*at[1:], batch.num_rows], *(c.to_pylist() for c in starts.columns)):
                if (family, part) != key:
                    out += last(held)
                    key, held, moving = (family, part), {}, []
                if kind == _POINT:
                    held.setdefault(a, _Group()).add(ids[lo:hi].to_pylist())
                    continue
                if kind == _MOVE:
                    moving += ids[lo:hi].to_pylist()
                    continue
                x, y = held.setdefault(a, _Group()), held.setdefault(b, _Group())
                if op == "split":
                    leave = x.ids.intersection(moving)
                    x.ids -= leave
                    y.add(leave)
                out += [(edit_id, op, side, len(g.ids), g.first(cap), None) for side, g in enumerate((x, y)) if g.ids]
                if op == "merge":
                    small, large = sorted((x, y), key=lambda g: len(g.ids))
                    large.add(small.ids)
                    held[a], held[b] = large, _Group()
                moving = []
            if out:
                yield rows(out)
        yield rows(last(held))

    return apply


def apply_edits(labels: DataFrame, edits: DataFrame, moved: DataFrame, cap: int = 10, chunk: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The snapshot after all edits (``id, label``), and each edit's sides (``edit_id, op, side, size, ids``).

    labels (id, label); edits (edit_id, ts, op, a, b); moved (edit_id, id).  In order of ts, then edit_id: a merge gives b's
    points the label a; a split gives those of a's points that ``moved`` lists for it the label b.  Sides are a (0) and b (1), before a merge and
    after a split; ``size`` counts all points of the side, ``ids`` are the ``cap`` lowest.  A side without points has no row.

    Edits that can affect each other share a family (component of their labels).  The points of a family are dealt into parts of about ``chunk``; each part
    sees the family's edits, sorted by Spark and read as they come, so a task holds the points of one part, and no family is ever gathered.
    Labels without edits pass by.  Edits that lack a value, name one label twice or are of another kind do nothing, nor do listed points that the label doesn't hold;
    repeated rows count once; points without id or label are left out.
    """
    spark = labels.sparkSession
    tmp = Scratch(spark, "edits")
    long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    points = labels.select(*long("id", "label")).where("id is not null and label is not null").distinct()
    sound = edits.select(*long("edit_id"), "ts", "op", *long("a", "b")).where("op in ('merge', 'split') and a <> b and ts is not null and edit_id is not null").distinct()
    sound = tmp.write(sound, "edits")
    if sound.isEmpty():
        return points, spark.createDataFrame([], "edit_id long, op string, side int, size long, ids array<long>")
    families = tmp.write(connected_components(sound, "a", "b").select(F.col("node").alias("label"), F.col("component").alias("family")), "families")
    held = tmp.write(points.join(families, "label", "left"), "points")
    parts = held.where("family is not null").groupBy("family").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    known = sound.join(families.withColumnRenamed("label", "a"), "a").join(parts, "family")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    own = held.join(parts, "family").select("family", part, F.lit(None).cast(sound.schema["ts"].dataType).alias("ts"), *none("long", "edit_id"), *none("string", "op"), F.col("label").alias("a"), *none("long", "b"), F.lit(_POINT).alias("kind"), "id")
    moves = known.join(moved.select(*long("edit_id", "id")).where("id is not null"), "edit_id").select("family", part, "ts", "edit_id", "op", "a", "b", F.lit(_MOVE).alias("kind"), "id")
    steps = known.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ts", "edit_id", "op", "a", "b", F.lit(_EDIT).alias("kind"), *none("long", "id"))
    dealt = own.unionByName(moves.where("op = 'split'")).unionByName(steps).repartition("family", "part")
    ordered = dealt.sortWithinPartitions("family", "part", F.col("ts").asc_nulls_first(), "edit_id", "op", "a", "b", "kind", "id").select(*_ROWS)
    done = tmp.write(ordered.mapInArrow(_fold(cap), "edit_id long, op string, side int, size long, ids array<long>, label long"), "done")
    after = done.where("label is not null").select(F.explode("ids").alias("id"), "label").unionByName(held.where("family is null").select("id", "label"))
    sides = done.where("label is null")
    size = sides.groupBy("edit_id", "op", "side").agg(F.sum("size").alias("size"))
    first = sides.select("edit_id", "op", "side", F.explode("ids").alias("id")).withColumn("_r", F.row_number().over(W.partitionBy("edit_id", "op", "side").orderBy("id"))).where(F.col("_r") <= cap)
    ids = first.groupBy("edit_id", "op", "side").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return after, size.join(ids, ["edit_id", "op", "side"])


def edit_pairs(sides: DataFrame) -> DataFrame:
    """``edit_id, op, i, j, y``: pairs of points over the two sides of each edit: of one cell (1) where it merged them, of two (0) where it split them."""
    end = lambda side, name: sides.where(F.col("side") == side).select("edit_id", "op", F.explode("ids").alias(name))
    both = end(0, "_i").join(end(1, "_j"), ["edit_id", "op"]).where("_i <> _j")
    return both.select("edit_id", "op", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), (F.col("op") == "merge").cast("int").alias("y"))
