"""The batch loops over growing tables, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointweave.operators.edits import apply_edits, edit_pairs

_STORE = "spark.sql.streaming.stateStore.providerClass"


def root_counts(pairs: DataFrame, pre: str = "pre_root", post: str = "post_root") -> DataFrame:
    """Running synapse counts per root; write with output mode update or complete (R1).  State grows with the roots."""
    ids = pairs.select(F.explode(F.array(F.struct(F.col(pre).alias("root"), F.lit(0).alias("side")), F.struct(F.col(post).alias("root"), F.lit(1).alias("side")))).alias("s")).select("s.*").where("root <> 0")
    return ids.groupBy("root").agg(F.count_if(F.col("side") == 0).alias("n_pre"), F.count_if(F.col("side") == 1).alias("n_post"))


def ingest_boxes(boxes: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Writes every box that has not been written, then stops; the checkpoint is what makes it resumable (R2)."""
    return boxes.writeStream.foreachBatch(lambda df, _: write(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(rows: DataFrame, key: str = "syn_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows without those whose id came before within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def labelled_edits(edits: DataFrame, labels: DataFrame) -> DataFrame:
    """Edits joined with a snapshot of labels (R4); edits (edit_id, op, seg, ts), labels (seg, label)."""
    return edits.join(labels, "seg").withColumn("together", (F.col("op") == "merge").cast("int"))


def edit_rates(edits: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, op, n``: edits per window and kind; rows later than the watermark are dropped."""
    return edits.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")


def settled_edits(edits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Edits (edit_id, ts, op, a, b) once the watermark has passed them, each once (R4); write with output mode append.

    What is released before can't come after what is released later, whatever the order of arrival.  Edits later than the watermark are dropped.
    """
    return edits.withWatermark("ts", late).groupBy("ts", "edit_id", "op", "a", "b").count().drop("count")


def follow_edits(settled: DataFrame, labels: DataFrame, moved: DataFrame, path: str, cap: int = 10) -> StreamingQuery:
    """Applies settled edits to a snapshot of labels as they are released, and stops when all have been read.

    Batch n writes ``path/labels/n``, all labels after it, from those of batch n - 1, and ``path/pairs/n``, its labelled pairs.  A batch that
    is run again after a failure writes the same.  A batch without edits writes its labels again; compact or drop old folders at will.
    """
    spark = labels.sparkSession

    def step(edits: DataFrame, n: int) -> None:
        now = spark.read.schema("id long, label long").parquet(f"{path}/labels/{n - 1}") if n else labels
        after, sides = apply_edits(now, edits, moved, cap)
        after.write.mode("overwrite").parquet(f"{path}/labels/{n}")
        edit_pairs(sides).write.mode("overwrite").parquet(f"{path}/pairs/{n}")

    return settled.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def as_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that first start here keep their state in RocksDB, not in the heap, where the state of a restarted stream would lie beside that of its earlier runs until Spark drops it."""
    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, had) if had else spark.conf.unset(_STORE)


def landed(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All that has arrived, in files: the last state of a complete stream, every row of one that appends."""
    how = "overwrite" if mode == "complete" else "append"
    sink = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode(how).parquet(path)).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    with on_disk(stream.sparkSession):
        query = sink.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that has arrived, through a memory table; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
