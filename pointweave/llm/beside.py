"""Rows mapped beside a table that holds one value for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Work = Callable[[pa.RecordBatch, Callable[[str], object]], pa.RecordBatch]


def mapped_beside(rows: DataFrame, key: str, table: DataFrame, work: Work, schema: str, broadcast_bytes: int = 32_000_000, salts: int = 64) -> DataFrame:
    """``work(batch, value_of)`` over all rows; ``value_of(key)`` is the key's value, or None.

    ``table`` has the key (a string) and ``value`` (a string or bytes), one row for each key.  Up to ``broadcast_bytes`` its
    values go to all tasks; beyond, each value is dealt under ``salts`` keys and each row to one of them, the
    values ahead of the rows, so that no task holds all rows of a key and no row carries a value.
    """
    size = table.agg(F.sum(F.octet_length("value") + F.octet_length(key))).first()[0] or 0
    if size <= broadcast_bytes:
        values = {r[key]: r["value"] for r in table.select(key, "value").collect()}  # bounded by broadcast_bytes
        shared = rows.sparkSession.sparkContext.broadcast(values)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield work(b, shared.value.get)

        return rows.mapInArrow(near, schema)

    salted = rows.select(F.col(key).alias("_key"), F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t != "boolean"]), F.lit(salts)).cast("int").alias("_salt"), F.lit(None).cast(table.schema["value"].dataType).alias("_value"), F.struct(*rows.columns).alias("_row"))
    values = table.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("value").alias("_value"), F.lit(None).cast(salted.schema["_row"].dataType).alias("_row"))
    both = salted.unionByName(values).repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", F.col("_row").isNotNull())

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, object] = (None, None)
        for b in batches:
            keys, is_row = b.column("_key").to_pylist(), b.column("_row").is_valid().to_pylist()
            at = 0
            while at < b.num_rows:
                if not is_row[at]:
                    held = keys[at], b.column("_value")[at].as_py()
                    at += 1
                    continue
                to = at
                while to < b.num_rows and is_row[to] and keys[to] == keys[at]:
                    to += 1
                one = held if held[0] == keys[at] else (keys[at], None)
                yield work(pa.RecordBatch.from_struct_array(b.column("_row").slice(at, to - at)), lambda k, one=one: one[1] if k == one[0] else None)
                at = to

    return both.mapInArrow(far, schema)
