"""Rows that meet by a key which some keys hold far more often than others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

#: To join by, beside the key.
BLOCKS = ["_i", "_j"]


def shuffled(rows: DataFrame) -> DataFrame:
    """The rows, not to be broadcast in a join: Spark judges exploded rows by the size of what they were made from, which may be a small part of it."""
    return rows.hint("merge")


def dealt(rows: DataFrame, key: str, by: str, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The rows twice, so that a join of both by the key and ``BLOCKS`` lets each two rows of a key meet once.

    A key of more than ``block`` rows is dealt into blocks by a hash of ``by``, and each two blocks meet under a key of their own: a row is sent
    once to each block of the other side, and no task sees more than two blocks of a key.  Keys of one block stay as they are.
    """
    heavy = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_b")).where("_b > 1")
    own = F.pmod(F.xxhash64(by), F.coalesce("_b", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_b", F.lit(1)) - 1))
    sized = rows.join(heavy, key, "left")
    return tuple(sized.withColumn(mine, own).withColumn(other, every).drop("_b") for mine, other in (("_i", "_j"), ("_j", "_i")))


def counted(rows: DataFrame, n: F.Column, name: str) -> DataFrame:
    """Each row n times, with the numbers from 0; no array is longer than 65,536."""
    part = rows.withColumn("_n0", n.cast("long")).where("_n0 > 0").withColumn("_hi", F.explode(F.expr("sequence(0L, (_n0 - 1) div 65536)")))
    return part.withColumn(name, F.explode(F.expr("sequence(_hi * 65536, least(_hi * 65536 + 65535, _n0 - 1))"))).drop("_n0", "_hi")


def in_blocks(rows: DataFrame, key: str, member: F.Column, by: str, block: int = 1000) -> DataFrame:
    """``key, i, blocks, members``: the members of a key, arrays of about ``block`` of them in hash order of ``by``, and how many arrays the key has."""
    sized = rows.join(rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), key)
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int").alias("i")
    return sized.select(key, "blocks", own, member.alias("_m")).groupBy(key, "blocks", "i").agg(F.collect_list("_m").alias("members"))


def chunks(members: str, size: int = 8) -> F.Column:
    """A row for each ``size`` elements of an array.

    What an input row of two nested ``explode`` makes is held at once before it goes on, so one of the arrays has to be short.
    """
    starts = F.sequence(F.lit(1), F.size(members), F.lit(size))
    return F.explode(F.transform(starts, lambda at: F.slice(members, at, size)))


def tasks_of(spark: SparkSession, pairs: float | None, each: int = 20_000_000) -> int:
    """How many tasks make that many pairs: what is shuffled says little of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0.0) / each))


def all_pairs(rows: DataFrame, key: str, member: F.Column, by: str, block: int = 4000, both: bool = False) -> DataFrame:
    """``key, a, b``: each two unlike members of a key once, or both ways.

    Blocks of members travel, of one side as arrays and of the other cut into short ones, and pairs are made where two blocks meet, in as many tasks as there
    are pairs for: what is shuffled is a small share of the pairs, and no task holds more than two blocks and some thousand pairs.
    """
    rows = rows.where(F.col(by).isNotNull())
    n = F.count("*").cast("double")
    tasks = tasks_of(rows.sparkSession, rows.groupBy(key).agg((n * n).alias("n")).agg(F.sum("n")).first()[0])
    held = in_blocks(rows, key, member, by, block)
    at = ["_i", "_j"]
    left = held.select(key, F.col("i").alias("_i"), "blocks", chunks("members").alias("_l"))
    left = left.select(key, "_i", F.explode(F.sequence(F.lit(0) if both else F.col("_i"), F.col("blocks") - 1)).alias("_j"), "_l")
    right = held.select(key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1 if both else F.col("i"))).alias("_i"), F.col("i").alias("_j"), F.col("members").alias("_r"))
    met = shuffled(left.repartition(tasks, key, *at)).join(right.repartition(tasks, key, *at), [key, *at])
    made = met.select(key, *at, F.explode("_l").alias("a"), "_r").select(key, *at, "a", F.explode("_r").alias("b"))
    return made.where((F.col("_i") != F.col("_j")) | (F.col("a") != F.col("b") if both else F.col("a") < F.col("b"))).select(key, "a", "b")


def members_met(asked: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """The asked pairs of keys, columns ``a`` and ``b``, with ``_l, _r``: short arrays of members of a, each beside every block of b, for two ``explode``; left and right come of ``in_blocks``.

    As in ``all_pairs`` what is shuffled is a small share of the pairs, and tasks are as many as there are pairs for.
    """
    size = lambda rows, c, n: rows.groupBy(F.col(key).alias(c)).agg(F.sum(F.size("members")).cast("double").alias(n), F.max("blocks").alias(f"{n}b"))
    asked = asked.join(size(left, a, "_n"), a).join(size(right, b, "_m"), b)
    tasks = tasks_of(asked.sparkSession, asked.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0])
    at = ["_i", "_j"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    short = shuffled(asked.select(a, b, "_mb")).join(left.select(F.col(key).alias(a), F.col("i").alias("_i"), chunks("members").alias("_l")), a).select(a, b, "_i", every("_mb").alias("_j"), "_l")
    long = shuffled(asked.drop("_n", "_m", "_mb")).join(right.select(F.col(key).alias(b), F.col("i").alias("_j"), F.col("members").alias("_r")), b).withColumn("_i", every("_nb")).drop("_nb")
    return shuffled(short.repartition(tasks, a, b, *at)).join(long.repartition(tasks, a, b, *at), [a, b, *at])


def lowest(rows: DataFrame, n: int, by: F.Column, *ties: str) -> DataFrame:
    """The n rows that are first in order of the long ``by``, a hash, then of ``ties``; what ``orderBy(...).limit(n)`` gives, but no task holds n rows.

    Rows are counted by the upper 16 bits of ``by``: of those in the bin where the n-th row lies some are taken, of lower bins all.
    """
    held = Scratch(rows.sparkSession, "lowest").write(rows.withColumn("_h", by).withColumn("_bin", F.shiftright("_h", 48)), "rows")
    before, edge = 0, None
    for edge, count in sorted(tuple(r) for r in held.groupBy("_bin").count().collect()):  # 65,536 bins at most
        if before + count >= n:
            break
        before += count
    else:
        return held.drop("_h", "_bin")
    some = held.where(F.col("_bin") == edge).orderBy("_h", *ties).limit(n - before)
    return held.where(F.col("_bin") < edge).unionByName(some).drop("_h", "_bin")
