"""Mixing sources to target weights with a low-discrepancy schedule.

``targets`` sets how many words each source owes.  ``schedule`` walks the points
``frac(i * golden ratio)`` through the sources' cumulative shares: each point is a slot
that the source it falls on must fill, and slots are ranked within their source.  Each
source lays out its documents in hash order, pass after pass, and cuts that line into
blocks of equal size; its slot of rank r takes its block r (``mix``).  Every prefix of the
schedule therefore holds the sources close to their shares, and a source gives as many
words as it has slots, give or take a block.

A block is the corpus divided by ``slots``, for sources that owe a hundred of these or more.  Smaller sources are
scheduled in tiers of their own, each with blocks 64 times smaller than the tier before, down to
one word; so every source owes a hundred blocks, or its blocks are single words.  A slot's ``place`` (0 to 1) is its share of
its tier's slots: in the order of places all tiers run side by side.

Everything about sources is a table: their ranks, targets and shares come from joins and
prefix sums, and only totals reach the driver, so there may be as many sources as documents.
Ranks and positions are prefix sums over a whole source, a third of which may be one
source; they are built from sums of fixed bins, so no task orders a whole source.

Defined cases: a null text has size 0 and is never taken; a null source is a source of
its own, last in order; ids may repeat or be null (rows that agree in id, size and source are
interchangeable); no words at all give targets of 0; a text of any length is one document, which blocks cut where they end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

GOLDEN = 0.6180339887498949
WORDS = r"[^\x20\x09-\x0D]+"
BINS = 1024
#: A source owes at least so many blocks, or its blocks are words; and how much smaller the next tier's blocks are.
LEAST_BLOCKS, FINER = 100, 64


def share_out(sizes: list[int], weights: list[float], passes: int = 3) -> list[float]:
    """All words shared by weight; a share stops at ``passes`` times its size and the rest takes the excess."""
    target, left, live = [0.0] * len(sizes), float(sum(sizes)), {i for i, s in enumerate(sizes) if s}
    while live:
        total = sum(weights[i] for i in live)
        over = [i for i in live if left * weights[i] / total > passes * sizes[i]]
        if not over:
            for i in live:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(passes * sizes[i])
            left -= target[i]
            live.discard(i)
    return target


def ranked(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """Adds ``s``, the row's place in the order of sources (null last), from ranges that are ordered apart."""
    last = F.col("source").isNull()
    dealt = tmp.write(rows.repartitionByRange(last, "source").withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy("_part").orderBy(last, "source")
    return dealt.join(parts, "_part").withColumn("s", F.row_number().over(inside) - 1 + F.col("_ahead")).drop("_part", "_ahead")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), passes: int = 3, slots: int = 100_000) -> DataFrame:
    """``source, s, source_size, target, tier, block, from_share, to_share`` (shares are those of the tier's slots).

    With r = passes * size / weight of each source, the targets are least(passes * size, level * weight) for the level at which they add
    up to all words; each round sets the level for the sources that the last one left below their stop.
    """
    tmp = Scratch(sized.sparkSession, "targets")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    known = tmp.write(ranked(sizes, tmp).withColumn("w", weight), "sources")
    stop = F.col("source_size") * passes
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        left = known.where((F.col("source_size") > 0) & (stop >= level * F.col("w")))
        free = left.agg(F.sum("w")).first()[0]
        held = known.agg(F.sum(F.when(stop < level * F.col("w"), stop)).alias("n")).first()[0] or 0
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    goals = known.withColumn("target", F.least(stop.cast("double"), level * F.col("w")))
    # Tiers.
    block, tier, size = max(1, int(total // slots)), F.lit(None).cast("int"), F.lit(None).cast("long")
    k = 0
    while True:
        fits = tier.isNull() & ((F.col("target") >= LEAST_BLOCKS * block) | F.lit(block == 1))
        tier, size = F.when(fits, F.lit(k)).otherwise(tier), F.when(fits, F.lit(block).cast("long")).otherwise(size)
        if block == 1:
            break
        block, k = max(1, block // FINER), k + 1
    goals = tmp.write(goals.select("source", "s", "source_size", "target", tier.alias("tier"), size.alias("block"), F.col("target").cast("decimal(38,6)").alias("exact")), "goals")
    n = goals.count()
    placed = amount_ahead(goals, "tier", ["s"], "exact", f"cast(s div {n // BINS + 1} as int)", "ahead")
    whole = goals.groupBy("tier").agg(F.sum("exact").alias("whole"))
    share = lambda c: F.when(F.col("whole") > 0, c.cast("double") / F.col("whole").cast("double")).otherwise(0.0)
    placed = placed.join(whole, "tier").withColumn("from_share", share(F.col("ahead"))).withColumn("to_share", share(F.col("ahead") + F.col("exact")))
    return tmp.write(placed.select("source", "s", "source_size", "target", "tier", "block", "from_share", "to_share"), "shares")


def amount_ahead(rows: DataFrame, key: str, order: list[str], size: str, bin_of: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows ahead in the key's order; ``bin_of`` is an expression that rises with the order."""
    here = rows.withColumn("_bin", F.expr(bin_of))
    sums = here.groupBy(key, "_bin").agg(F.sum(size).alias("_n"))
    over_bins = W.partitionBy(key).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    in_bin = W.partitionBy(key, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(key, "_bin", F.coalesce(F.sum("_n").over(over_bins), F.lit(0)).alias("_ahead"))
    within = here.withColumn("_within", F.coalesce(F.sum(size).over(in_bin), F.lit(0)))
    return within.join(ahead, [key, "_bin"]).withColumn(out, F.col("_ahead") + F.col("_within")).drop("_bin", "_ahead", "_within")


def schedule(goals: DataFrame) -> DataFrame:
    """``tier, slot, place, s, rank``: the source that fills each slot, and how many of its slots come before.

    A point meets only the sources that reach into its cell of the unit line; a tier has about as many cells as sources.
    """
    spark = goals.sparkSession
    tiers = goals.groupBy("tier", "block").agg(F.sum("target").alias("words"), F.count("*").alias("sources")).collect()  # a handful: blocks shrink 64-fold
    out = None
    for t in sorted(tiers):
        slots, cells = round(t["words"] / t["block"]), min(1 << 30, 1024 * (t["sources"] // 1024 + 1))
        points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}D) % 1.0D").alias("u"))
        mine = goals.where((F.col("tier") == t["tier"]) & (F.col("to_share") > F.col("from_share")))
        touched = mine.select("s", "from_share", "to_share", F.explode(F.expr(f"sequence(cast(floor(from_share * {cells}) as int), cast(floor(to_share * {cells}) as int))")).alias("cell"))
        fell = points.withColumn("cell", F.floor(F.col("u") * cells).cast("int")).join(touched, "cell").where("u >= from_share and u < to_share")
        fell = fell.select(F.lit(t["tier"]).alias("tier"), "slot", "s", F.lit(1).alias("one"))
        got = amount_ahead(fell, "s", ["slot"], "one", f"slot div {slots // BINS + 1}", "rank")
        got = got.select("tier", "slot", ((F.col("slot") + 0.5) / max(1, slots)).alias("place"), "s", "rank")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "tier int, slot long, place double, s long, rank long")


class Mix(NamedTuple):
    """``documents``: doc_id, size, s, source, source_size, target, at (words ahead in its source's line).
    ``pieces``: place, tier, slot, s, at, doc_id, pass, from_word, n_words; from_word counts within the document."""

    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_col: str | None = None, weights: tuple[float, ...] = (5, 2, 1), passes: int = 3, slots: int = 100_000) -> Mix:
    """Which words of which document fill which slot.  A source's line is in order of the hash of ``order_col`` (by default the id)."""
    tmp = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(order_col or id_col).alias("key"))
    sized = tmp.write(sized, "sizes")
    goals = targets(sized, weights, passes, slots)
    known = sized.join(goals.select(F.col("source").alias("_s"), "s", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lined = known.withColumn("h", F.xxhash64("key", "size", F.lit(7)))
    line = tmp.write(amount_ahead(lined, "s", ["h", "key", "size", "doc_id"], "size", f"shiftright(h, {64 - 10})", "at").drop("h", "key"), "line")
    passed = line.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("lo", F.col("pass") * F.col("source_size") + F.col("at"))
    cut = passed.where("lo < target + 2 * block").withColumn("rank", F.explode(F.expr("sequence(lo div block, (lo + size - 1) div block)")))
    from_word, to_word = F.greatest("lo", F.col("rank") * F.col("block")), F.least(F.col("lo") + F.col("size"), (F.col("rank") + 1) * F.col("block"))
    pieces = cut.select("s", "at", "doc_id", "pass", "rank", (from_word - F.col("lo")).alias("from_word"), (to_word - from_word).alias("n_words"))
    taken = pieces.join(schedule(goals), ["s", "rank"])
    return Mix(line.drop("block"), taken.select("place", "tier", "slot", "s", "at", "doc_id", "pass", "from_word", "n_words"))


def taken_words(mixed: Mix) -> DataFrame:
    """The documents with ``taken``, the words that the mix takes of each (repeats counted)."""
    sums = mixed.pieces.groupBy("s", "at").agg(F.sum("n_words").alias("taken"))
    full = mixed.documents.where("size > 0").join(sums, ["s", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return full.unionByName(mixed.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **how: object) -> DataFrame:
    """The documents as the mix takes them: a row for each pass, the last one of a source cut after the words that are taken."""
    tmp = Scratch(docs.sparkSession, "mixed")
    keyed = tmp.write(docs.select(F.struct(*docs.columns).alias("d")).withColumn("row", F.monotonically_increasing_id()), "keyed")
    flat = keyed.select("row", *[F.col(f"d.{c}").alias(f"_{c}") for c in docs.columns])
    mixed = mix(flat, "row", f"_{text_col}", "_source", order_col=f"_{id_col}", **how)
    # A pass takes a document from its first word on.
    taken = mixed.pieces.groupBy(F.col("doc_id").alias("row"), "pass").agg(F.sum("n_words").alias("words"), F.max("at").alias("at"))
    sizes = mixed.documents.select(F.col("doc_id").alias("row"), "size")
    rows = keyed.join(taken.join(sizes, "row"), "row")
    cut = F.array_join(F.slice(F.split(F.regexp_replace(F.col(f"d.{text_col}"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(f"d.{text_col}"))
    fresh = {text_col: text, length_col: F.length(text)}
    return rows.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col("d").getField(c).alias(c) for c in docs.columns])
