"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words (cut at ASCII white space), each weighted by its count.  For every
sample k a word draws r and c from Gamma(2, 1) and b from [0, 1), all from hashes of the word
and k; with weight w it takes t = floor(ln w / r + b) and the value
ln c - r * (t + 1 - b), and the sample is the word and t of the least value.  Two documents agree in a sample
with the probability of their generalised Jaccard similarity, sum of least weights by
sum of greatest.  The value itself tells word and t, so a fingerprint holds 16 bits of its
hash for each sample.

Texts are shuffled by id once; word counts and minima are then grouped within those
partitions without another shuffle, a document's words never meet in one row, and a document that
is a third of the corpus takes one pass of a hash aggregate.

Defined cases: a null text is empty; a text without words has samples of its own kind, equal
for all such texts; rows that repeat an id are documents of their own, in the
order of their texts' hashes; rows without an id are fingerprinted one by one without a next document; a text of any length is
one row until its words are counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

GAPS = "\t\n\x0b\x0c\r"


def _value(k: int) -> tuple[F.Column, F.Column, F.Column]:
    """ln c, r and b of sample k from the word's hash ``h``."""
    one, two = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))

    def unit(bits: F.Column, n: int) -> F.Column:  # in (0, 1)
        return (bits + F.lit(0.5)) * F.lit(2.0**-n)

    r = -F.log(unit(F.shiftrightunsigned(one, 32), 32) * unit(one.bitwiseAND(F.lit(0xFFFFFFFF)), 32))
    c = -F.log(unit(F.shiftrightunsigned(two, 42), 22) * unit(F.shiftrightunsigned(two, 21).bitwiseAND(F.lit(0x1FFFFF)), 21))
    return F.log(c), r, unit(two.bitwiseAND(F.lit(0x1FFFFF)), 21)


def sketches(texts: DataFrame, key: str, variants: list[str], samples: int) -> DataFrame:
    """``key`` and an array of ``samples`` ints for each text column; rows must be partitioned by the key."""
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.translate(F.coalesce(F.col(c), F.lit("")), GAPS, " " * len(GAPS)).alias("t")) for v, c in enumerate(variants)]))
    words = texts.select(key, both.alias("x")).select(key, F.col("x.v").alias("v"), F.explode(F.split("x.t", " ")).alias("word"))
    counts = words.groupBy(key, "word").agg(*[F.sum(F.when((F.col("v") == v) & (F.col("word") != ""), 1).otherwise(0)).alias(f"n{v}") for v in range(len(variants))])
    logs = counts.select(key, F.xxhash64("word").alias("h"), *[F.when(F.col(f"n{v}") > 0, F.log(F.col(f"n{v}").cast("double"))).alias(f"w{v}") for v in range(len(variants))])
    minima = []
    for k in range(samples):
        ln_c, r, b = _value(k)
        minima += [F.min(ln_c - r * (F.floor(F.col(f"w{v}") / r + b) + 1 - b)).alias(f"s{v}_{k}") for v in range(len(variants))]
    low = logs.groupBy(key).agg(*minima)
    slot = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit(-1e300))).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return low.select(key, *[F.array(*[slot(f"s{v}_{k}") for k in range(samples)]).alias(f"fp_{c}") for v, c in enumerate(variants)])


def likeness(a: str | F.Column, b: str | F.Column) -> F.Column:
    """Share of samples in which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(fp: str) -> F.Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


ORDER = ["id", "h", "key"]


def neighbours(rows: DataFrame, tmp: Scratch, parts: int) -> DataFrame:
    """``key, n, next_key, prev_key, prev_n`` of rows ``id, h, key, n`` with distinct keys; in their order they are a ring.

    Rows are dealt by range; only each part's first and last row meet in one place.
    """
    dealt = tmp.write(rows.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "keys")
    inside, order = W.partitionBy("part").orderBy(*ORDER), F.struct(*ORDER)
    ends = dealt.groupBy("part").agg(F.min_by("key", order).alias("first_key"), F.max_by("key", order).alias("last_key"), F.max_by("n", order).alias("last_n"))
    ring, every = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per part
    bridge = ends.select(
        "part",
        F.coalesce(F.lead("first_key").over(ring), F.first("first_key").over(every)).alias("onward"),
        F.coalesce(F.lag("last_key").over(ring), F.last("last_key").over(every)).alias("back"),
        F.coalesce(F.lag("last_n").over(ring), F.last("last_n").over(every)).alias("back_n"),
    )
    beside = dealt.withColumn("next_key", F.lead("key").over(inside)).withColumn("prev_key", F.lag("key").over(inside)).withColumn("prev_n", F.lag("n").over(inside))
    full = beside.join(bridge, "part")
    before = F.when(F.col("prev_key").isNull(), F.col("back_n")).otherwise(F.col("prev_n"))
    return full.select("key", "id", "n", F.coalesce("next_key", "onward").alias("next_key"), F.coalesce("prev_key", "back").alias("prev_key"), before.alias("prev_n"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 32) -> DataFrame:
    """``id, n_chars, edited_sha256, fp_text, fp_edited, fp_next`` of every document.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "fingerprints")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("id is not null").withColumn("key", F.col("id"))
    sizes = tmp.write(known.select("id", F.lit(0).cast("long").alias("h"), "key", F.length("text").alias("n")), "sizes")
    if not sizes.groupBy("id").count().where("count > 1").isEmpty():  # rows that share an id need keys of their own
        known = tmp.write(known.withColumn("key", F.monotonically_increasing_id()), "rows")
        sizes = tmp.write(known.select("id", F.xxhash64("text").alias("h"), "key", F.length("text").alias("n")), "sizes")
    beside = tmp.write(neighbours(sizes, tmp, parts), "beside")
    dealt = known.select("key", "text").repartition(parts, "key").join(beside, "key")
    heads = dealt.select(F.col("prev_key").alias("key"), F.expr("substring(text, 1, prev_n div 4)").alias("head"))
    joined = dealt.select("key", "n", "text").join(heads.repartition(parts, "key"), "key")
    edited = joined.select("key", "text", F.expr("substring(text, 1, n - n div 4) || head").alias("edited"))
    fps = sketches(edited.select("key", "text", "edited"), "key", ["text", "edited"], samples)
    digest = edited.select("key", F.sha2("edited", 256).alias("edited_sha256"))
    fps = tmp.write(fps.join(digest, "key"), "fps")
    next_fp = fps.select(F.col("key").alias("next_key"), F.col("fp_text").alias("fp_next"))
    whole = fps.join(beside.select("key", "id", "n", "next_key"), "key").join(next_fp, "next_key")
    out = whole.select("id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fp_text", "fp_edited", "fp_next")
    lone = rows.where("id is null").withColumn("row", F.monotonically_increasing_id())
    lone = tmp.write(lone.select("row", "text", F.expr("substring(text, 1, length(text) - length(text) div 4)").alias("edited")), "lone")
    if lone.isEmpty():
        return out
    apart = sketches(lone.repartition("row"), "row", ["text", "edited"], samples).join(lone, "row")
    return out.unionByName(apart.select(F.lit(None).cast("long").alias("id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp_text", "fp_edited", F.lit(None).cast("array<int>").alias("fp_next")))
