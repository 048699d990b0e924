"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result to the shared scratch
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import mixing, packing, privacy, quality, simhash
from pointweave.sources.scratch import Scratch
from pointweave.sources.tables import read_table


def _whole(docs: DataFrame, *more: F.Column) -> DataFrame:
    """The documents with all their columns in one, ``row``, so that none clashes with what a stage adds."""
    return docs.select(F.struct(*docs.columns).alias("row"), *more)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(_whole(docs), model, text_col="row.text").where("score >= 0.5").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Copies link at a Jaccard similarity of 0.8 or more of their distinct 5-word shingles: SimHashes of the shingles find
    the candidates, and each link is checked on the shingles themselves.  Rows that share an id are documents of their own,
    of which a group keeps one, by the hash of all columns; of rows that agree in all columns one stays.  Rows without an id stay.
    """
    kept = simhash.near_copies(docs).where("first").select("id", "h")
    kept = Scratch(spark, "kept").write(kept.groupBy("id", "h").agg(F.count("*").alias("n")), "rows")
    here = _whole(docs, F.col("doc_id").cast("long").alias("id"), simhash.row_hash(docs).alias("h"))
    same = lambda some: here.join(some, ["id", "h"], "left_semi").select("row")
    once = same(kept.where("n = 1")).unionByName(same(kept.where("n > 1")).distinct())
    return once.unionByName(here.where("id is null").select("row")).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it replaced by their kinds."""
    return privacy.sanitised(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tier_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), table_bytes=80_000_000)  # earlier stages' workers hold memory too


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("tier_packing", tier_packing),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tmp.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
