"""Ranked lexical search with the Best Position Algorithm.

Score of a document for an item: the sum over the item's distinct terms of ``weight * impact``, where a term's weight falls with the number of
documents that hold it and an impact is ``(10**9 * tf) div (1000 * tf + 8 * m)``, with m growing with the document's length.  All is
64-bit integer arithmetic but the logarithm of the weight.

The index.  One pass reads whole texts and keeps of each document its number of terms and the items' terms that it holds with their
frequencies; document frequencies and lengths are summed over all documents before any score is made.

The search.  Documents are searched in shards of about ``shard_postings`` postings, as they come, without a shuffle.  A shard has
a list for each term, its documents by falling impact.  For an item, all its lists are read downwards side by side.  A document met in one list
is looked up in all others at once (direct access), which gives its whole score and its *positions* there, and these
positions count as seen.  A list's best position is the last one up to which all are seen, often far below the last
one read.  No document that is still unseen can score more than the sum of the weighted impacts at the best positions (nothing for a list that
is seen whole), and when that is strictly below the k-th score so far, the item is done in this shard.  Equal is not enough: a
document that ties with the k-th may have the smaller id.

Each task keeps k documents an item, and the k best of all tasks are ranked by score, then id.

Items are searched in blocks of about ``block_bytes`` of their texts: a block's terms go to all tasks, and a larger set of items takes more
passes, never more memory.

Defined cases: a null text has no terms, and neither a null document nor an item without terms is in any result; rows that
repeat a document's id are documents of their own; items with equal id and terms are one; a null id ranks last among equal scores; texts of any
length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.sources.scratch import Scratch

#: ASCII letters lower-cased, other ASCII but digits to a blank; bytes beyond ASCII stay.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
_LOWEST = np.iinfo(np.int64).min


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split(b" ")


def _counted(text: bytes) -> Counter:
    out = Counter(terms_of(text))
    del out[b""]
    return out


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms``: the distinct terms of each item, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [[t.decode() for t in sorted(_counted(x or b""))] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(cut, f"item_id {kind}, terms array<string>").distinct()


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, held, tf``: of every document with terms their number, and places in ``terms`` with frequencies (packed 32-bit numbers)."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # bounded by the block of items

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            n, held, tf = [], [], []
            for text in b.column("text").to_pylist():
                found = _counted(text or b"")
                mine = [(place[t], c) for t, c in found.items() if t in place] if found else []
                n.append(found.total())
                held.append(np.array([k for k, _ in mine], np.int32).tobytes())
                tf.append(np.array([c for _, c in mine], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "held", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, held binary, tf binary").where("n > 0")


def weights(index: DataFrame, n_terms: int, docs: int) -> DataFrame:
    """``place, df, w`` of the terms that some of so many documents holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("held").to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["place", "df"])

    df = index.select("held").mapInArrow(count, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    return df.select("place", "df", F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).alias("w"))


class Shard:
    """Impact lists of some documents, and where each document stands in them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, totals: tuple[int, int]):
        docs, words = totals
        m = 10 + (90 * n * docs) // words
        doc = np.repeat(np.arange(len(ids)), counts)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))  # list after list, each by falling impact
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        # The same postings document by document, for direct access.
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.term, self.by_doc = term, impact
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ids = ids

    def best(self, terms: np.ndarray, w: np.ndarray, k: int, floor: int, step: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with their scores among which are all of the k best that may beat ``floor``, and the number of postings read.

        ``w`` is by term; ``floor`` is the k-th score of the documents searched before.
        """
        lists = [(int(self.begin[t]), int(self.begin[t + 1]), int(w[t])) for t in terms if self.begin[t] < self.begin[t + 1] and w[t] > 0]
        asked = np.zeros(len(self.begin), np.int64)
        asked[terms] = w[terms]
        seen = [np.zeros(hi - lo + 1, bool) for lo, hi, _ in lists]  # one more, never seen, ends the search for a gap
        which = np.full(len(self.begin), -1)
        which[[t for t in terms if self.begin[t] < self.begin[t + 1] and w[t] > 0]] = np.arange(len(lists))
        read, met = [0] * len(lists), np.zeros(len(self.ids), bool)
        best = [0] * len(lists)
        docs, scores, cost = [], [], 0
        top = np.zeros(0, np.int64)
        while True:
            new = []
            for i, (lo, hi, _) in enumerate(lists):
                at = max(read[i], best[i])  # what stands above the best position is seen
                new.append(self.doc[lo + at : min(lo + at + step, hi)])
                read[i] = min(at + step, hi - lo)
            new = np.unique(np.concatenate(new)) if new else np.zeros(0, np.int64)
            new = new[~met[new]]
            met[new] = True
            if len(new):
                n = self.first[new + 1] - self.first[new]
                every = np.repeat(self.first[new] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                cost += len(every)
                owner = np.repeat(np.arange(len(new)), n)
                mine = which[self.term[every]] >= 0
                every, owner = every[mine], owner[mine]
                gain = asked[self.term[every]] * self.by_doc[every]
                score = np.zeros(len(new), np.int64)
                np.add.at(score, owner, gain)
                docs.append(new)
                scores.append(score)
                top = np.concatenate([top, score])
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
                lists_of, where = which[self.term[every]], self.at[every]
                order = np.argsort(lists_of, kind="stable")
                edge = np.searchsorted(lists_of[order], np.arange(len(lists) + 1))
                for i, (lo, _, _) in enumerate(lists):
                    seen[i][where[order[edge[i] : edge[i + 1]]] - lo] = True
            bound = 0
            for i, (lo, hi, weight) in enumerate(lists):
                best[i] += int(np.argmin(seen[i][best[i] :]))
                if best[i] < hi - lo:
                    bound += weight * int(self.impact[lo + best[i] - 1])
            kth = max(floor, int(top.min()) if len(top) == k else 0)
            if bound < kth or bound == 0:
                break
            step = min(step * 2, 4096)
        found = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        score = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        keep = (score >= kth) & (score > 0)
        return found[keep], score[keep], cost


def _searched(index: DataFrame, items: list[np.ndarray], w: np.ndarray, totals: tuple[int, int], k: int, shard_postings: int) -> DataFrame:
    """``item, doc_id, score``: of each item, by its place, the k best documents of each task."""
    shared = index.sparkSession.sparkContext.broadcast((items, w))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        held: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            if not waiting:
                return
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            col = lambda c: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32).astype(np.int64)
            term, tf = col("held"), col("tf")
            counts = np.array([len(x) // 4 for x in rows.column("held").to_pylist()], np.int64)
            ids = rows.column("doc_id").to_pylist()
            shard = Shard(np.arange(len(ids)), rows.column("n").to_numpy(), counts, term, tf, len(w), totals)
            for mine, terms in zip(held, items):
                floor = -mine[k - 1][0] if len(mine) >= k else 0
                found, score, _ = shard.best(terms, w, k, floor)
                mine += [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(found.tolist(), score.tolist())]
                mine.sort()
                del mine[k:]

        size = 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows + sum(len(x) for x in b.column("held").to_pylist()) // 4
            if size >= shard_postings:
                flush()
                size = 0
        flush()
        out = [(i, None if null else d, -s) for i, mine in enumerate(held) for s, null, d in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = 2_000_000, block_bytes: int = 8_000_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its k best documents."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "lexical")
    asked = tmp.write(item_terms(items).where("size(terms) > 0"), "items")
    size = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = [asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)]
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()  # about block_bytes
        terms = sorted({t for r in own for t in r["terms"]})
        place = {t: n for n, t in enumerate(terms)}
        index = tmp.write(postings(docs, [t.encode() for t in terms]), "index")
        n_docs, words = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        w = np.zeros(len(terms), np.int64)
        for r in weights(index, len(terms), n_docs).collect():  # a row a term of the block
            w[r["place"]] = r["w"]
        found = _searched(index, [np.array([place[t] for t in r["terms"]], np.int64) for r in own], w, (n_docs, words), k, shard_postings)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
        parts.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(lambda a, b: a.unionByName(b), parts)
