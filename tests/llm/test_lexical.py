"""Search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from pointweave.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def scored(docs, items, k=10):
    cut = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, words = len(cut), sum(len(t) for _, t in cut)
    df = {}
    for _, t in cut:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for doc, t in cut:
            m = 10 + 90 * len(t) * n_docs // words
            score = 0
            for x in set(terms(text)) & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "Z", "x1", "ß", "日本"]
    text = lambda most: "".join(rng.choice(vocabulary[: rng.choice([5, 20, 66])]) + rng.choice([" ", "-", "\n", "_", "\x00", "€ "]) for _ in range(rng.randrange(most)))
    docs = [(i, text(rng.choice([3, 40, 200]))) for i in range(n)]
    docs += [(n + i, t) for i, (_, t) in enumerate(docs[: n // 4])]  # copies tie
    return docs, [(i, text(30)) for i in range(12)]


def got(spark, docs, items, **how):
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"shard_postings": 50}), (3, {"block_bytes": 150}), (4, {"k": 3})])
def test_equal_to_scoring_all(spark, seed, how):
    docs, items = corpus(seed, 160)
    assert got(spark, docs, items, **how) == scored(docs, items, how.get("k", 10))


def test_ties_go_to_the_smallest_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)]
    assert [r[2] for r in sorted(got(spark, docs + [(999, "other")], [(1, "same words")]), key=lambda r: r[1])] == list(range(1, 11))


def test_defined_cases(spark):
    docs = [(None, "apple pie"), (5, None), (6, ""), (7, "apple pie"), (7, "apple pie"), (8, "-- !"), (9, "pear")]
    items = [(1, "Apple"), (1, "Apple"), (2, None), (3, ".."), (4, "kiwi"), (None, "pie")]
    assert got(spark, docs, items) == scored(docs, [(1, "Apple"), (None, "pie")])
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, None)], items) == []
    long = [(1, "apple " * 300_000 + "pear"), (2, "pear")] + [(i, "x") for i in range(3, 9)]
    assert got(spark, long, [(1, "pear apple")]) == scored(long, [(1, "pear apple")])
    more = spark.createDataFrame([(1, "a b", 2, "x"), (2, "b c", 3, "y")], "doc_id long, text string, n long, held string")
    items = spark.createDataFrame([("i", "c", 1)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in lexical.search(more, items).collect()] == [("i", 1, 2)]


def shard(docs, n_terms, rng):
    """A shard of documents given as {term: frequency}, and each document's number of terms."""
    counts = np.array([len(d) for d in docs], np.int64)
    term, tf = (np.array([x for d in docs for x in f(d)], np.int64) for f in (dict.keys, dict.values))
    n = np.array([max(1, sum(d.values())) + rng.randrange(50) for d in docs], np.int64)
    return lexical.Shard(np.arange(len(docs)), n, counts, term, tf, n_terms, (len(docs), int(n.sum()))), n


def test_stops_early_and_reads_less_than_all(spark):
    """Where few documents hold many of the terms, the best positions end the search long before the lists do."""
    rng = random.Random(7)
    docs = [{t: 1 for t in rng.sample(range(40), 3)} for _ in range(20_000)]
    for d in rng.sample(docs, 10):
        d.update({t: 9 for t in range(6)})
    one, _ = shard(docs, 40, rng)
    terms, w = np.arange(6), np.full(40, 500, np.int64)
    found, score, cost = one.best(terms, w, 10, 0)
    every, all_scores, _ = one.best(terms, w, len(docs), 0)
    assert sorted(score)[-10:] == sorted(all_scores)[-10:] and len(every) > 5000
    assert cost < 0.2 * len(one.term)


def test_best_positions_bind_tighter_than_last_read(spark):
    """A document met in one list marks its positions in the others, so their best positions run ahead of what was read."""
    docs = [{0: 100 - i, 1: 100 - i, 2: 100 - i} for i in range(90)]
    one, _ = shard(docs, 3, random.Random(0))
    found, score, cost = one.best(np.arange(3), np.ones(3, np.int64) * 1000, 5, 0, step=1)
    assert len(found) >= 5 and cost < 3 * 20


def test_floor_of_documents_searched_before(spark):
    docs = [{0: 1} for _ in range(50)]
    one, _ = shard(docs, 1, random.Random(0))
    assert len(one.best(np.array([0]), np.array([10]), 5, 10**12)[0]) == 0
