"""Phrases against counting them all, and what the rules for cutting and dropping say."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pointweave.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def counted(rows, longest=5):
    out = Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            out[lang, 0, ""] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    out[lang, k, " ".join(words[i : i + k])] += 1
    return out


def ranked(rows, support, top):
    f = counted(rows)
    n = {lang: c for (lang, k, _), c in f.items() if k == 0}
    whole = {(lang, p): c for (lang, k, p), c in f.items() if k > 1 and c >= support}
    longer = Counter()
    for (lang, p), c in whole.items():
        w = p.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, " ".join(w[i : i + k])
                longer[key] = max(longer[key], c)
    out = {}
    for (lang, p), a in whole.items():
        if 100 * longer[lang, p] >= 100 * a:
            continue
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, k, " ".join(w[:k])], f[lang, len(w) - k, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), left, right, n[lang]))
    return sorted((lang, rank, p.decode(), -a, left, right, n, -s) for lang, mine in out.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(mine)[:top], 1))


def got(spark, rows, support, top=2000, **how):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(docs, support, top=top, **how).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "a", "é", "zwölf", "x-ray", "new", "york", "city", "hall", "ab\x00c", "d\x1fe"]
    marks = [" "] * 12 + ["\t", ", ", ".", "\n", "\x0b", " ; "]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += ["New", "York", "City", "Hall"] if rng.random() < 0.1 else [rng.choice(vocabulary)]
        rows.append((i % 70, "".join(w + rng.choice(marks) for w in words), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed, support, shards, chunk", [(1, 8, 3, 500), (2, 5, 16, 8_000_000), (3, 20, 1, 100)])
def test_equal_to_counting_all(spark, seed, support, shards, chunk):
    rows = corpus(seed)
    rows += rows[:30]  # repeated rows count again
    assert got(spark, rows, support, shards=shards, chunk_bytes=chunk) == ranked(rows, support, 2000)


def test_top_of_each_language_and_ties(spark):
    rows = corpus(4)
    assert got(spark, rows, 4, top=5, salts=3) == ranked(rows, 4, 5)


@pytest.mark.parametrize("shards", [1, 2, 30])
def test_counts_are_exact_and_whole_in_any_number_of_shards(spark, shards):
    rows = corpus(5, 300)
    found = phrases.phrase_counts(spark.createDataFrame(rows, SCHEMA), 30, shards=shards, chunk_bytes=2000).collect()
    assert len(found) == len({(r.lang, r.words, r.phrase) for r in found})
    assert {(r.lang, r.words, r.phrase): r.f for r in found} == {k: f for k, f in counted(rows).items() if f >= 30 or not k[1]}


def test_phrases_end_with_a_piece_and_a_document(spark):
    rows = [(i, "red fox. red, fox red", "en") for i in range(10)]
    assert [(r[2], r[3]) for r in got(spark, rows, 10)] == [("fox red", 10), ("red fox", 10)]


def test_overlaps_count(spark):
    rows = [(1, "go go go go go go", "en")]
    found = got(spark, rows, 2)
    assert found == ranked(rows, 2, 2000)
    assert [r[2:4] for r in sorted(found, key=lambda r: r[2])] == [("go go", 5), ("go go go", 4), ("go go go go", 3), ("go go go go go", 2)]


def test_empty_null_long_and_more_columns(spark):
    assert got(spark, [], 1) == []
    assert got(spark, [(1, None, None), (None, "", "en"), (2, " .,\n", "en")], 1) == []
    docs = spark.createDataFrame([(None, "a b " * 300_000, None, "x", 3), (None, "a b", "en", None, None)], "doc_id long, text string, lang string, words string, f long")
    rows = [tuple(r) for r in phrases.collocations(docs, 100_000, longest=2).collect()]
    assert sorted(r[:4] for r in rows) == [("und", 1, "a b", 300_000), ("und", 2, "b a", 299_999)]


def test_words_across_blocks():
    raw = b"one two. three\tfour  five," * 50 + b"x" * 300 + b" end"
    want = phrases.words_of(raw)
    for block in (1, 7, 64):
        for a, b in zip(phrases.words_of(raw, block), want):
            assert np.array_equal(a, b)
    h, start, stop, same = want
    assert [raw[a:b] for a, b in zip(start[:5], stop[:5])] == [b"one", b"two", b"three", b"four", b"five"]
    assert same[:5].tolist() == [True, False, True, True, False]
    assert len(set(h.tolist())) == 7
