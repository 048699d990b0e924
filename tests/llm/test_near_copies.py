"""Near copies at a Jaccard similarity of 5-word shingles, by kind of edit."""

import random

import numpy as np

from pointweave.llm import simhash


def jaccard(a: str, b: str) -> float:
    x, y = (set(s.tolist()) for s in simhash.shingle_sets([a.encode(), b.encode()]))
    return len(x & y) / len(x | y)


def edited(words: list[str], kind: str, share: float, rng: random.Random, vocabulary: list[str]) -> list[str]:
    n = len(words)
    if kind == "appended":
        return words + [rng.choice(vocabulary) for _ in range(round(n * share))]
    if kind == "cut":
        return words[: n - round(n * share)]
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def test_pairs_by_kind_of_edit(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    texts, cases = [], []
    for kind, share in [("appended", 0.2), ("appended", 0.1), ("cut", 0.15), ("scattered", 0.01), ("scattered", 0.05)]:
        for _ in range(60):
            words = rng.choices(vocabulary, weights, k=rng.randint(100, 600))
            a, b = " ".join(words), " ".join(edited(words, kind, share, rng, vocabulary))
            cases.append(((kind, share), len(texts), jaccard(a, b)))
            texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    component = {r["id"]: r["component"] for r in simhash.near_copies(docs).collect()}
    met = {}
    for case, at, j in cases:
        together = component[at] == component[at + 1]
        if j < 0.8:
            assert not together, (case, j)
        else:
            met.setdefault(case, []).append(together)
    share = {case: (round(sum(m) / len(m), 3), len(m)) for case, m in met.items()}
    print(share)
    for case, (found, n) in share.items():
        if n >= 20:
            assert found >= 0.93, share


def test_a_rejected_nearest_hides_no_other_link(spark):
    """A chain whose ends aren't alike joins through its middle; texts below 0.8 stay apart."""
    rng = random.Random(6)
    words = [f"v{rng.randrange(5000)}" for _ in range(200)]
    more = [f"x{k}" for k in range(60)]
    texts = [words, words + more[:30], words + more, [f"y{k}" for k in range(50)], words[:120] + more + more]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(9, None), (10, ""), (None, "z"), (11, " ".join(texts[0]))], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.near_copies(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 9: 9, 10: 9, 11: 0}


def test_chunks_of_a_hot_shard(spark):
    words = [f"u{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"end{k}"])) for k in range(40)], "doc_id long, text string")
    assert {r["component"] for r in simhash.near_copies(docs, shard_rows=8).collect()} == {0}


def test_sets_of_short_texts_and_a_very_long_one():
    long = b" ".join(b"w%d" % (k % 70_000) for k in range(300_000))
    sets = simhash.shingle_sets([b"a b", None, b"A  b\n", b"a b c d e", b"", b"b a", long])
    assert [len(s) for s in sets] == [1, 0, 1, 1, 0, 1, 70_000]
    assert sets[0].tolist() == sets[2].tolist() != sets[5].tolist()
    assert len(simhash.wide_bits(sets[6])) == 256


def test_rows_that_share_an_id(spark):
    words = [f"u{k}" for k in range(100)]
    rows = [(1, " ".join(words), "a"), (1, " ".join(words), "b"), (1, " ".join(words), "b"), (1, "quite another text than that", "a"), (2, " ".join(words), "a")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r["component"] for r in got] == [1] * 5 and sorted(r["first"] for r in got) in ([False] * 3 + [True] * 2, [False] * 2 + [True] * 3)


def test_parities_bound_the_difference_of_sets():
    rng = random.Random(7)
    for _ in range(300):
        n, more, less = rng.randint(0, 400), rng.randint(0, 400), rng.randint(0, 100)
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[less:] + [rng.getrandbits(64) for _ in range(more)]
        x, y = (simhash.parity(np.array(sorted(set(s)), np.uint64)) for s in (a, b))
        differ = len(set(a) ^ set(b))
        assert simhash._apart(x, y) == simhash._apart(y, x) <= differ
        assert (simhash._apart(x, y) - differ) % 2 == 0
        if 20 < differ < 0.3 * len(a):  # few share a bucket
            assert simhash._apart(x, y) >= 0.6 * differ


def written(monkeypatch) -> dict[str, int]:
    """Most rows written to each scratch table."""
    rows, write = {}, simhash.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "write", counted)
    return rows


def test_a_clump_just_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    """F-pipeline: what is passed on follows the rows and their keys, not the square of the clump."""
    n = 150
    base = [f"u{k}" for k in range(100)]
    texts = [base + [f"own{k}x{i}" for i in range(13)] for k in range(n)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert 0.78 < jaccard(" ".join(texts[0]), " ".join(texts[1])) < 0.8
    rows = written(monkeypatch)
    assert {r["id"]: r["component"] for r in simhash.near_copies(docs, shard_rows=64).collect()} == {k: k for k in range(n)}
    assert rows["met"] > n and max(rows.values()) <= simhash.TABLES * n * 3  # a class is in up to three pairs of chunks
    assert sum(r for name, r in rows.items() if name in ("nearest", "others", "perhaps", "alike", "more")) <= n


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(f"v{rng.randrange(50_000)}" for _ in range(60))) for k in range(1500)], "doc_id long, text string")
    rows = written(monkeypatch)
    assert len({r["component"] for r in simhash.near_copies(docs).collect()}) == 1500
    assert rows["met"] == 0
