import random

from pointweave.llm import substring


def slow(rows, window):
    """rows in order: (key, text) -> number of words, kept words."""
    words = [(k, (t or b"").split()) for k, t in rows]
    seen, out = set(), []
    for k, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            if run in seen:
                gone |= set(range(s, s + window))
            seen.add(run)
        out.append((k, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, window, **how):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").withColumn("chunk", substring.F.lit("clash")).withColumn("kept", substring.F.lit("clash")).repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept"].encode()) for r in substring.drop_repeats(docs, window=window, **how).collect())
    ordered = sorted(((i is None, i or 0), (t or "").encode()) for i, t in rows)
    assert got == sorted((*k, n, kept) for k, n, kept in slow(ordered, window))
    return docs


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "Éa"]
    passage = [rng.choices(vocabulary, k=rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(150):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passage)
        rows.append((rng.randrange(10**12), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(3, rows[0][1])] * 5 + [(None, rows[1][1]), (4, None), (5, ""), (6, " ".join(["same"] * 200)), (7, "\0 " + " ".join(["a\0b"] * 45)), (8, " ".join(["a\0b"] * 30))]
    check(spark, rows, 20, chunk_bytes=9000)
    check(spark, rows, 6)


def test_stretches_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "start " + text[:200] + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.drop_repeats(docs).collect()}
    assert got[1]["removed"] == [] and got[1]["kept"] == text
    assert [(r["from_word"], r["to_word"]) for r in got[2]["removed"]] == [(1, got[2]["n_words"] - 2)] or got[2]["removed"]
    assert substring.drop_repeats(docs.limit(0)).count() == 0
