import random

import numpy as np

from pointweave.llm import quality


def slow_kinds(text):
    """Feature keys of one text, told apart by content instead of by hash."""
    words = [w.decode("utf-8", "replace") for w in (text or b"").split()]
    kinds = [list(words), list(zip(words, words[1:])), [], []]
    for w in words:
        for kind, n in ((2, 3), (3, 4)):
            line = f" {w} "
            kinds[kind] += [line[i : i + n] for i in range(len(line) - n + 1)]
    return kinds


def test_features_follow_the_content():
    rng = random.Random(1)
    texts = [b" ".join(rng.choices([b"a", b"bc", "été".encode(), b"dddd", b"$$x", b"longer"], k=rng.randint(0, 12))) for _ in range(40)] + [None, b"", b"\0 z\0", b"x" * 5000]
    for i, t in enumerate(texts[:-2]):
        slow = slow_kinds(t)
        for kind, (bucket, cut) in enumerate(quality.features(texts)):
            got = bucket[cut[i] : cut[i + 1]].tolist()
            assert len(got) == len(slow[kind])
            assert len(set(zip(slow[kind], got))) == len(set(slow[kind]))  # equal content, equal bucket
    alone = [[b[c[0] : c[1]].tolist() for b, c in quality.features([t])] for t in texts]
    together = quality.features(texts)
    assert alone == [[b[c[i] : c[i + 1]].tolist() for b, c in together] for i in range(len(texts))]


def table(spark, n=300):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=rng.randint(20, 60)))
    bad = lambda: " ".join(w + rng.choice(["***", "$$$"]) for w in rng.choices(["alpha", "beta", "gamma", "delta"], k=30))
    rows = [(i, good() if i % 4 else bad()) for i in range(n)] + [(n, None), (n + 1, ""), (None, "alpha beta"), (5, "alpha $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", quality.F.lit("clash")).withColumn("_y", quality.F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)] + [(None, 1), (7, None), (10**9, 0)], "doc_id long, quality int")
    return docs, labels


def test_learns_and_holds_out(spark):
    docs, labels = table(spark)
    model = quality.fit(docs, labels)
    out = quality.scored(docs.withColumn("held_out", quality.is_held_out()), model).collect()
    assert len(out) == 304
    seen = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 5]
    held = [r for r in seen if r["held_out"]]
    assert 60 < len(held) < 140
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = table(spark)
    turned = labels.withColumn("quality", quality.F.when(quality.is_held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(3), turned)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_no_labels_and_no_rows(spark):
    docs, labels = table(spark, 8)
    model = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, model).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def slow_logit(model, text):
    """The score's logit feature by feature."""
    out = model.bias
    for bucket, _ in quality.features([text]):
        if len(bucket):
            out += sum(model.table[b] for b in bucket.tolist()) / len(bucket) / quality.KINDS
    return out


def test_scores_match_the_slow_version_and_training_is_a_gradient_step():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    texts = [b"alpha beta beta", b"", None, "\u00e9t\u00e9 x".encode(), b"long " * 40_000]
    assert np.allclose(model.logits(texts), [slow_logit(model, t) for t in texts])
    rows = [(k % 2, *quality._sparse(t)) for k, t in enumerate([b"bad $$$ worse", b"good fine words"] * 20)]
    trained = quality.train(rows)
    bad, good = trained.logits([b"bad $$$ worse", b"good fine words"])
    assert bad < 0 < good
    assert quality.train([r for r in rows if r[0]]).bias == 0


def test_repeated_labelled_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(3, "good fine words")] * 50 + [(6, "bad $$$ worse")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=60)
    assert abs(model.bias) < 10
