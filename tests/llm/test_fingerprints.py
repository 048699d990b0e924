import collections
import hashlib
import random

from pointweave.llm import fingerprints as fp


def jaccard(a, b):
    x, y = (collections.Counter((t or "").split()) for t in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_likeness_estimates_weighted_jaccard(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["été"]
    rows = [(i * 7 % 101 * 10, " ".join(rng.choices(words, k=rng.randint(30, 200)))) for i in range(60)]
    rows += [(5, rows[0][1]), (6, None), (7, ""), (8, "👩‍🚀é abc"), (None, "lone words here"), (9, "z" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", fp.F.lit("clash")).withColumn("id", fp.F.lit("clash")).repartition(3)
    out = fp.edited_fingerprints(docs, samples=48)
    got = {r["id"]: r for r in out.withColumn("near_edited", fp.likeness("fp_text", "fp_edited")).withColumn("near_next", fp.likeness("fp_text", "fp_next")).collect()}
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows if i is not None)
    off = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if t.split():
            off += [got[i]["near_edited"] - jaccard(t, edited), got[i]["near_next"] - jaccard(t, after)]
    assert abs(sum(off) / len(off)) < 0.03 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.1
    assert got[5]["fp_text"] == got[rows[0][0]]["fp_text"] and got[6]["fp_text"] == got[7]["fp_text"]
    assert got[None]["fp_next"] is None and got[None]["n_chars"] == 15


def test_repeated_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "bbbb"), (1, "aaaa"), (1, "aaaa"), (2, "cccc")], "doc_id long, text string")
    out = fp.edited_fingerprints(docs, samples=4).collect()
    edits = sorted((r["id"], r["n_chars"], r["edited_sha256"]) for r in out)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ways = []
    for order in (["aaaa", "aaaa", "bbbb"], ["bbbb", "aaaa", "aaaa"]):  # equal texts lie side by side
        ring = [*((1, t) for t in order), (2, "cccc")]
        ways.append(sorted((i, 4, sha(t[:3] + ring[(k + 1) % 4][1][0])) for k, (i, t) in enumerate(ring)))
    assert edits in ways
    one = fp.edited_fingerprints(docs.where("doc_id = 2"), samples=4).collect()
    assert [(r["id"], r["edited_sha256"]) for r in one] == [(2, sha("cccc"))]
    assert fp.edited_fingerprints(docs.limit(0), samples=4).count() == 0


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    out = {r["id"]: r for r in fp.edited_fingerprints(spark.createDataFrame([(1, long), (2, long), (3, "short")], "doc_id long, text string"), samples=4).collect()}
    assert out[1]["fp_text"] == out[2]["fp_text"] != out[3]["fp_text"] and out[1]["n_chars"] == len(long)
