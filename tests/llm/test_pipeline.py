import random
import re

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointweave.llm import mixing, simhash


def corpus(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 30
    good = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(240):
        text = good(rng.randint(80, 200))
        if i % 8 == 0:
            text = " ".join(w + rng.choice(["***", "$$$", "###"]) for w in text.split())
        elif i % 10 == 1:
            text += f" mail me{i}@host.example now"
        rows.append((i, text, "en", f"s{i % 5}" if i % 5 else None))
    near = [rows[1][1].split(), rows[2][1].split()]
    near[0][40] = "changed"
    rows += [(500, " ".join(near[0]), "en", "s1"), (501, rows[2][1], "en", "s9"), (502, rows[2][1], "en", "s2"), (503, None, None, None), (504, "", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_do_what_they_say(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        kept[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in kept[name])
    good = [i for i in ids("quality_classifier") if i < 500]
    assert good == [i for i in range(240) if i % 8]
    near = ids("simhash_near_dedup")
    assert [i for i in near if i < 240] == good and not {500, 501, 502} & set(near)
    before = {r["doc_id"]: r["text"] for r in kept["simhash_near_dedup"]}
    for r in kept["personal_data"]:
        want = re.sub(r"me\d+@host\.example", "[EMAIL]", before[r["doc_id"]] or "") if before[r["doc_id"]] else before[r["doc_id"]]
        assert r["text"] == want and r["n_chars"] == len(want or "")
    clean = {r["doc_id"]: r["text"] for r in kept["personal_data"]}
    by = {}
    for r in kept["personal_data"]:
        by[r["source"]] = by.get(r["source"], 0) + len((r["text"] or "").split())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.share_out([by[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    took = {}
    for r in kept["source_mixing"]:
        full = clean[r["doc_id"]].split()
        mine = r["text"].split()
        assert mine == full[: len(mine)] and r["n_chars"] == len(r["text"])
        took[r["source"]] = took.get(r["source"], 0) + len(mine)
    for s, g in goal.items():
        assert abs(took.get(s, 0) - g) <= max(3, 0.01 * g)
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept["source_mixing"])
    assert sum(r["length"] for r in packed) == tokens
    whole = cp.run(spark, sf).collect()
    assert sum(r["length"] for r in whole) == tokens
    assert np.array_equal(sorted({r["doc_id"] for r in whole}), sorted({r["doc_id"] for r in packed}))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash_and_nulls_in_changing_places(spark, tmp_path):
    """More columns pass through unchanged, whatever their names; rows of one id that differ only in where a null is are two rows."""
    corpus(spark, tmp_path)
    more = ["score", "_h", "_id", "id", "h", "n", "row", "first", "_text_bytes", "text_bytes", "carry", "spans", "d"]
    names = {c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in more}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("*", *[x.alias(c) for c, x in names.items()])
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/more{k}")
        docs = spark.read.parquet(f"{tmp_path}/more{k}")
        kept = docs.collect()
        assert len(kept) > 100 and all(r[c] in (None, f"{c} {r['doc_id']}") for r in kept for c in more)
    two = spark.createDataFrame([(1, None, "a", None, 0), (1, "a", None, None, 0), (1, "a", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r[0] for r in two.select(simhash.row_hash(two)).collect()}) == 2
