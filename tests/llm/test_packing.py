import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "The and attion, to thanedble!! isn't WE'LL 'S don''t 12 x3y\n\tEnd",
    "Été Çà ǆ ŉ İstanbul ΣΑΣ K ﬁ é é́ ́x",
    "a b c\x1cd\x85e\x00f",
    "<|endoftext|> <|startoftext|>x<|endoftext|>",
    "一二三 👩‍🚀 ½ ² ª º ſ ´ ß ÿ ž",
    "", None, " \n ", "aaaa" * 500, "don't_do__it... (1,000.50) $%&&&",
]


def test_ids_equal_the_tokenizers():
    encoder = packing.WordIds(PATH, table_bytes=10_000_000)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(TEXTS))]
        assert got == [whole(t) for t in TEXTS]
    small = packing.WordIds(PATH, table_bytes=300)
    for t in TEXTS * 3:  # the tables turn over with every text
        assert np.frombuffer(small.encode(pa.array([t], pa.string()))[0], "<u4").tolist() == whole(t)
    long = "The quick, brown fox... isn't 12 " * 200_000
    assert encoder.encode(pa.array([long]))[0] == np.array(whole(long[:33]), "<u4").tobytes() * 200_000


@pytest.mark.parametrize("tiers", [(2048, 1024, 512, 256), (16, 8, 4)])
def test_windows_are_full_and_hold_each_token_once(tiers):
    rng = random.Random(5)
    lengths = [rng.choice([1, 2, 3, rng.randint(1, 40), rng.randint(1, 5000)]) for _ in range(400)]
    packer, windows = packing.Packer(tiers), []
    for i, n in enumerate(lengths):
        packer.add(i, n)
        if i % 90 == 0:
            windows += packer.windows()
    windows += packer.windows(last=True)
    seen = {}
    for tier, _, pieces in windows:
        assert sum(p[2] for p in pieces) == tier and tier & (tier - 1) == 0 and tier <= tiers[0]
        for doc, start, n in pieces:
            seen.setdefault(doc, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[i]):
            assert start == at
            at += k
        assert at == n


def test_pieces_of_a_table(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "Thand,", "été", "x1"], k=rng.randint(0, 3000)))) for i in range(80)] + [(7, "twice"), (None, "no id"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", packing.F.lit("clash")).repartition(3)
    out = packing.pack(docs, PATH, flush_tokens=20_000).collect()
    text = {i: t for i, t in rows if i != 7}
    seen, sequences = {}, {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
        seen.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    for i, t in text.items():
        ids = np.array([*whole(t), 1], "<u4")
        at = 0
        for r in sorted(seen[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert packing.pack(docs.limit(0), PATH).count() == 0
