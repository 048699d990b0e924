"""Quality classifier: supervised subword embeddings.

A text is cut at ASCII white space.  Its features are hashed into ``BUCKETS`` rows of a
learned table: words, pairs of neighbouring words in their order, and runs of 3 and 4 characters that
don't cross a word's ends (which count as a space).  The document is the mean, over these kinds, of the mean vector of the kind;
a softmax over it gives the classes.  Vectors and softmax are learned together by plain
stochastic gradient descent in numpy, on at most ``sample`` labelled rows, chosen by the
hash of their id, or as many of them as have features in ``sample_bytes``; these features, and only those, come to the driver.

Since the output is linear in the table, scoring looks up one number per feature; whole
texts stream through ``mapInArrow`` and nothing is shuffled.

Defined cases: a null text is empty; a text without words scores by the bias alone; rows
whose id is null are scored and count as held out; labels that are null, or name no
document, teach nothing; several labels of a row each count; with no labels of both kinds every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
KINDS = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.full(n, _P), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) + np.uint64(kind)) * _MIX >> np.uint64(48)).astype(np.uint16)


def features(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the buckets of all texts in a row, and where each text's begin and the last ends."""
    lines = [b" ".join((t or b"").split()).decode("utf-8", "replace") for t in texts]
    raw = np.frombuffer("".join(f" {x} \0" for x in lines).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) + 3 for x in lines])
    b = raw.astype(np.uint64)
    gap = (raw == 32) | (raw == 0)
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stops = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[:-1], dtype=np.uint64)])
    word = (total[stops] - total[starts]) * down[starts]
    owner = np.searchsorted(ends, starts, "right")
    pair = (word[:-1] * _P + word[1:])[owner[:-1] == owner[1:]]
    pair_owner = owner[1:][owner[:-1] == owner[1:]]
    out = []
    n = len(texts)
    for kind, (h, own) in enumerate(((word, owner), (pair, pair_owner))):
        out.append((_bucket(h, kind), np.searchsorted(own, np.arange(n + 1))))
    for kind, size in ((2, 3), (3, 4)):
        h, whole = b[: len(raw) - size + 1].copy(), raw[: len(raw) - size + 1] != 0
        for k in range(1, size):
            h = h * _P + b[k : len(raw) - size + 1 + k]
            whole &= (raw if k == size - 1 else ~gap)[k : len(raw) - size + 1 + k] != 0
        at = np.flatnonzero(whole)
        cut = np.concatenate([[0], np.searchsorted(at, ends)])
        out.append((_bucket(h[at], kind), cut))
    return out


def _sparse(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text, and their share in its vector."""
    share: dict[int, float] = {}
    idx, w = [], []
    for bucket, _ in features([text]):
        if len(bucket):
            seen, n = np.unique(bucket, return_counts=True)
            idx.append(seen)
            w.append(n / (len(bucket) * KINDS))
    if not idx:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    at, back = np.unique(np.concatenate(idx), return_inverse=True)
    return at, np.bincount(back, np.concatenate(w)).astype(np.float32)


class Model(NamedTuple):
    """Difference of the two classes' outputs: per bucket, and the bias."""

    table: np.ndarray
    bias: float

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for bucket, cut in features(texts):
            value = np.append(self.table[bucket], 0.0)
            n = np.diff(cut)
            sums = np.add.reduceat(value, cut[:-1]) if len(texts) else value[:0]
            out += np.where(n > 0, sums / np.maximum(n, 1), 0.0) / KINDS
        return out


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 12, rate: float = 4.0, seed: int = 11) -> Model:
    """Stochastic gradient descent over (label, buckets, shares)."""
    if len({y for y, _, _ in rows}) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, idx, w = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            held = table[idx]
            mean = w @ held
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # Shares are small where a text is long: scaled to keep the step of a text the same size.
            table[idx] = held - np.outer(w, lr * 10 * back).astype(np.float32)
    delta = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(table.astype(np.float64) @ delta, float(bias[1] - bias[0]))


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, sample_bytes: int = 100_000_000) -> Model:
    """Learns from at most ``sample`` labelled rows that are not held out, the first in hash order, and ``sample_bytes`` of features."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~is_held_out("_id"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).join(F.broadcast(chosen), "_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_sparse(t.as_py()) for t in b.column("_t")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], ["i", "y", "idx", "w"])

    found = some.select(F.col("_id").cast("long").alias("_id"), "_y", "_t").mapInArrow(rows, "i long, y int, idx binary, w binary")
    got, size = [], 0
    for r in found.orderBy(F.xxhash64("i"), "i", "y", "idx").toLocalIterator():
        got.append((r["y"], np.frombuffer(r["idx"], np.uint16), np.frombuffer(r["w"], np.float32)))
        size += len(r["idx"]) + len(r["w"])
        if len(got) == sample or size >= sample_bytes:
            break
    return train(got)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``score``, the probability of label 1 (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, values, lo = b.column(b.num_columns - 1), [], 0
            while lo < b.num_rows:  # about a megabyte at a time
                part, size = [], 0
                while lo < b.num_rows and size < 1_000_000:
                    part.append(texts[lo].as_py())
                    size += len(part[-1] or b"") + 3
                    lo += 1
                values.append(shared.value.logits(part))
            z = np.concatenate(values) if values else np.zeros(0)
            columns = [*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "score"])

    keep = docs.drop("score")
    rows = keep.withColumn("_text_bytes", F.col(text_col).cast("binary"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields] + ["score double"])
    return rows.mapInArrow(score, out)
