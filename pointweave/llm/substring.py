"""Exact substring dedup by fixed-block anchors.

A window is ``window`` words in a row of one document.  A window that also starts earlier (smaller
id, or earlier in the document) is a repeat, and the words it covers go.

Anchors.  The reference blocks are the documents' non-overlapping runs of half a window: every
window covers one whole.  So a repeat shows as a run of that length, at whatever offset, that equals
a reference block.  Documents are dealt by hash into chunks of about ``chunk_bytes``:

1. each chunk sends the hashes of all its rolling runs, and which of them are blocks, to the
   hash's bucket; a chunk names a hash once, however often it holds it;
2. a bucket answers each chunk with the hashes that are a block somewhere and occur twice;
3. the windows around these hits are extended to full length: the chunk sends each such
   window's hash of 96 bits, from two independent hashes of its words, once, with its first place; the bucket keeps the
   earliest of all chunks and tells the others that theirs is a repeat;
4. the chunk joins its repeats to maximal stretches and drops them.

What travels is packed numbers, one row for each chunk and each bucket that it has hashes for, so never more rows than
words, and a passage that a third of all documents share is one number in each chunk; no pairs of places are ever made.  The
three passes over the text read one shuffle of it.

Defined cases: a null text has no words; a null id is the largest; rows that repeat an id (or null) are
documents in the order of their chunks (a hash of id and text), then of their texts; a text of any length lies whole in one
chunk; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Powers of this make the second, independent hash.
_P2 = np.uint64(0xBF58476D1CE4E5B9)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32, 0]] = True  # 0 parts the documents; a text's own zero bytes are moved out of the way


def _squash(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def _unsquash(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T.tobytes(), kind)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def word_hashes(texts: list[bytes], base: np.uint64 = _P) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in a row, by powers of ``base``, and where each text's words begin and the last end."""
    out, counts = [], []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 1_000_000):
            size += len(texts[to]) + 1
            to += 1
        raw = np.frombuffer(b"\0".join([b"", *(t.replace(b"\0", b"\xff") if b"\0" in t else t for t in texts[at:to]), b""]), np.uint8)
        gap = _GAP[raw]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        stops = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        up, down = np.full(len(raw), base), np.full(len(raw), np.uint64(pow(int(base), -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = (total[stops] - total[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= _MIX
        out.append(h ^ (h >> np.uint64(29)))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        counts.append(np.diff(np.searchsorted(starts, ends, "right"), prepend=0))
        at = to
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(n)])


def rolling(h: np.ndarray, cut: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a run of that many words starts within its document, and the runs' hashes."""
    n = np.diff(cut)
    left = np.repeat(cut[1:], n) - np.arange(len(h))
    at = np.flatnonzero(left >= size)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    m = len(h) - size + 1
    run = np.zeros(m, np.uint64)
    for k in range(size):
        run *= _Q
        run += h[k : k + m]
    run ^= run >> np.uint64(31)
    run *= _MIX
    run ^= run >> np.uint64(32)
    return at, run[at]


class _Chunk:
    """The documents of one chunk, in order, with their words' hashes."""

    def __init__(self, table: pa.Table):
        ids = [(i is None, i or 0) for i in table.column("doc_id").to_pylist()]
        texts = [t or b"" for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = [None if ids[k][0] else ids[k][1] for k in order]
        self.texts = [texts[k] for k in order]

    def hash(self) -> None:
        self.words, self.cut = word_hashes(self.texts)

    def second(self, window: int) -> np.ndarray:
        """32 more bits of every window."""
        words, cut = word_hashes(self.texts, _P2)
        return (rolling(words, cut, window)[1] >> np.uint64(32)).astype(np.uint32)


def _codes(run: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the rest of the hash in the lower."""
    return ((run >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (run & np.uint64(0xFFFFFFFF))


def _runs(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Each bucket of a sorted array, and where it stands."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[a]), slice(a, b)) for a, b in zip([0, *edge], [*edge, len(bucket)]) if a < b]


def _differs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a row of two columns is unlike the one before."""
    out = np.ones(len(a), bool)
    out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


_ASK = "bucket int, chunk int, a binary, b binary, c binary"
_ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_TELL = "chunk int, code binary, at binary"
_TELL_SCHEMA = pa.schema([("chunk", pa.int32()), ("code", pa.binary()), ("at", pa.binary())])
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))), ("kept", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_bytes: int = 2_000_000) -> DataFrame:
    """``doc_id, n_words, removed`` (stretches of word places, end exclusive), ``kept`` (the other words joined by one space)."""
    if window % 2:
        raise ValueError("a window must have an even number of words")
    block = window // 2
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks // 4)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def probe(table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        c.hash()
        at, run = rolling(c.words, c.cut, block)
        codes, first, times = np.unique(_codes(run, buckets), return_index=True, return_counts=True)
        aligned = (at - np.repeat(c.cut[:-1], np.diff(c.cut))[at]) % block == 0
        is_block = np.isin(codes, _codes(run[aligned], buckets))
        chunk = table.column("chunk")[0].as_py()
        packed = lambda s: (_squash(_steps(codes[s].astype(np.uint32))), np.packbits(is_block[s]).tobytes(), np.packbits(times[s] > 1).tobytes())
        return _table([(k, chunk, *packed(s)) for k, s in _runs((codes >> np.uint64(32)).astype(np.int64))], _ASK_SCHEMA)

    def match(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        values = [np.cumsum(_unsquash(r["a"], np.uint32), dtype=np.uint32) for r in asked]
        bits = lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        every, back = np.unique(np.concatenate(values), return_inverse=True)
        is_block, often = (np.concatenate([bits(r[k], len(v)) for r, v in zip(asked, values)]) for k in ("b", "c"))
        times = np.bincount(back, 1 + often, len(every))
        hit = (np.bincount(back, is_block, len(every)) > 0) & (times > 1)
        out, at = [], 0
        for r, v in zip(asked, values):
            mine = v[hit[back[at : at + len(v)]]]
            at += len(v)
            if len(mine):
                code = np.uint64(r["bucket"]) << np.uint64(32)
                out.append((r["chunk"], _squash(_steps(code | mine.astype(np.uint64))), None))
        return _table(out, _TELL_SCHEMA)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _table([], _ASK_SCHEMA)
        c = _Chunk(left)
        c.hash()
        hits = np.sort(np.concatenate([np.cumsum(_unsquash(r, np.uint64), dtype=np.uint64) for r in right.column("code").to_pylist()]))
        at, run = rolling(c.words, c.cut, block)
        seen = np.zeros(len(c.words) + block + 1, np.int64)
        seen[at[np.isin(_codes(run, buckets), hits)] + 1] = 1
        seen = np.cumsum(seen)  # hits before each place
        at, run = rolling(c.words, c.cut, window)
        near = seen[np.minimum(at + block + 1, len(seen) - 1)] > seen[at]
        at, run, more = at[near], run[near], c.second(window)[near] if near.any() else np.zeros(0, np.uint32)
        order = np.lexsort((more, run))  # stable: equal windows in order of their places
        first = np.sort(order[_differs(run[order], more[order])])
        again = np.ones(len(at), bool)
        again[first] = False  # a later place in this chunk is a repeat, whatever the other chunks hold
        chunk = left.column("chunk")[0].as_py()
        out = [(-1 - chunk, chunk, None, _squash(_steps(at[again].astype(np.uint32))), None)] if again.any() else []
        at, run, more = at[first], run[first], more[first]
        # Sorted by bucket, then place: hashes, places, and the ids of the documents (null last).
        bucket = (run >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at, run, more = at[order], run[order], more[order]
        owner = np.searchsorted(c.cut, at, "right") - 1
        ids = np.array([np.iinfo(np.int64).max if i is None else i for i in c.ids], np.int64)[owner]
        for k, s in _runs(bucket[order].astype(np.int64)):
            out.append((k, chunk, run[s].tobytes() + more[s].tobytes(), _squash(_steps(at[s].astype(np.uint32))), _squash(_steps(ids[s]))))
        return _table(out, _ASK_SCHEMA)

    def decide(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        if asked[0]["bucket"] < 0:  # a chunk's word to itself
            return _table([(r["chunk"], None, r["b"]) for r in asked], _TELL_SCHEMA)
        runs = [np.frombuffer(r["a"], np.uint64, len(r["a"]) // 12) for r in asked]
        run = np.concatenate(runs)
        more = np.concatenate([np.frombuffer(r["a"], np.uint32, offset=len(r["a"]) // 12 * 8) for r in asked])
        doc = np.concatenate([np.cumsum(_unsquash(r["c"], np.int64)) for r in asked])
        chunk = np.repeat([r["chunk"] for r in asked], [len(x) for x in runs])
        order = np.lexsort((chunk, doc, more, run))
        late = np.zeros(len(run), bool)
        late[order[~_differs(run[order], more[order])]] = True
        out, lo = [], 0
        for r, x in zip(asked, runs):
            mine = late[lo : lo + len(x)]
            lo += len(x)
            if mine.any():
                out.append((r["chunk"], None, _squash(_steps(np.cumsum(_unsquash(r["b"], np.uint32), dtype=np.uint32)[mine]))))
        return _table(out, _TELL_SCHEMA)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _OUT_SCHEMA)
        c, out = _Chunk(left), []
        split = [t.split() for t in c.texts]
        cut = np.concatenate([[0], np.cumsum([len(w) for w in split])])
        gone = np.zeros(cut[-1] + window + 1, np.int64)
        for r in right.column("at").to_pylist():
            at = np.cumsum(_unsquash(r, np.uint32), dtype=np.uint32)
            gone[at] += 1
            gone[at + window] -= 1
        gone = np.cumsum(gone) > 0
        for i, words, lo, hi in zip(c.ids, split, cut, cut[1:]):
            mine = gone[lo:hi]
            if mine.any():
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist()
                out.append((i, len(words), [{"from_word": a, "to_word": b} for a, b in zip(edge[::2], edge[1::2])], b" ".join(compress(words, (~mine).tolist()))))
            else:
                out.append((i, len(words), [], b" ".join(words)))
        return _table(out, _OUT_SCHEMA)

    asked = rows.groupBy("chunk").applyInArrow(probe, _ASK)
    hits = asked.groupBy("bucket").applyInArrow(match, _TELL)
    windows = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, _ASK)
    repeats = windows.groupBy("bucket").applyInArrow(decide, _TELL)
    out = rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(cut_out, "doc_id long, n_words long, removed array<struct<from_word: long, to_word: long>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
