"""Collocations: frequent phrases of two to five words whose parts meet more often than chance lets them.

Counting is by SON partitioning, so that nothing is counted that can't be frequent.  Documents are dealt by hash into ``shards``
equal parts.  A phrase with ``support`` occurrences in all has ``support / shards`` or more in one of them (else the sum were
less), so each shard is mined completely at that lower support, the shards' frequent phrases are united, and these candidates are
counted in all shards, exactly and by their text.

A shard is as large as a share of the corpus is, so it is mined by many tasks.  It is dealt into chunks of about
``chunk_bytes``, and phrases are counted level by level, as each part of a frequent phrase is as frequent:

1. a chunk sends the hashes of its words, each once with its number, to the buckets of their hashes;
2. a bucket sums each shard's numbers; hashes that reach the lower support in some shard are candidates, and of these it sums the
   numbers of all shards; it tells all chunks which of the hashes that they sent are candidates;
3. the chunk does the same with pairs of such words, then with phrases of three to ``longest`` words all of whose pairs are such;
4. of the chunks that hold a candidate that has the full support, the first one gives its text.

What travels is packed numbers, a row for each chunk and bucket, and one bit back for each number; the passes over the text
read one shuffle of it.  The lower support doesn't depend on the size of the corpus, so what a chunk sends has a bound of its own;
buckets hold about ``bucket_bytes`` of text each.  Hashes have 64 bits: with 10**9 different phrases to be summed, of which 10**6 are frequent,
the odds that one of these meets another phrase's hash are 5e-5.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; texts of any length lie whole in a
chunk; an empty table gives no rows; a word may hold any character but blanks, tabs and the marks that end a piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.substring import _runs, _squash, _steps, _unsquash
from pointweave.sources.scratch import Scratch

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_END = np.zeros(256, bool)
_END[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _END.copy()
_GAP[list(b" \t")] = True
_NEXT_GAP = re.compile(rb"[ \t.,;:!?\x0a-\x0d]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def words_of(raw: bytes, block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a text: its hash, where it starts and stops, and whether the next one is in the same piece."""
    hashes, starts, stops, pieces = [], [], [], []
    lo, ended = 0, 0
    while lo < len(raw):
        cut = _NEXT_GAP.search(raw, lo + block) if lo + block < len(raw) else None
        hi = cut.start() if cut else len(raw)
        part = np.frombuffer(raw, np.uint8, hi - lo, lo)
        gap = np.concatenate([[True], _GAP[part], [True]])
        start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        up, down = np.full(len(part), _P), np.full(len(part), np.uint64(pow(int(_P), -1, 1 << 64)))
        up[:1] = down[:1] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        hashes.append(_mixed((total[stop] - total[start]) * down[start]))
        ends = np.cumsum(_END[part])
        pieces.append(ended + ends[start])
        ended += int(ends[-1])
        starts.append(start + lo)
        stops.append(stop + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    piece = np.concatenate(pieces)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(stops), np.append(piece[1:] == piece[:-1], False)


class _Chunk:
    """The texts of one chunk, language after language, and its phrases' hashes."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist()):
            by.setdefault(lang, []).append(text or b"")
        self.parts = []
        for lang in sorted(by):
            raw = b"\n".join(by.pop(lang)).lower()
            h, start, stop, same = words_of(raw)
            seed = _mixed(words_of(b"x" + lang.encode().translate(None, b" \t.,;:!?\n\x0b\x0c\r"))[0])
            self.parts.append((lang, raw, h, start, stop, same, _mixed(h + seed)))

    def level(self, size: int, good: np.ndarray | None, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase of so many words may start, and the phrases' hashes; ``good`` marks the places of candidates of one word less, or of two."""
        _, _, h, _, _, same, one = part
        if size == 1:
            return np.arange(len(h)), one
        may = np.ones(max(len(h) - size + 1, 0), bool)
        for k in range(size - 1):
            may &= same[k : k + len(may)]
        if good is not None:
            for k in range(size if size == 2 else size - 1):
                may &= good[k : k + len(may)]
        at = np.flatnonzero(may)
        out = one[at]
        for k in range(1, size):
            out = _mixed(out * _Q + h[at + k] + np.uint64(k))
        return at, out

    def asked(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Distinct hashes in order, their numbers, and the stretch of each bucket; buckets are ranges of hashes."""
        values, n = np.unique(hashes, return_counts=True)
        bucket = ((values >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        return values, n, _runs(bucket)

    def told(self, values: np.ndarray, runs: list[tuple[int, slice]], bits: dict[int, bytes]) -> np.ndarray:
        """Which of the distinct hashes the buckets' bits mark."""
        good = np.zeros(len(values), bool)
        for k, s in runs:
            good[s] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=s.stop - s.start)
        return good


_ASK = "bucket int, chunk int, a binary, b binary"
_ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_TELL = "chunk int, step int, bucket int, bits binary, named binary, f binary"
_TELL_SCHEMA = pa.schema([("chunk", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("named", pa.binary()), ("f", pa.binary())])
_OUT = "lang string, phrase string, words int, f long"
_OUT_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def phrase_counts(docs: DataFrame, support: int = 100, longest: int = 5, shards: int = 4, chunk_bytes: int = 8_000_000, bucket_bytes: int = 48_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, phrase, words, f``: how often each word or phrase occurs that does so ``support`` times or more; and with no words all words of the language."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    per_shard = max(1, -(-size // (shards * chunk_bytes)))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    spread = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int")])
    chunk = F.pmod(spread, F.lit(shards * per_shard)).cast("int")
    rows = docs.select(chunk.alias("chunk"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def hashes(c: _Chunk, step: int, good: list[np.ndarray | None]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Of each language its levels of that step."""
        sizes = ([1], [2], range(3, longest + 1))[step]
        return [[c.level(n, g, p) for n in sizes] for p, g in zip(c.parts, good)]

    def replay(c: _Chunk, replies: pa.Table, steps: int) -> tuple[list[np.ndarray | None], list[tuple[int, int, int, int]]]:
        """Marks of each language's places after so many steps; and what this chunk is to name: language, place, words and number."""
        told: dict[int, dict[int, dict]] = {}
        for r in replies.to_pylist():
            told.setdefault(r["step"], {})[r["bucket"]] = r
        good: list[np.ndarray | None] = [None] * len(c.parts)
        names = []
        for step in range(steps):
            levels, mine = hashes(c, step, good), told.get(step, {})
            flat = [h for part in levels for _, h in part]
            every = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            values, _, runs = c.asked(every)
            named = np.flatnonzero(c.told(values, runs, {k: r["named"] for k, r in mine.items()}))
            if len(named):
                f = np.concatenate([_unsquash(mine[k]["f"], np.int64) for k, _ in runs])
                where = np.concatenate([w for part in levels for w, _ in part])
                owner = np.repeat([k for k, part in enumerate(levels) for _ in part], [len(h) for h in flat])
                words = np.repeat([n for _ in levels for n in ([1], [2], range(3, longest + 1))[step]], [len(h) for h in flat])
                order = np.argsort(every, kind="stable")
                at = order[np.searchsorted(every[order], values[named])]
                names += zip(owner[at].tolist(), where[at].tolist(), words[at].tolist(), f.tolist())
            if step < 2:
                hit = c.told(values, runs, {k: r["bits"] for k, r in mine.items()})[np.searchsorted(values, every)]
                at = 0
                for k, [(where, h)] in enumerate(levels):
                    good[k] = np.zeros(len(c.parts[k][2]), bool)
                    good[k][where[hit[at : at + len(h)]]] = True
                    at += len(h)
        return good, names

    def ask(step: int):
        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            if not left.num_rows:
                return _table([], _ASK_SCHEMA)
            c = _Chunk(left, buckets)
            good = replay(c, right, step)[0] if step else [None] * len(c.parts)
            flat = [h for part in hashes(c, step, good) for _, h in part]
            values, n, runs = c.asked(np.concatenate(flat) if flat else np.zeros(0, np.uint64))
            chunk = left.column("chunk")[0].as_py()
            return _table([(k, chunk, _squash(_steps(values[s])), _squash(n[s].astype(np.uint32))) for k, s in runs], _ASK_SCHEMA)

        return (lambda table: run(table)) if step == 0 else (lambda left, right: run(left, right))

    def mine(step: int):
        def run(table: pa.Table) -> pa.Table:
            asked = sorted(table.to_pylist(), key=lambda r: r["chunk"])
            values = [np.cumsum(_unsquash(r["a"], np.uint64), dtype=np.uint64) for r in asked]
            shard = np.repeat([r["chunk"] // per_shard for r in asked], [len(v) for v in values])
            every, first, back = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
            n = np.concatenate([_unsquash(r["b"], np.uint32) for r in asked])
            candidate, f = np.zeros(len(every), bool), np.zeros(len(every), np.int64)
            for s in np.unique(shard):
                own = shard == s
                here = np.bincount(back[own], n[own], len(every)).astype(np.int64)
                candidate |= here * shards >= support
                f += here
            out, at = [], 0
            for r, v in zip(asked, values):
                k = back[at : at + len(v)]
                named = candidate[k] & (f[k] >= support) & (first[k] == np.arange(at, at + len(v)))
                out.append((r["chunk"], step, r["bucket"], np.packbits(candidate[k]).tobytes(), np.packbits(named).tobytes(), _squash(f[k[named]])))
                at += len(v)
            return _table(out, _TELL_SCHEMA)

        return run

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _OUT_SCHEMA)
        c = _Chunk(left, buckets)
        out = [(lang, "", 0, len(h)) for lang, _, h, *_ in c.parts]
        for k, i, words, f in replay(c, right, 3)[1]:
            lang, raw, _, start, stop, *_ = c.parts[k]
            out.append((lang, b" ".join(raw[start[j] : stop[j]] for j in range(i, i + words)).decode(), words, f))
        return _table(out, _OUT_SCHEMA)

    replies = rows.groupBy("chunk").applyInArrow(ask(0), _ASK).groupBy("bucket").applyInArrow(mine(0), _TELL)
    for step in (1, 2):
        told = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ask(step), _ASK)
        replies = replies.unionByName(told.groupBy("bucket").applyInArrow(mine(step), _TELL))
    counted = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(count, _OUT)
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, salts: int = 64, **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score.

    Cut in two, a phrase scores ``1000 * a * n div (l * r)`` with the occurrences a of the whole, l and r of the parts and n of all
    words; the lowest cut counts, of equal ones the first.  A phrase that always stands in the same longer one is left out.
    """
    tmp = Scratch(docs.sparkSession, "phrases")
    every = tmp.write(phrase_counts(docs, support, longest, **how), "counts")
    f = every.where("words > 0").select("lang", "phrase", "f")
    whole = every.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    # What a longer phrase holds, and how often the most frequent longer one occurs.
    inner = whole.where("words > 2").select("lang", "a", F.explode(F.array_distinct(F.expr(
        "flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))"
    ))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = whole.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    cut = F.expr("transform(sequence(1, words - 1), k -> struct(k as k, array_join(slice(w, 1, k), ' ') as left, array_join(slice(w, k + 1, words), ' ') as right))")
    cuts = free.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    n = every.where("words = 0").select("lang", F.col("f").alias("n"))
    scored = cuts.join(n, "lang").withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)  # no task ranks a whole language
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
