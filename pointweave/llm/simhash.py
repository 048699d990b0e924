"""Near-duplicate documents by SimHash, compared with BK-trees.

Fingerprints.  Text is cut into words at ASCII white space after lower-casing A-Z;
shingles are runs of ``shingle`` words joined by one space (a shorter text gives its
whole word sequence as its one shingle; no words give fingerprint zero).  A bit is 1
where more than half of the shingles' XXH64 values (seed 42) have it.

A fingerprint of distinct shingles counts each once, so that one word that fills half of
a text doesn't decide it.

Linking.  Fingerprints within ``max_distance`` bits link.  Copies of a fingerprint
collapse first.  The 64 bits are cut into ``max_distance + 2`` blocks: two fingerprints
that close agree on at least two whole blocks, so every pair of blocks is a key and
fingerprints meet in the shards of their common keys, and only there.  Each shard is held
in one BK-tree: children hang on their integer Hamming distance to the parent, and a
search follows only edges within the radius of its own distance.  A shard larger than
``shard_rows`` is cut into chunks by hash; the tree of each chunk goes to every chunk of
its shard, so no task holds more than two chunks and no pair is skipped.  A task hands on
the links that join groups so far apart, never all pairs.

Several fingerprints of a text, with hashes of other seeds, give it as many chances: two
texts link if they are near in any of them.  ``check`` adds one more that linked rows must also
agree on, within its own distance.  Fingerprints of single distinct words move little when a copy is edited, and
so find near copies within few bits; those of 5-word shingles then tell copies from texts
that only share their vocabulary.  Two texts whose 5-word shingles have a Jaccard
similarity of 0.8 differ in about 64 * acos(1.6 / 1.8) / pi = 9.7 of 64 bits.

Defined cases: a null text counts as empty; empty texts link with one another; rows
that repeat an id each get a row; rows without an id get a fingerprint and no component,
and link nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.packing import by_bytes
from pointweave.llm.substring import rolling, word_hashes
from pointweave.operators.components import connected_components
from pointweave.sources.scratch import Scratch

SEED = 42


class Kind(NamedTuple):
    """What a fingerprint is made of."""

    shingle: int = 3
    distinct: bool = False
    seed: int = SEED


class Check(NamedTuple):
    """The second fingerprint, and how many bits of it may differ."""

    kind: Kind = Kind(5, True)
    distance: int = 14


def fingerprint(text: bytes | None, kind: Kind = Kind()) -> int:
    """Signed 64-bit SimHash of one text in UTF-8."""
    shingle, distinct, seed = kind
    words = (text or b"").lower().split()  # bytes.lower() and .split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        parts = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    if distinct:
        parts = set(parts)
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = (Kind(),), check: Check | None = None) -> DataFrame:
    """``id, fps, fp2`` (signed longs, one of fps for each kind) of every row; fp2 is 0 without a check."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = [[fingerprint(t.as_py(), k) for k in kinds] for t in texts]
            second = [fingerprint(t.as_py(), check.kind) for t in texts] if check else [0] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(second, pa.int64())], ["id", "fps", "fp2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(prints, "id long, fps array<long>, fp2 long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """Position of the value, which is added if it is new."""
        new = len(self.values)
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            onward = self.children[at].get(d)
            if onward is None:
                self.children[at][d] = new
                break
            at = onward
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at that distance or nearer."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


Row = tuple[int, int, int]  # id, fp, fp2


def _joins(held: list[Row], probes: list[Row] | None, radius: int, far: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect all probes and held rows within both distances; no probes: the held rows among themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    tree, at_node, out = BKTree(), [], []

    def add(row: Row) -> None:
        node = tree.insert(row[1])
        if node == len(at_node):
            at_node.append([])
        at_node[node].append(row)

    if probes is not None:
        for row in held:
            add(row)
    for row in held if probes is None else probes:
        mine = root(row[0])
        for node in tree.within(row[1], radius):
            for i, _, second in at_node[node]:
                if (second ^ row[2]).bit_count() <= far and (other := root(i)) != mine:
                    parent[mine] = other
                    mine = other
                    out.append((i, row[0]))
        if probes is None:
            add(row)
    return out


def near_links(classes: DataFrame, prints: int = 1, max_distance: int = 3, check_distance: int = 64, shard_rows: int = 256) -> DataFrame:
    """Links ``src, dst`` between rows ``id, fps, fp2`` (distinct values) that connect all within the distances."""
    n = max_distance + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [block[i] | block[j] for i, j in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.struct(F.lit(p * len(signed) + k).alias("mask"), F.col("fps")[p].bitwiseAND(F.lit(m)).alias("key"), F.col("fps")[p].alias("fp")) for p in range(prints) for k, m in enumerate(signed)]
    keyed = classes.select("id", "fp2", F.explode(F.array(*keys)).alias("s")).select("id", "s.mask", "s.key", "s.fp", "fp2")
    crowd = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(crowd, ["mask", "key"]).select("mask", "key", "id", "fp", "fp2", F.ceil(F.col("n") / shard_rows).cast("int").alias("chunks"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", "fp2"), "chunks").cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("mask", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "fp", "fp2")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, out = None, [], []

        def close() -> None:
            if shard and len(rows) > 1:
                lo, hi = shard[2], shard[3]
                held = [r[1:] for r in rows if r[0] == lo]
                out.extend(_joins(held, None if lo == hi else [r[1:] for r in rows if r[0] == hi], max_distance, check_distance))

        for b in batches:
            for *key, own, i, v, second in zip(*(c.to_pylist() for c in b.columns)):
                if key != shard:
                    close()
                    shard, rows = key, []
                rows.append((own, i, v % (1 << 64), second % (1 << 64)))  # the bits of a negative long are counted from its unsigned value
            yield _links(out)
            out = []
        close()
        yield _links(out)

    def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        src, dst = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    by = ["mask", "key", "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(trees, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = (Kind(),), max_distance: int = 3, check: Check | None = None) -> DataFrame:
    """``id, fp, component``: every document's (first) fingerprint and the smallest id its links reach."""
    tmp = Scratch(docs.sparkSession, "simhash")
    prints = tmp.write(with_fingerprint(docs, id_col, text_col, kinds, check), "prints")
    classes = tmp.write(prints.where("id is not null").groupBy("fps", "fp2").agg(F.min("id").alias("id")), "classes")
    links = tmp.write(near_links(classes, len(kinds), max_distance, check.distance if check else 64), "links")
    whole = connected_components(links)
    named = classes.join(whole.withColumnRenamed("node", "id"), "id", "left").select("fps", "fp2", F.coalesce("component", "id").alias("component"))
    out = prints.join(named, ["fps", "fp2"], "left")
    return out.select("id", F.col("fps")[0].alias("fp"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


# Near copies at a Jaccard similarity of 5-word shingles.

SHINGLE = 5
SLACK = 1e-6  # so that rounding drops no pair that is just similar enough
PRINTS = 4
TABLES, TABLE_BITS, TABLE_SHINGLES = 20, 8, 2
#: For each table, the bits of the PRINTS fingerprints that are in its key, and the orders whose first shingles are.
_CHOSEN = np.stack([np.random.RandomState(SEED + t).permutation(64 * PRINTS)[:TABLE_BITS] for t in range(TABLES)])
_WEIGHTS = np.uint64(1) << np.arange(TABLE_BITS, dtype=np.uint64)
_ORDERS, _FACTORS = np.random.RandomState(SEED).randint(0, 1 << 64, (2, TABLES * TABLE_SHINGLES, 1), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of SHINGLE words; fewer words are one shingle."""
    words, cut = word_hashes([(t or b"").lower() for t in texts])
    at, run = rolling(words, cut, SHINGLE)
    edge = np.searchsorted(at, cut)
    out = []
    for lo, hi, a, b in zip(edge, edge[1:], cut, cut[1:]):
        if lo == hi and b > a:
            out.append(rolling(words[a:b], np.array([0, b - a]), int(b - a))[1])
        else:
            out.append(np.unique(run[lo:hi]))
    return out


def _name_of(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a set; that of the empty set is 0."""
    value = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0
    return value - (1 << 64) if value >> 63 else value


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """The 64 * PRINTS bits of the SimHashes of a set, each of values mixed anew."""
    out = []
    for k in range(PRINTS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            h = hashes[at : at + 65_536] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            if k:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(2 * ones > len(hashes))
    return np.concatenate(out)


def table_keys(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The key of a set in each table: bits of its fingerprints and the shingles that come first in two random orders of all shingles."""
    first = np.full(TABLES * TABLE_SHINGLES, -1, np.int64).view(np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at : at + 1024] ^ _ORDERS) * _FACTORS
        x ^= x >> np.uint64(32)
        first = np.minimum(first, (x * _FACTORS[::-1]).min(1))
    key = bits[_CHOSEN].astype(np.uint64) @ _WEIGHTS + np.arange(TABLES, dtype=np.uint64) * np.uint64(1 << TABLE_BITS)
    for one in first.reshape(TABLE_SHINGLES, TABLES):
        key = (key ^ one) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """For each of 2 to 4 buckets an element, whether it holds an odd number of them: little-endian bits.

    The bits in which two sets differ are at most as many as the elements that only one of them holds.
    """
    k = max(6, (2 * len(hashes) - 1).bit_length())
    bucket = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    odd = np.bincount((bucket & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Differing bits of two parities; the longer one is folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    for at in range(8 * len(a) // size):
        y ^= x >> (at * size) & ((1 << size) - 1)
    return y.bit_count()


def _batches_of_sets(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in by_bytes(b, b.num_columns - 1, 1_000_000):
        yield part, shingle_sets(part.column(b.num_columns - 1).to_pylist())


def _wide_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, name, n, odd, fps, keys`` of every row with an id: the row's hash, its set's name, size and parity, its fingerprints and its key in every table."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets in _batches_of_sets(b):
                bits = [wide_bits(x) for x in sets]
                fps = [np.packbits(x).view(">i8").tolist() for x in bits]
                keys = [table_keys(x, y) for x, y in zip(sets, bits)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(_name_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(parity, sets), pa.binary()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "name", "n", "odd", "fps", "keys"])

    rows = docs.where(F.col(id_col).cast("long").isNotNull()).select(F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("h"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(prints, "id long, h long, name long, n int, odd binary, fps array<long>, keys array<long>")


def row_hash(docs: DataFrame) -> F.Column:
    """A hash of all columns, and of which are null: rows of one id with the same hash are the same row."""
    return F.xxhash64(*[F.col(c).cast("string") for c in docs.columns], *[F.col(c).isNull() for c in docs.columns])


class Sized(NamedTuple):
    """A class of equal sets in a shard: one of its ``chunk``, with its fingerprints as one number."""

    chunk: int
    name: int
    group: int
    n: int
    odd: bytes
    tried: int | None  # the class with which it was compared already
    fp: int
    hashes: np.ndarray | None = None


def _possible(held: list[Sized], probes: list[Sized] | None, radius: int, similarity: float, group: Callable[[Sized], int]) -> Iterator[tuple[Sized, Sized, float]]:
    """Held row, probe and share of elements that surely differ, of pairs of different groups within the radius that may have the similarity; no probes: the held rows, each with those before it.

    Sizes and parities rule out the others: at similarity s, sets of n and m elements differ in at most (n + m) (1 - s) / (1 + s) elements.
    """
    tree, at_node, most = BKTree(), [], (1 - similarity) / (1 + similarity)

    def add(row: Sized) -> None:
        node = tree.insert(row.fp)
        if node == len(at_node):
            at_node.append([])
        at_node[node].append(row)

    if probes is not None:
        for row in held:
            add(row)
    for row in held if probes is None else probes:
        for node in tree.within(row.fp, radius):
            for other in at_node[node]:
                n, m = row.n, other.n
                if group(other) == group(row) or min(n, m) < similarity * max(n, m) - SLACK or row.tried == other.name or other.tried == row.name:
                    continue
                apart = _apart(row.odd, other.odd)
                if apart <= (n + m) * most + SLACK:
                    yield other, row, apart / (n + m)
        if probes is None:
            add(row)


def _sides(lo: int, hi: int, rows: list[Sized]) -> tuple[list[Sized], list[Sized] | None]:
    """The rows held and the probes of a shard's two chunks, or of one."""
    return (rows, None) if lo == hi else ([r for r in rows if r.chunk == lo], [r for r in rows if r.chunk == hi])


_BY = ["key", "lo", "hi"]


def _in_shards(dealt: DataFrame, state: DataFrame, work: Callable[[list, list[Sized]], list[tuple]], schema: str) -> DataFrame:
    """What ``work([key, lo, hi], rows)`` returns for the rows of each pair of chunks, in the order of ``at``, if they are of two or more groups."""

    def values(c: pa.Array) -> list:
        if not pa.types.is_list(c.type):
            return c.to_pylist()
        flat, edges = c.values.to_numpy(), c.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(edges, edges[1:])]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[Sized]]]:
        shard, rows = None, []
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):  # few rows as Python's objects at a time
            for key, lo, hi, chunk, name, group, n, odd, tried, f0, f1, f2, f3, *more in zip(*map(values, b.columns)):
                if shard != [key, lo, hi]:
                    if rows:
                        yield shard, rows
                    shard, rows = [key, lo, hi], []
                full = 0
                for f in (f0, f1, f2, f3):
                    full = full << 64 | f % (1 << 64)
                rows.append(Sized(chunk, name, group, n, odd, tried, full, *more))
        if rows:
            yield shard, rows

    kinds = [field.split()[0] for field in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[field.split()[1]] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], kinds)

        for shard, rows in shards(batches):
            if len({r.group for r in rows}) > 1:
                out.extend(work(shard, rows))
            if len(out) > 50_000:
                yield taken()
        yield taken()

    held = dealt.join(state, "name")
    held = held.select(*_BY, "own", "name", "grp", "n", "odd", "tried", *[F.col("fps")[k].alias(f"f{k}") for k in range(PRINTS)], *[c for c in state.columns if c == "hashes"], "at")
    sorted_ = held.repartition(*_BY).sortWithinPartitions(*_BY, "at", "name")
    return sorted_.drop("at").mapInArrow(run, schema)


def _met(classes: DataFrame, shard_rows: int) -> DataFrame:
    """``key, chunks, lead, at, own, name``: the keys that two or more classes share, and where the classes stand in the shard.

    ``at`` orders all classes alike in all shards, and the chunks as well; ``lead`` is the first of the shard.
    """
    keyed = classes.select("name", F.pmod(F.xxhash64("name"), F.lit(1 << 31)).alias("at"), F.explode("keys").alias("key"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("lead")).where("n > 1")
    met = keyed.join(crowd, "key").select("key", F.ceil(F.col("n") / shard_rows).cast("int").alias("chunks"), "lead", "at", "name")
    return met.withColumn("own", F.shiftright(F.col("at") * F.col("chunks"), 31).cast("int"))


def _nearest(met: DataFrame, state: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``held, probe``: for each class the one most like it, by parities, of those before it in its chunks and the first ones of its shards."""

    def work(shard: list, rows: list[Sized]) -> list[tuple]:
        best = {}
        for held, probe, apart in _possible(rows, None, radius, similarity, lambda row: row.group):
            best[probe.name] = min(best.get(probe.name, (2.0, 0)), (apart, held.name))
        return [(held, probe, apart) for probe, (apart, held) in best.items()]

    chunk = F.explode(F.when(F.col("at") == F.col("lead"), F.sequence(F.col("own"), F.col("chunks") - 1)).otherwise(F.array("own")))
    dealt = met.withColumn("own", chunk).select("key", F.col("own").alias("lo"), F.col("own").alias("hi"), "own", "at", "name")
    found = _in_shards(dealt, state, work, "held long, probe long, apart double")
    return found.groupBy("probe").agg(F.min(F.struct("apart", "held")).alias("m")).select(F.col("m.held").alias("held"), "probe")


def _undecided(met: DataFrame, state: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``key, lo, hi, own, at, name``: the classes of each two chunks that may be alike to one of another group there, by sizes and parities.

    Chunks that hold only their shard's largest group need not meet one another.
    """

    def work(shard: list, rows: list[Sized]) -> list[tuple]:
        open_ = {r.name for pair in _possible(*_sides(*shard[1:], rows), radius, similarity, lambda row: row.group) for r in pair[:2]}
        return [(*shard, r.chunk, r.name) for r in rows if r.name in open_]

    grouped = met.join(state.select("name", "grp"), "name")
    largest = grouped.groupBy("key", "grp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    mixed = grouped.join(largest, "key").where("grp <> main").select("key", "own").groupBy("key").agg(F.collect_set("own").alias("mixed"))
    others = F.when(F.array_contains("mixed", F.col("own")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.col("mixed"))
    dealt = met.join(mixed, "key").withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "at", "name")
    return _in_shards(dealt, state, work, "key long, lo int, hi int, own int, name long")


def _links(rows: DataFrame, state: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``src, dst``: links between alike sets (``hashes`` of the state) that connect the groups in which all alike ones of each two chunks are."""

    def work(shard: list, rows: list[Sized]) -> list[tuple]:
        parent: dict[int, int] = {}
        out = []

        def root(row: Sized) -> int:
            x = row.group
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for a, b, _ in _possible(*_sides(*shard[1:], rows), radius, similarity, root):
            shared = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
            if shared / (a.n + b.n - shared) >= similarity:
                parent[root(a)] = root(b)
                out.append((a.name, b.name))
        return out

    return _in_shards(rows.withColumn("at", F.pmod(F.xxhash64("name"), F.lit(1 << 31))), state, work, "src long, dst long")


def _sets(tmp: Scratch, names: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``name, hashes`` of the named classes, from the text of one row each."""
    ids = tmp.write(classes.select("id", "name").join(names.distinct(), "name"), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in _batches_of_sets(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_name_of, found), pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["id", "name", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).join(ids.select("id").distinct(), "id", "left_semi")
    held = texts.mapInArrow(sets, "id long, name long, hashes array<long>").join(ids, ["id", "name"], "left_semi").dropDuplicates(["name"])
    held = tmp.write(held.select("name", "hashes"), "sets")
    tmp.drop(ids)
    return held


def _alike(tmp: Scratch, pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The pairs ``src, dst`` whose shingle sets have that Jaccard similarity or more."""
    held = _sets(tmp, pairs.select(F.col("src").alias("name")).unionByName(pairs.select(F.col("dst").alias("name"))), classes, docs, id_col, text_col)
    both = pairs.join(held.select(F.col("name").alias("src"), F.col("hashes").alias("a")), "src").join(held.select(F.col("name").alias("dst"), F.col("hashes").alias("b")), "dst")
    shared = both.select("src", "dst", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("m"))
    good = tmp.write(shared.where(F.col("n") / (F.col("m") - F.col("n")) >= similarity).select("src", "dst"), "alike")
    tmp.drop(held)
    return good


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 52, shard_rows: int = 256) -> DataFrame:
    """``id, h, component, first``: every row with an id, the smallest id that links of exact Jaccard similarity reach, and whether the row is its group's first.

    ``h`` is the row's hash (``row_hash``); a group's first row is that with the smallest id, then hash.  Equal sets of
    5-word shingles are one class.  Classes meet in the shards of TABLES keys, each of TABLE_BITS of the 64 * PRINTS bits of
    their SimHashes and the TABLE_SHINGLES shingles that random orders put first, and are candidates within ``radius`` bits by
    the shard's BK-trees, unless the sets' sizes and parities, whose difference bounds that of the sets from below, rule the
    similarity out; every link is checked on the sets themselves.  At a similarity of 0.8 a first shingle is shared with a chance of 0.8
    and a bit with one of 0.85: a pair meets with a chance of about 1 - (1 - 0.8 ** 2 * 0.85 ** 8) ** 20 = 0.98, and differs in 39 of
    256 bits, give or take 6.  Texts without a common shingle meet in no shard, so what meets doesn't grow by chance with the corpus.

    First each class is tried with the one most like it before it in its chunk, or the shard's first, which is enough to join a clump;
    then, in the shards, all candidates that are still in different groups.  The sets of those go to the shards, which
    return links that join groups, not pairs.  No candidate goes unchecked, but in one group.
    """
    tmp = Scratch(docs.sparkSession, "copies")
    prints = tmp.write(_wide_prints(docs, id_col, text_col), "prints")
    one = F.min_by(F.struct("fps", "keys", "n", "odd"), F.struct("id", "h"))
    classes = tmp.write(prints.groupBy("name").agg(F.min(F.struct("id", "h")).alias("row"), one.alias("s")).select("name", "row.id", "row.h", "s.fps", "s.keys", "s.n", "s.odd"), "classes")
    met = tmp.write(_met(classes, shard_rows), "met")
    alone = tmp.write(classes.join(met.select("name").distinct(), "name", "left_semi").select("name", "fps", "n", "odd"), "alone")
    tried = tmp.write(_nearest(met, alone.withColumn("grp", F.col("name")).withColumn("tried", F.lit(None).cast("long")), radius, similarity), "nearest")
    alike = _alike(tmp, tried.select(F.col("held").alias("src"), F.col("probe").alias("dst")), classes, docs, id_col, text_col, similarity)
    groups = connected_components(alike).select(F.col("node").alias("name"), F.col("component").alias("grp"))
    state = alone.join(groups, "name", "left").join(tried.select(F.col("probe").alias("name"), F.col("held").alias("tried")), "name", "left")
    state = tmp.write(state.withColumn("grp", F.coalesce("grp", "name")), "state")
    rows = tmp.write(_undecided(met, state, radius, similarity), "undecided")
    held = _sets(tmp, rows.select("name"), classes, docs, id_col, text_col)
    more = tmp.write(_links(rows, state.join(held, "name"), radius, similarity), "more")
    groups = connected_components(alike.unionByName(more)).select(F.col("node").alias("name"), F.col("component").alias("grp"))
    grouped = tmp.write(classes.select("name", "id", "h").join(groups, "name", "left").withColumn("grp", F.coalesce("grp", "name")), "groups")
    lowest = grouped.groupBy("grp").agg(F.min(F.struct("id", "h")).alias("low"))
    named = tmp.write(grouped.join(lowest, "grp").select("name", "low"), "named")
    tmp.drop(classes, met, alone, tried, alike, state, rows, held, more, grouped)
    first = (F.col("id") == F.col("low.id")) & (F.col("h") == F.col("low.h"))
    return prints.select("id", "h", "name").join(named, "name").select("id", "h", F.col("low.id").alias("component"), first.alias("first"))
