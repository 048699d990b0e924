"""Hierarchical multi-length packing of documents into training sequences.

Tokens.  ``WordIds`` gives exactly what the tokenizer gives for the whole text, from a
bounded table of words met before: the vocabulary's splitting pattern never joins across
ASCII white space, so a text's ids are its chunks' ids in a row.

Packing, within each input partition, in windows of a few lengths (``tiers``, powers of two):
a document's full long windows stand alone; what remains is routed to the shortest tier
that holds it.  Windows are then built from the longest tier down: one piece opens a
window, whole pieces of shorter tiers fill its gap, the longest that fit first, and the last
gap is filled with the head of one more piece, whose rest is routed anew.  Every window
so comes out full.  Pieces wait at most ``flush_tokens`` tokens; the tokens that are left
at a partition's end are cut into windows of their length's powers of two, so nothing is padded.
Windows are dealt to step groups, the longest first, each to the group with fewest tokens.

Nothing is shuffled: the work is one pass over the text, and a partition needs memory for
``flush_tokens`` tokens and one document.

Defined cases: a null text is empty, and its document is the end token alone; rows that
repeat an id, or lack one, are packed as rows of their own, in the order they are read; a text of any
length is encoded whole and cut into windows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.sources.worker import kept

TIERS = (2048, 1024, 512, 256)
END_ID = 1

#: Latin letters and ASCII for which lower-casing and splitting here agree with the tokenizer's; other texts go to it whole.
ODD = r"[^\t-\r -~\x{a1}-\x{12f}\x{131}-\x{17e}]|<\|"
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ž0-9²³¹¼-¾]+")


class WordIds:
    """Texts to little-endian unsigned 32-bit ids of one vocabulary file with word ends.

    A batch of texts is cut into chunks at white space, and each distinct chunk is looked up once.
    Chunks met before are kept in two tables, a young and an old one, of about ``table_bytes``
    together.  What is found in the old one moves to the young one; when that fills half the
    bound, it becomes the old one, and what nobody asked for since is forgotten.
    """

    def __init__(self, path: str, table_bytes: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Words come lower-cased and parted, so their tokenizer need not look for either.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table_bytes = table_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # estimated bytes of the young table
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learnt(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, whose words are encoded in a row and told apart by their word ends."""
        words = [SPLIT.findall(c) for c in chunks]
        ids = np.array(self.of_words.encode_batch_fast([" ".join(map(" ".join, words))], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        last = np.cumsum([len(w) for w in words])
        if len(cuts) != last[-1] + 1:
            return [self.whole(c) for c in chunks]
        raw, stops = ids.tobytes(), (4 * cuts[last]).tolist()
        return [raw[at:to] for at, to in zip([0, *stops], stops)]

    def _of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if self.held > self.table_bytes // 2:
            self.young, self.old, self.held = {}, self.young, 0
        young = self.young
        missing = [c for c in chunks if c not in young]
        self.held += 200 * len(missing) + 2 * sum(map(len, missing))
        young.update((c, self.old[c]) for c in missing if c in self.old)
        unknown = [c for c in missing if c not in young]
        if unknown:
            young.update(zip(unknown, self._learnt(unknown)))
        return list(map(young.__getitem__, chunks))

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        rows = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = rows.flatten().dictionary_encode()
        ids = self._of(coded.dictionary.to_pylist())
        size = np.array([len(i) // 4 for i in ids], np.int64)
        flat, start, code = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[code])])  # of each chunk, in ids of the batch
        every = flat[np.repeat(start[code] - ends[:-1], size[code]) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])]).tolist()
        return [self.whole(texts[k].as_py()) if o else every[at:to] for k, (o, at, to) in enumerate(zip(odd.to_pylist(), cuts, cuts[1:]))]


class Packer:
    """The windows of one partition.  A piece is (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536):
        self.tiers, self.step_tokens = sorted(tiers, reverse=True), step_tokens
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.waiting = 0

    def add(self, doc: int, length: int) -> None:
        top = self.tiers[0]
        for start in range(0, length - top + 1, top):
            self.done.append((top, [(doc, start, top)]))
        self._route(doc, length - length % top, length % top)
        self.waiting += length

    def _route(self, doc: int, start: int, length: int) -> None:
        if length:
            self.pools[min(t for t in self.tiers if t >= length)].append((doc, start, length))

    def _take(self, gap: int) -> tuple[int, int, int] | None:
        """A piece of at most that length: the longest whole one by tier, or else the head of one."""
        for t in self.tiers:
            if t <= gap and self.pools[t]:
                return self.pools[t].pop()
        for t in reversed(self.tiers):
            if self.pools[t]:
                doc, start, length = self.pools[t].pop()
                self._route(doc, start + gap, max(0, length - gap))
                return doc, start, min(gap, length)
        return None

    def windows(self, last: bool = False) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(tier, step group, pieces) of what has gathered; what can't fill a window waits, unless it is the last call."""
        for t in self.tiers:
            while self.pools[t]:
                pieces, gap = [self.pools[t].pop()], t
                gap -= pieces[0][2]
                while gap and (piece := self._take(gap)):
                    pieces.append(piece)
                    gap -= piece[2]
                if not gap:
                    self.done.append((t, pieces))
                elif last:
                    self.done += self._powers(pieces)
                else:
                    for piece in pieces:
                        self._route(*piece)
                    break
            if any(self.pools.values()) and not last and self.pools[t]:
                break
        out = sorted(self.done, key=lambda w: -w[0])
        groups = [(0, g) for g in range(max(1, round(sum(w[0] for w in out) / self.step_tokens)))]
        dealt = []
        for tier, pieces in out:
            tokens, g = heapq.heappop(groups)
            dealt.append((tier, g, pieces))
            heapq.heappush(groups, (tokens + tier, g))
        self.done, self.waiting = [], sum(p[2] for pool in self.pools.values() for p in pool)
        return dealt

    @staticmethod
    def _powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The pieces in a row, cut where the binary digits of their total length say."""
        total, out, todo = sum(p[2] for p in pieces), [], list(reversed(pieces))
        for bit in reversed(range(total.bit_length())):
            want = total & (1 << bit)
            row, need = [], want
            while need:
                doc, start, length = todo.pop()
                use = min(need, length)
                row.append((doc, start, use))
                need -= use
                if length > use:
                    todo.append((doc, start + use, length - use))
            if want:
                out.append((want, row))
        return out


def by_bytes(b: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about that many bytes of a column of texts, one row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(b.column(column)), pa.int64()), 0)).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < b.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + size, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, flush_tokens: int = 500_000, table_bytes: int = 160_000_000) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence, and its ids' CRC-32; a worker remembers words in about ``table_bytes``."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("word ids", vocabulary, table_bytes), lambda: WordIds(vocabulary, table_bytes))
        first = TaskContext.get().partitionId() << 40
        sequence = step = first
        packer, held, at = Packer(tiers), {}, 0

        def rows(last: bool = False) -> pa.RecordBatch:
            nonlocal sequence, step
            out: list[tuple] = []
            windows = packer.windows(last)
            for tier, group, pieces in windows:
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    out.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, tier, step + group))
                    offset += length
                sequence += 1
            step += 1 + max((g for _, g, _ in windows), default=0)
            for doc in held.keys() - {p[0] for pool in packer.pools.values() for p in pool}:
                del held[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names)

        for b in batches:
            for part in by_bytes(b, 1, 4_000_000):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    held[at] = (doc_id, ids + END_ID.to_bytes(4, "little"))
                    packer.add(at, len(ids) // 4 + 1)
                    at += 1
                if packer.waiting >= flush_tokens:
                    yield rows()
        yield rows(last=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(packed, ", ".join(f"{n} long" for n in names))
