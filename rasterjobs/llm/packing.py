"""Best-fit packing: tokenised documents into sequences by bounded-space online best-fit.

Each task keeps a fixed number of open bins in a bitset keyed by free space. A piece goes to the open bin with
the least space that still holds it; when a new bin is needed and all are open, the fullest closes first.
Bins still open when a task ends are emptied and their pieces packed once more, longest first, in a second
round dealt over few tasks, so that the number of badly filled bins doesn't grow with the number of tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.runtime import ship, snapshot

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, closed boolean"
_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by way of a bounded cache of words.

    The tokenizer's pre-tokens never span ASCII white space and it ignores case, so a text's ids are those of
    its white-space-separated parts in order; parts are encoded once while they stay in the cache.
    """

    #: Longer words are encoded where they stand and not kept.
    LONG = 64

    def __init__(self, path: str, cached: int = 256 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.ids, self.size = Tokenizer.from_file(path), cached, {}, 0  # bytes at most, bytes
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words in groups: one of letters only is one pre-token; else token offsets tell a token's word."""
        plain, other = [], []
        for w in words:
            t = w.decode()
            (plain if t.isalpha() and (t.isascii() or t.lower().isalpha()) else other).append((w, t))
        for i in range(0, len(plain), 512):
            group = plain[i : i + 512]
            ids = np.array(self.tokenizer.encode(" ".join([t for _, t in group]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(group, (4 * ends).tolist(), strict=True):
                self.ids[w] = raw[at:end]
                at = end
        for i in range(0, len(other), 256):
            group = other[i : i + 256]
            joined = self.tokenizer.encode(" ".join([t for _, t in group]), add_special_tokens=False)
            ends = np.cumsum([len(t) + 1 for _, t in group])
            starts = np.fromiter((a for a, _ in joined.offsets), np.int64, len(joined.offsets))
            cut = 4 * np.searchsorted(starts, np.concatenate([[0], ends[:-1], [ends[-1] + 1]]))
            raw = np.array(joined.ids, "<u4").tobytes()
            for j, (w, _) in enumerate(group):
                self.ids[w] = raw[cut[j] : cut[j + 1]]

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # only the exact form of a special token counts as one, so such texts keep their case
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.ids
        if self.size > self.cached:
            known.clear()
            self.size = 0
        parts = [list(map(known.get, words)) for words in split]
        some = [i for i, p in enumerate(parts) if None in p]
        new = {w for i in some for w, p in zip(split[i], parts[i], strict=True) if p is None}
        if new:
            stems, before = {}, len(known)
            long_ = {w: self._alone(w) for w in new if len(w) > self.LONG}
            new -= long_.keys()
            for w in new:
                stem = w.rstrip(b",.")
                # a run of punctuation after an ASCII letter or digit is a pre-token of its own
                if len(stem) < len(w) and stem and stem[-1:].isalnum():
                    stems[w] = stem
            self._learn([x for x in {y for w in new for y in ((stems[w], w[len(stems[w]) :]) if w in stems else (w,))} if x not in known])
            for w, stem in stems.items():
                known[w] = known[stem] + known[w[len(stem) :]]
            # a word, its ids and what Python needs for an entry
            self.size += sum(len(w) + len(known[w]) for w in new) + 250 * (len(known) - before)
            for i in some:
                parts[i] = [(known[w] if len(w) <= self.LONG else long_[w]) if p is None else p for w, p in zip(split[i], parts[i], strict=True)]
        return list(map(b"".join, parts))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class BestFit:
    """Open bins by free space; ``add`` returns the pieces of the bin that closes, if one does."""

    def __init__(self, capacity: int, bins: int, first: int):
        self.capacity, self.bins, self.next_id = capacity, bins, first
        self.bits, self.by_free, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def _take(self, free: int):
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def add(self, length: int, piece) -> tuple[int, list] | None:
        closed, fitting = None, self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number, content = self._take(free)
        else:
            if self.open >= self.bins:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            number, content, free = self.next_id, [], self.capacity
            self.next_id += 1
        content.append((piece, self.capacity - free))
        free -= length
        if free == 0:
            return (number, content) if closed is None else self._both(closed, (number, content))
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append((number, content))
        self.open += 1
        return closed

    def _both(self, a, b):
        # a full bin that closes at once while another made room for it: the other goes back, space is free again
        free = self.capacity - a[1][-1][1] - a[1][-1][0][3]
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append(a)
        self.open += 1
        return b

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


class _Out:
    """Rows of PIECES in batches of bounded bytes."""

    def __init__(self):
        self.rows, self.size = [], 0

    def put(self, found: tuple[int, list], number: int, closed: bool) -> None:
        for (doc, piece, start, length, ids), offset in found[1]:
            self.rows.append((doc, piece, start, length, ids, number, offset, closed))
            self.size += len(ids) + 64

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            cols = list(zip(*self.rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "closed"]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _first_round(batches: Iterator[pa.RecordBatch], path: str, capacity: int, bins: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = tokenizer(path), end_id.to_bytes(4, "little")
    base = TaskContext.get().partitionId() << 32
    fit, out = BestFit(capacity, bins, 0), _Out()
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, batch.num_rows, 64):
            some = [x.encode() if x is not None else b"" for x in texts.slice(i, 64).to_pylist()]
            for doc, ids in zip(docs[i : i + 64], encode.encode(some), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    done = fit.add(len(part) // 4, (doc, piece, at // 4, len(part) // 4, part))
                    if done:
                        out.put(done, 2 * (base + done[0]), True)
            yield from out.flush(4 << 20)
    for done in fit.rest():
        out.put(done, 2 * (base + done[0]), False)
        yield from out.flush(4 << 20)
    yield from out.flush(0)


def _second_round(batches: Iterator[pa.RecordBatch], capacity: int, bins: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    fit, out = BestFit(capacity, bins, 0), _Out()
    for batch in batches:
        cols = [batch.column(i) for i in range(5)]
        for i in range(0, batch.num_rows, 256):
            for row in zip(*(c.slice(i, 256).to_pylist() for c in cols), strict=True):
                done = fit.add(row[3], row)
                if done:
                    out.put(done, 2 * (base + done[0]) + 1, True)
            yield from out.flush(4 << 20)
    for done in fit.rest():
        out.put(done, 2 * (base + done[0]) + 1, True)
        yield from out.flush(4 << 20)
    yield from out.flush(0)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, bins: int = 256, end_id: int = 0, again: int = 2048) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``: each row's tokens and their place.

    ``ids`` are little-endian unsigned 32-bit token ids; every document ends with ``end_id``. Documents
    longer than ``capacity`` are cut into pieces of that length, the last may be shorter; no other is cut.
    A null or empty text is the one token ``end_id``; a null doc_id stays null. Rows that repeat a doc_id are
    documents of their own. An empty table gives no rows. Other columns of ``docs`` are not read.
    ``bins`` is the number of open bins in a task, ``again`` that of the second round, whose tasks get
    about four times as many leftover bins each.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = snapshot(source.mapInArrow(lambda it: _first_round(it, tokenizer_path, capacity, bins, end_id), PIECES), "packed")
    left = first.where("not closed")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-tokens // (4 * again * capacity)))
    task = F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)).cast("int")
    dealt = left.select("doc_id", "piece", "start", "length", "ids", task.alias("task")).repartition(tasks, "task")
    dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", F.crc32("ids")).drop("task")
    second = snapshot(dealt.mapInArrow(lambda it: _second_round(it, capacity, again), PIECES), "packed")
    return first.where("closed").unionByName(second).drop("closed")


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns: the ids give way to their CRC-32."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
