"""Line dedup by pairwise alignment: documents that share line hashes are aligned with patience diff.

Documents are indexed by hashes of lines with enough words, and of the shortest runs of consecutive lines that have
enough words together. All documents that share a rare hash (RARE of them at most) are paired; a more frequent hash pairs every later
document with the earliest only, so pairs grow with lines, not with the square of a line's documents, and no block is
lost, as the earliest holds all runs of it.

What is aligned are the shortest runs of lines with enough words, so a pair that the diff aligns is a common block and goes from the later
document. One alignment takes the longest order that both documents have; each stretch that it leaves between aligned runs is
aligned with the whole earlier document again, until none is left or aligned, so passages in another order go as well. A run that stands
several times is aligned by its first place, and its copies share the decision.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.llm.textops import U, _powers, mix, slices
from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, ship, snapshot

#: A line of fewer words finds no partners by itself, but in a run of BLOCK_WORDS; a block of fewer words stays.
ANCHOR_WORDS, BLOCK_WORDS = 5, 5
#: A hash is rare if at most so many documents have it (2 or 3): each of them meets all earlier ones.
RARE = 3
#: A document meets at most so many partners in one group of rows; more are dealt over further groups.
PARTNERS = 64


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (by first number) whose second numbers rise; of several ends the middle one, so that what is left is cut in halves."""
    tails, ends, back, pile = [], [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
        back.append(ends[at - 1] if at else -1)
        pile.append(at)
    last = [k for k, at in enumerate(pile) if at == len(tails) - 1]
    out, k = [], last[len(last) // 2] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def places(a: list) -> dict:
    """The first place of each element."""
    return {x: i for i, x in reversed(list(enumerate(a)))}


def patience(a: list, b: list, place: dict | None = None) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising on both sides: equal heads and tails, then first places in their longest common order.

    If a and b have an element in common, some are aligned. ``place`` is ``places(a)``, for an ``a`` that is aligned often.
    """
    place = places(a) if place is None else place
    i, j, m, n = 0, 0, len(a), len(b)
    found = []
    while i < m and j < n and a[i] == b[j]:
        found.append((i, j))
        i, j = i + 1, j + 1
    while i < m and j < n and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
        found.append((m, n))
    first = places(b[j:n])
    pairs = [(j + q, place[x]) for x, q in sorted(first.items(), key=lambda p: p[1]) if i <= place.get(x, -1) < m]
    return sorted([*found, *((p, q) for q, p in _in_order(pairs))])


def runs(h: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the shortest runs of lines with ``least`` words: from each line on, and up to each line.

    Document i has lines bounds[i]:bounds[i + 1]. Such runs inside a block of enough words cover the whole block, so
    the runs that two documents share are exactly the lines of the blocks that they share.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    sizes = np.diff(bounds)
    line, first, last = np.arange(len(h)), np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    end = np.searchsorted(total, total[:-1] + max(1, least), "left")
    start = np.searchsorted(total, total[1:] - max(1, least), "right") - 1
    on, back = end <= last, start >= first
    start, end = np.concatenate([line[on], start[back]]), np.concatenate([end[on], line[back] + 1])
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(h.view(U) * _powers("p", len(h)), out=sums[1:])
        own = (sums[end] - sums[start]) * _powers("i", len(h) + 1)[start]
    return start, end, mix(own ^ (end - start).astype(U), 5).view(np.int64)


def _in_text_order(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of :func:`runs` of one document, by place."""
    start, end, h = runs(lines, words, np.array([0, len(lines)]), least)
    order = np.lexsort((end, start))
    return start[order], end[order], h[order]


class Base:
    """The earlier document of pairs: its runs in order, and the first place of each."""

    def __init__(self, lines: np.ndarray, words: np.ndarray, least: int):
        self.least, self.runs = least, _in_text_order(lines, words, least)[2].tolist()
        self.place = places(self.runs)


def common_blocks(base: Base, b: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines of ``b`` in the runs that align with ``base``, stretch by stretch until nothing more does."""
    start, end, h = _in_text_order(b, words, base.least)
    todo, aligned = [list(dict.fromkeys(h.tolist()))], set()
    while todo:
        stretch = todo.pop()
        at = [j for _, j in patience(base.runs, stretch, base.place)]
        aligned.update(stretch[j] for j in at)
        if at:
            todo += [left for p, q in zip([-1, *at], [*at, len(stretch)], strict=True) if (left := stretch[p + 1 : q])]
    hit = np.isin(h, np.array(list(aligned), np.int64))
    depth = np.zeros(len(b) + 1, np.int64)
    np.add.at(depth, start[hit], 1)
    np.add.at(depth, end[hit], -1)
    return np.flatnonzero(np.cumsum(depth[:-1]) > 0)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, hashes, words): a document's line hashes (64 bits each) and words per line (32 bits each)."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            start, end, bounds = texts.lines()
            h = texts.hashes(start, end)
            ws, _, _ = texts.words()
            words = (np.searchsorted(ws, end) - np.searchsorted(ws, start)).astype(np.int32)
            cut = lambda x: pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(texts.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), cut(h), cut(words)], ["id", "th", "hashes", "words"])


def _anchors(batches: Iterator[pa.RecordBatch], least: int, block: int) -> Iterator[pa.RecordBatch]:
    """(hash, id, th): a document's distinct shortest runs of ``block`` words, and its lines of at least ``least`` words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            each = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
            h, words = np.concatenate(each), np.concatenate([np.frombuffer(x, np.int32) for x in part.column("words").to_pylist()])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            start, _, found = runs(h, words, bounds, block)
            alone = np.flatnonzero((words >= least) & (words < block))  # the others are runs
            found, start = np.concatenate([found, h[alone]]), np.concatenate([start, alone])
            owner = np.searchsorted(bounds, start, "right") - 1
            order = np.lexsort((found, owner))
            found, owner = found[order], owner[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            ids, th = (part.column(c).to_numpy(zero_copy_only=False)[owner[new]] for c in ("id", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(found[new]), pa.array(ids), pa.array(th)], ["hash", "id", "th"])


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, ta, salt, member): first the earlier document's lines, then its partners'; gives lines to delete."""
    at, base = None, None
    for batch in batches:
        ids, ths, gone = [], [], []
        cols = [batch.column(c) for c in ("a", "ta", "id", "th", "hashes", "words")]
        for i in range(0, batch.num_rows, 512):
            for a, ta, b, tb, h, w in zip(*(c.slice(i, 512).to_pylist() for c in cols), strict=True):
                lines, words = np.frombuffer(h, np.int64), np.frombuffer(w, np.int32)
                if b is None:
                    at, base = (a, ta), Base(lines, words, least)
                elif at == (a, ta):
                    found = common_blocks(base, lines, words)
                    if len(found):
                        ids.append(b)
                        ths.append(tb)
                        gone.append(found.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(gone, pa.binary())], ["id", "th", "gone"])


def repeated_lines(docs: DataFrame, anchor_words: int = ANCHOR_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """``(id, th, gone)``: for documents that lose lines, their doc_id, ``xxhash64(text)`` and lists of 32-bit line numbers."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").where("id is not null and text is not null")
    lines = snapshot(rows.mapInArrow(_lines, "id long, th long, hashes binary, words binary"), "lines")
    anchors = lines.mapInArrow(lambda it: _anchors(it, anchor_words, block_words), "hash long, id long, th long")
    ends = anchors.groupBy("hash").agg(F.min(F.struct("id", "th")).alias("f"), F.max(F.struct("id", "th")).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = snapshot(ends.select("hash", F.col("f.id").alias("a"), F.col("f.th").alias("ta"), F.col("l.id").alias("z"), F.col("l.th").alias("tz"), "n"), "ends")
    met = salted_join(anchors, ends, "hash", "n", ["id", "th"]).where("a <> id or ta <> th")
    # a rare hash has a first, a last and one document between: with that one's pair with the last, all are paired
    partner = lambda a, ta, b, tb: F.struct(F.col(a).alias("a"), F.col(ta).alias("ta"), F.col(b).alias("id"), F.col(tb).alias("th"))
    between = (F.col("n") > 2) & (F.col("n") <= rare) & ((F.col("id") != F.col("z")) | (F.col("th") != F.col("tz")))
    both = F.when(between, F.array(partner("a", "ta", "id", "th"), partner("id", "th", "z", "tz"))).otherwise(F.array(partner("a", "ta", "id", "th")))
    pairs = snapshot(met.select(F.explode(both).alias("p")).select("p.*").distinct(), "pairs")
    load = pairs.groupBy("a", "ta").agg(F.count(F.lit(1)).alias("n"))
    load = snapshot(load.withColumn("salts", F.ceil(F.col("n") / PARTNERS).cast("int")), "load")
    members = salted_join(pairs, load, ["a", "ta"], "n", ["id", "th"]).withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.col("salts")).cast("int")).drop("salts", "n")
    members = members.join(lines.dropDuplicates(["id", "th"]), ["id", "th"]).select("a", "ta", "salt", "id", "th", "hashes", "words")
    heads = load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(lines.dropDuplicates(["id", "th"]).withColumnsRenamed({"id": "a", "th": "ta"}), ["a", "ta"])
    heads = heads.select("a", "ta", "salt", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("th"), "hashes", "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = heads.unionByName(members).repartition(parts, "a", "ta", "salt").sortWithinPartitions("a", "ta", "salt", F.col("id").asc_nulls_first(), "th")
    gone = both.mapInArrow(lambda it: _align(it, block_words), "id long, th long, gone binary")
    gone = snapshot(gone.groupBy("id", "th").agg(F.collect_list("gone").alias("gone")), "gone")
    drop(lines, ends, pairs, load)
    return gone


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts, n_lines, n_gone = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                out = set()
                for x in gone or []:
                    out.update(np.frombuffer(x, np.int32).tolist())
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in out) if out else text)
                n_lines.append(len(lines))
                n_gone.append(len(out))
            cols = {"text": pa.array(texts, pa.string()), "gone": None}
            keep = [(c, cols.get(c, part.column(c))) for c in part.schema.names if c != "gone"]
            yield pa.RecordBatch.from_arrays([*(x for _, x in keep), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*(c for c, _ in keep), "__lines", "__gone"])


def dedup_lines(docs: DataFrame, anchor_words: int = ANCHOR_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated blocks, and ``n_lines`` and ``n_removed`` (lines before, lines deleted).

    The document with the smallest doc_id keeps a block (of rows that repeat a doc_id, the one with the
    smaller text hash; equal rows lose the same lines). A line goes if and only if it is in a block of
    consecutive lines with ``block_words`` words together that an earlier document has as well. A null text has
    no lines and stays null; rows with a null doc_id stay as they are; an empty table gives an empty table. A text whose lines
    all go becomes empty. Texts of any length are taken whole, one document of lines at a time. Other columns pass through; columns named n_lines and n_removed give way.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    gone = repeated_lines(docs, anchor_words, block_words).withColumnsRenamed({"id": "__id", "th": "__th"})
    flat = docs.select(*[F.col(f"`{c}`").cast("string").alias("text") if c == "text" else F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__t"))
    joined = flat.join(gone, (F.col("__d") == F.col("__id")) & (F.col("__t") == F.col("__th")), "left").drop("__id", "__th", "__d", "__t")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "gone")
    out = joined.mapInArrow(_cut, f"{kinds}, __lines long, __gone long")
    return out.select(*[F.col("text") if c == "text" else F.col(f"_{i}").alias(c) for i, c in enumerate(names)], F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The pipeline's form: :func:`dedup_lines` less documents that lost all their words; n_chars follows the text."""
    out = dedup_lines(docs, **options).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
