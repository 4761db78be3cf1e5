"""Benchmark decontamination by a prefix-filtered set join on word shingles.

Every run of ``window`` consecutive words of a benchmark item is a set of shingles. A document holds the run only if it holds all
of them, so the shortest necessary prefix by rising frequency is the run's rarest shingle: runs whose rarest shingle no
document has are ruled out, all others meet documents on that one alone. Where it stands in the run says where the run must
begin in the document; begin and end must lie inside it, and the words there are compared one by one.

Documents are read twice: to count the shingles that the benchmark has as well, and to find the chosen ones. Both
times a bitmap of hashes, of bounded size, keeps other shingles in their task; what passes is joined exactly, so its size
decides only how much is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.llm.textops import U, Texts, mix, slices, window_hashes
from rasterjobs.operators.skew import HOT_KEYS, LEAST_HOT, salted_join
from rasterjobs.runtime import drop, ship, snapshot

#: Words of a run; words of a shingle at most.
WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap at most (64 MiB), bits per shingle below that, bits that a shingle sets.
MOST_BITS, BITS_PER_SHINGLE, PROBES = 1 << 29, 32, 4
#: Hits of a document in one batch of rows.
HITS = 8192

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds) of words: digits, A-Z, a-z and all characters beyond ASCII."""
    start, end = texts._ranges(_BREAK[texts.data])
    return start, end, np.searchsorted(start, texts.offsets)


def _shingles(w: np.ndarray, owner: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first word, hash) of all shingles of each size that stay in one document."""
    for k in sizes:
        h = window_hashes(w, k) + U(k)
        at = np.flatnonzero(owner[: len(h)] == owner[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        yield k, at, h[at]


def _runs(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(item, run, hashes): an item's runs of ``window`` words, or all its words if fewer, and their shingles' hashes."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            start, end, bounds = words(texts)
            w = texts.hashes(start, end, lower=True)
            low = _LOWERED[texts.data].tobytes()
            names = [low[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            ids, runs, hashes = [], [], []
            for i, item in enumerate(part.column("item").to_pylist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                size = min(window, b - a)
                for at in range(a, b - size + 1) if size else ():
                    ids.append(item)
                    runs.append(names[at : at + size])
                    k = min(shingle, size)
                    hashes.append((window_hashes(w[at : at + size], k) + U(k)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["item", "run", "hashes"])


class Bitmap:
    """Which hashes may be wanted: PROBES bits per hash, so that none of them is missed."""

    def __init__(self, hashes: DataFrame, n: int):
        """From column ``h`` of ``hashes``, about ``n`` rows; the driver takes the words that are set, of which there is a bounded number."""
        bits = 1 << 12
        while bits < min(MOST_BITS, BITS_PER_SHINGLE * n):
            bits *= 2
        self.bits = bits

        def words_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.concatenate([_probe(batch.column("h").to_numpy().view(U), k, bits) for k in range(PROBES)])
                word, back = np.unique(place >> U(6), return_inverse=True)
                mask = np.zeros(len(word), U)
                np.bitwise_or.at(mask, back, U(1) << (place & U(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

        table = hashes.select("h").mapInArrow(words_set, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        self.mask = np.zeros(bits // 64, U)
        self.mask[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(U)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.arange(len(h))
        for k in range(PROBES):
            place = _probe(h[found], k, self.bits)
            found = found[(self.mask[place >> U(6)] >> (place & U(63))) & U(1) > 0]
        return found


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (h if k == 0 else mix(h, 20 + k)) & U(bits - 1)


def _counts(batches: Iterator[pa.RecordBatch], wanted: Broadcast, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(h, n) of a slice's shingles that may be wanted."""
    for batch in batches:
        for _, texts in slices(batch, "text"):
            start, end, bounds = words(texts)
            owner = np.repeat(np.arange(texts.n), np.diff(bounds))
            kept = [h[wanted.value.has(h)] for _, _, h in _shingles(texts.hashes(start, end, lower=True), owner, sizes)]
            h, n = np.unique(np.concatenate([np.zeros(0, U), *kept]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


_SCANNED = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("near", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch], wanted: Broadcast, sizes: list[int], window: int) -> Iterator[pa.RecordBatch]:
    """A row per document, with a null ``h``, and one per shingle of it that may be wanted: its word ``at``, and the words from ``first`` on that a run with it can have."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            start, end, bounds = words(texts)
            owner = np.repeat(np.arange(texts.n), np.diff(bounds))
            doc, th, n = part.column("doc").to_pylist(), part.column("th").to_pylist(), np.diff(bounds).tolist()
            rows = [(doc[i], th[i], n[i], None, None, None, None) for i in range(texts.n)]
            for k, at, h in _shingles(texts.hashes(start, end, lower=True), owner, sizes):
                hit = wanted.value.has(h)
                for x, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                    i = int(owner[p])
                    low, a, b = int(bounds[i]), max(int(bounds[i]), p + k - window), min(int(bounds[i + 1]), p + window)
                    near = [_LOWERED[texts.data[start[j] : end[j]]].tobytes().decode("utf-8", "replace") for j in range(a, b)]
                    rows.append((doc[i], th[i], n[i], x, p - low, a - low, near))
                    if len(rows) >= HITS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCANNED, strict=True)], schema=_SCANNED)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCANNED, strict=True)], schema=_SCANNED)


def _joined(rows: DataFrame, table: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which may have many rows per key; keys with many ``rows`` are dealt over salts. Both should be snapshots."""
    if table.count() <= HOT_KEYS:
        return rows.join(F.broadcast(table), key)
    load = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    limit = max(LEAST_HOT, rows.count() // HOT_KEYS)
    hot = snapshot(load.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__salts")), "hot")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def _classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``class, text``: distinct normalised texts with words; ``class, item``: the items that have them)."""
    lowered = F.translate(F.col("text").cast("string"), "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    found = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.array_join(found, " ").alias("text")).where("item is not null and text <> ''").distinct()
    items = snapshot(items, "items")
    classes = snapshot(items.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    members = snapshot(salted_join(items, classes, "text", "n", ["item"]).select("class", "item"), "members")
    drop(items)
    return classes.select("class", "text"), members


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``doc, th, n_words`` per row of ``docs``; ``doc, th, at, size, run_id``: runs found and where; ``run_id, item``: the items of each run).

    ``th`` is ``xxhash64(text)``: with ``doc`` it tells rows apart that repeat a doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    classes, members = _classes(benchmark)
    runs = classes.select(F.col("class").alias("item"), "text").mapInArrow(lambda it: _runs(it, window, shingle), "item long, run array<string>, hashes array<long>")
    runs = snapshot(runs, "runs")
    sizes = sorted(r.k for r in runs.select(F.least(F.size("run"), F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` numbers
    distinct = runs.groupBy("run").agg(F.first("hashes").alias("hashes"), F.count(F.lit(1)).alias("n")).withColumn("run_id", F.monotonically_increasing_id())
    distinct = snapshot(distinct, "distinct")
    owners = salted_join(runs.select("run", F.col("item").alias("class")), distinct.select("run", "run_id", "n"), "run", "n", ["class"]).select("run_id", "class").distinct()
    owners = snapshot(owners, "owners")
    places = snapshot(distinct.select("run_id", F.posexplode("hashes").alias("offset", "h")), "places")
    # rarity: how often documents have a shingle of the benchmark
    use = snapshot(places.groupBy("h").agg(F.count(F.lit(1)).alias("uses")), "uses")
    wanted = spark.sparkContext.broadcast(Bitmap(use, use.count()))
    counts = texts.select("text").mapInArrow(lambda it: _counts(it, wanted, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    known = snapshot(use.join(counts, "h"), "known")
    # a run with a shingle that no document has is nowhere: all of its shingles must be known
    ranked = salted_join(places, known, "h", "uses", ["run_id"]).groupBy("run_id").agg(F.min(F.struct("n", "h", "offset")).alias("x"), F.count(F.lit(1)).alias("there"))
    prefix = ranked.join(distinct, "run_id").where(F.col("there") == F.size("hashes")).select("x.h", "x.offset", "run_id", "run")
    prefix = snapshot(prefix, "prefix")
    chosen = prefix.select("h").distinct()
    narrow = spark.sparkContext.broadcast(Bitmap(chosen, max(1, prefix.count())))
    scanned = snapshot(texts.mapInArrow(lambda it: _scan(it, narrow, sizes, window), "doc long, th long, n_words long, h long, at long, first long, near array<string>"), "scanned")
    met = _joined(scanned.where("h is not null"), prefix, "h", ["doc", "th", "at"])
    begin = F.col("at") - F.col("offset")
    inside = (begin >= 0) & (begin + F.size("run") <= F.col("n_words"))
    there = F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)).cast("int") + 1, F.size("run")) == F.col("run")
    hits = snapshot(met.where(inside & there).select("doc", "th", begin.alias("at"), F.size("run").alias("size"), "run_id").distinct(), "hits")
    drop(runs, distinct, places, use, known, prefix)
    owned = _joined(owners, members, "class", ["run_id"]).select("run_id", "item")
    return scanned.where("h is null").select("doc", "th", "n_words"), hits, owned


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)``, a row for each row of ``docs``: which benchmark items it holds passages of.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A passage is ``window`` consecutive
    words of an item, or all words of an item with fewer; ``n_hit`` counts the document's words inside passages, ``items`` are the
    item_ids that have them, sorted as strings. A null or empty text has no words and no passages; items without words, and
    rows with a null item_id, are in no document; an item that repeats its id has the passages of all its rows. Rows that
    repeat a doc_id are judged one by one, those with a null one too; texts of any length are taken whole. An empty benchmark
    leaves all documents clean; no documents give an empty table. Other columns are not read.
    """
    scanned, hits, owned = occurrences(docs, benchmark, window, shingle)
    by_start = Window.partitionBy("doc", "th").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    covered = F.greatest(end - F.greatest("at", F.coalesce(F.max(end).over(by_start), F.lit(0))), F.lit(0))
    n_hit = hits.select("doc", "th", covered.alias("covered")).groupBy("doc", "th").agg(F.sum("covered").alias("n_hit"))
    owned = snapshot(owned, "owned")
    items = _joined(hits.select("doc", "th", "run_id"), owned, "run_id", ["doc", "th"]).select("doc", "th", F.col("item").cast("string").alias("item")).distinct()
    items = items.groupBy("doc", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))
    same = lambda other: F.col("a.doc").eqNullSafe(F.col(f"{other}.doc")) & (F.col("a.th") == F.col(f"{other}.th"))
    found = snapshot(n_hit.alias("a").join(items.alias("b"), same("b")).select("a.*", "items"), "found")
    out = scanned.alias("a").join(found.alias("b"), same("b"), "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("a.doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """:func:`decontaminate` with a digest of ``items`` in place of the list."""
    out = decontaminate(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
