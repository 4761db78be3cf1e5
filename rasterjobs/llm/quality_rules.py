"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio of trusted text against the whole corpus.

Words and pairs of words are hashed to a fixed number of buckets. Two multinomials are counted over them, one
on trusted documents and one on all documents. A text's verdict is its mean log ratio per n-gram against a fixed
threshold, the same for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.llm.textops import U, Texts, mix, slices, window_hashes
from rasterjobs.runtime import ship

BUCKETS = 1 << 15
#: Mean log ratio (natural, per n-gram) from which a text is kept.
THRESHOLD = -0.1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _features(texts: Texts, words: tuple, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every lower-cased word and pair of words."""
    start, end, bounds = words
    w = texts.hashes(start, end, lower=True)
    owner = np.repeat(np.arange(texts.n), np.diff(bounds))
    pairs = window_hashes(w, 2)
    same = owner[1:] == owner[:-1]
    h = np.concatenate([mix(w, 31), mix(pairs[same], 32)])
    return (h >> U(20)).astype(np.int64) % buckets, np.concatenate([owner, owner[1:][same]])


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One task's counts per bucket: over all documents, and over trusted ones."""
    total = np.zeros((2, buckets), np.int64)
    for batch in batches:
        for part, texts in slices(batch, "text"):
            b, owner = _features(texts, texts.words(), buckets)
            total[0] += np.bincount(b, minlength=buckets)
            trusted = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            total[1] += np.bincount(b[trusted[owner]], minlength=buckets)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "trusted"])


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``log(P(bucket | trusted) / P(bucket | all))`` with add-one smoothing, from rows (doc_id, text) and trusted doc_ids.

    Both counts are whole: every document, and every one of them whose id is trusted. Trusted ids grow with the corpus, so
    they meet the documents by shuffle; texts only pass the ids' hash table, nothing is sorted. Without trusted documents all ratios are 0.
    """
    ship(docs.sparkSession)
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    rows = docs.join(ids.hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = rows.mapInArrow(lambda it: _count(it, buckets), "bucket int, raw long, trusted long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, trusted = np.ones(buckets), np.ones(buckets)
    at = counts["bucket"].to_numpy()
    raw[at] += counts["raw"].to_numpy()
    trusted[at] += counts["trusted"].to_numpy()
    if trusted.sum() == buckets:
        return np.zeros(buckets)
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def base_counts(texts: Texts, words: tuple) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    start, end, bounds = words
    n_words = np.diff(bounds)
    sums = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[texts.offsets[1:]] - s[texts.offsets[:-1]]
    heads = ((texts.data & 0xC0) != 0x80) & ~_SPACE[texts.data]
    # lines with a word, less the distinct ones
    ls, le, lb = texts.lines()
    has = np.searchsorted(start, le) > np.searchsorted(start, ls)
    line_owner = np.repeat(np.arange(texts.n), np.diff(lb))[has]
    key = mix(texts.hashes(ls[has], le[has]) ^ mix(line_owner.astype(U), 41))
    _, first = np.unique(key, return_index=True)
    dup = np.bincount(line_owner, minlength=texts.n) - np.bincount(line_owner[first], minlength=texts.n)
    # words inside 5-word windows that occur twice or more
    w = texts.hashes(start, end)
    owner = np.repeat(np.arange(texts.n), n_words)
    windows = window_hashes(w, 5)
    repeat = np.zeros(texts.n, np.int64)
    if len(windows):
        same = np.flatnonzero(owner[4:] == owner[:-4])
        _, back, count = np.unique(mix(windows[same] ^ mix(owner[same].astype(U), 42)), return_inverse=True, return_counts=True)
        twice = same[count[back] > 1]
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        repeat = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=texts.n)
    return {"n_words": n_words, "word_chars": sums(heads), "n_symbols": sums(_SYMBOL[texts.data]), "n_dup_lines": dup, "n_repeat_words": repeat}


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)`` of every row.

    A null text has no words. ``llr`` is the mean log ratio per n-gram, 0 without words. Repeated rows are
    judged one by one; a text of any length is judged whole; an empty table gives an empty table; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one double per bucket
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = texts.words()
                base = base_counts(texts, words)
                bucket, owner = _features(texts, words, len(shared.value))
                total = np.bincount(owner, weights=shared.value[bucket], minlength=texts.n)
                llr = total / np.maximum(np.bincount(owner, minlength=texts.n), 1)
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                cols = [part.column(0), *(pa.array(base[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "base_failed", "kept", "llr"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in names) + "base_failed boolean, kept boolean, llr double")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """:func:`judge` with ratios of documents labelled good (``quality`` = 1) against all of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge(rows, log_ratios(rows, labels.where("quality = 1")), threshold)
