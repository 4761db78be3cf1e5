"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters, one bit per language.

Every position of the filter holds a mask with a bit for each language that set it. The AND of an n-gram's
positions gives all languages that (may) contain it at once. A text's hits per language are counted over
all its n-grams and corrected for the filter's false positives; the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterjobs.llm.textops import U, Texts, mix, slices
from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, ship, snapshot

#: Positions per n-gram; the filter has at least so many positions for each of them and for each n-gram of the largest language.
PROBES, ROOM = 3, 4
#: Learning reads about so many labelled documents (all, if there are fewer), about as many of each language; with more
#: languages than that, a hashed part of them is learned. An n-gram counts if a language's documents have it so often.
TRAINING_DOCS, LEAST = 20_000, 2
#: A language contains an n-gram whose share there is at least this part of its largest share in any language.
SHARE = 0.2
#: A text is in learned languages if they contain at least this part of its n-grams, less what false positives give.
KNOWN = 0.5

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(0x110000, bool)
        table[: 0x323B0] = [chr(i).isalpha() for i in range(0x323B0)]  # letters end before this code point
        _LETTER.append(table)
    return _LETTER[0]


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document of each, number of letters per document): n-grams of three characters around each letter.

    Characters are lower-cased; whatever is no letter is a word's edge, and n-grams don't cross edges.
    """
    raw = texts.data.tobytes()
    docs = [raw[texts.offsets[i] : texts.offsets[i + 1]].decode("utf-8", "replace").lower() for i in range(texts.n)]
    points = np.frombuffer(("\n".join(docs) + "\n").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(texts.n), [len(d) + 1 for d in docs])
    c = np.where(_letters()[np.minimum(points, 0x10FFFF)], points, 0).astype(U)
    middle = np.flatnonzero(c)
    before = c[middle - 1]
    before[middle == 0] = 0
    h = mix(before | (c[middle] << U(21)) | (c[middle + 1] << U(42)), 9)
    return h, owner[middle], np.bincount(owner[middle], minlength=texts.n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (n-gram, language) of a task's documents, merged in bounded steps."""

    def merged(parts):
        h, lang, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lang, h))
        h, lang, n = h[order], lang[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])) if len(h) else np.zeros(0, int)
        return h[first], lang[first], np.add.reduceat(n, first) if len(first) else n

    parts = []

    def rows():
        h, lang, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(lang, pa.int32()), pa.array(n, pa.int64())], ["gram", "lang", "n"])

    for batch in batches:
        for part, texts in slices(batch, "text"):
            h, owner, _ = grams(texts)
            lang = part.column("lang_id").to_numpy(zero_copy_only=False).astype(np.int32)[owner]
            parts.append(merged([(h, lang, np.ones(len(h), np.int64))]))
            if len(parts) > 16:
                parts = [merged(parts)]
                if len(parts[0][0]) > 2_000_000:
                    yield rows()
                    parts = []
    if parts:
        yield rows()


def positions(h: np.ndarray, m: int, k: int = PROBES) -> np.ndarray:
    return np.stack([(mix(h, 20 + i) >> U(20)).astype(np.int64) % m for i in range(k)])


def _insert(batches: Iterator[pa.RecordBatch], m: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = positions(b.column("gram").to_numpy(zero_copy_only=False).view(U), m, k)
        lang = np.tile(b.column("lang").to_numpy(zero_copy_only=False), k)
        word, bit = lang // 63, np.left_shift(np.int64(1), (lang % 63).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1).astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(bit)], ["at", "word", "bit"])


class LanguageFilters:
    """``masks[word, position]``, the languages by bit, and each language's rate of false positives."""

    def __init__(self, languages: list[str], masks: np.ndarray, probes: int):
        self.languages, self.masks, self.probes = languages, masks, probes
        fill = np.array([((masks[i // 63] >> (i % 63)) & 1).mean() for i in range(len(languages))]) if languages else np.zeros(0)
        self.false = fill**probes
        # of n-grams that were never inserted, the part that some language seems to contain
        self.noise = float(self._any(mix(np.arange(1 << 16, dtype=U), 41)).mean())

    def counts(self, h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Corrected hits, documents x languages."""
        at = positions(h, self.masks.shape[1], self.probes)
        total = np.bincount(owner, minlength=n)
        out = np.zeros((n, len(self.languages)))
        for word in range(len(self.masks)):
            hit = self.masks[word][at[0]]
            for row in at[1:]:
                hit = hit & self.masks[word][row]
            for i in range(63 * word, min(63 * word + 63, len(self.languages))):
                found = np.bincount(owner[(hit >> np.int64(i % 63)) & 1 == 1], minlength=n)
                out[:, i] = np.maximum(0, found - total * self.false[i]) / max(1e-9, 1 - self.false[i])
        return out

    def _any(self, h: np.ndarray) -> np.ndarray:
        """Whether any language contains an n-gram."""
        at = positions(h, self.masks.shape[1], self.probes)
        return np.any([np.bitwise_and.reduce(mask[at], axis=0) != 0 for mask in self.masks], axis=0)

    def known(self, texts: Texts) -> np.ndarray:
        """The share of each text's n-grams that the languages contain together, corrected; 0 without letters."""
        h, owner, letters = grams(texts)
        found = np.bincount(owner[self._any(h)], minlength=texts.n)
        return np.maximum(0, found - letters * self.noise) / max(1e-9, 1 - self.noise) / np.maximum(letters, 1)

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        h, owner, letters = grams(texts)
        if not self.languages:
            return ["und"] * texts.n, np.zeros(texts.n)
        c = self.counts(h, owner, texts.n)
        best = c.argmax(axis=1)
        top = c[np.arange(texts.n), best]
        c[np.arange(texts.n), best] = -1
        second = np.maximum(c.max(axis=1), 0) if len(self.languages) > 1 else np.zeros(texts.n)
        score = np.where(letters > 0, top / np.maximum(top + second, 1e-12), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], np.clip(score, 0, 1)


def learn(labelled: DataFrame, bound: int = TRAINING_DOCS, share: float = SHARE, least: int = LEAST, k: int = PROBES, m: int | None = None) -> LanguageFilters:
    """Filters from rows (doc_id, text, lang); null texts and langs teach nothing.

    Reads a hashed sample of about ``bound`` rows. All n-grams that it has at least ``least`` times in a language go into the
    filter, whose number of positions ``m`` follows from theirs. What reaches the driver is bounded by the sample.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = snapshot(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = bound / max(1, sizes.count())  # the same bound for each language, so that rare ones are learned as well
    part = (F.lit(10**12 * each) / F.col("n")).cast("long")
    sample = salted_join(rows, sizes, "lang", "n", ["doc_id"], small=True).where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(10**12)) < part)
    sample = snapshot(sample.select("text", "lang"), "sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most a sample's rows
    if not languages:
        return LanguageFilters([], np.zeros((1, 64), np.int64), k)
    ids = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "lang_id int, lang string"))
    counts = sample.join(ids, "lang").select("text", "lang_id").mapInArrow(_count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = snapshot(counts, "grams")
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))  # a row per language of the sample
    parts = counts.join(total, "lang").withColumn("part", F.col("n") / F.col("total"))
    parts = parts.withColumn("top", F.max("part").over(Window.partitionBy("gram")))
    inside = snapshot(parts.where((F.col("n") >= least) & (F.col("part") >= share * F.col("top"))).select("gram", "lang"), "inside")
    if m is None:
        largest = inside.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        m = 1 << max(12, (ROOM * k * largest - 1).bit_length())
    set_bits = inside.mapInArrow(lambda it: _insert(it, m, k), "at int, word int, bit long").groupBy("word", "at").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks = np.zeros(((len(languages) + 62) // 63, m), np.int64)
    masks[set_bits["word"].to_numpy(), set_bits["at"].to_numpy()] = set_bits["mask"].to_numpy()
    drop(sizes, sample, counts, inside)
    return LanguageFilters(languages, masks, k)


def in_fold(modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from its column ``text``; columns of these names give way.

    A null text and one without letters are ``und`` with a score of 0. The score is the best language's
    corrected count as a part of the two best ones', ties go to the language first by code point. Repeated rows
    are predicted one by one, texts of any length whole; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # positions x 8 bytes for each 63 languages

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                lang, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_of_all(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learned from the rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    own = in_fold(folds, held_out)
    filters = learn(rows.where(~own & F.col("doc_id").isNotNull()))
    out = identify(rows.select("doc_id", own.alias("held_out"), "text"), filters)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = KNOWN) -> DataFrame:
    """``docs`` without rows of whose n-grams the learned languages together contain less than ``least``; columns unchanged.

    So texts without letters, in unseen scripts and of random letters go; a text in two languages has a low score
    and stays. Where nothing could be learned every row stays; an empty table gives an empty table.
    """
    filters = learn(docs.select("doc_id", "text", "lang"))
    if not filters.masks.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.known(texts) >= least))

    return docs.mapInArrow(run, docs.schema)
