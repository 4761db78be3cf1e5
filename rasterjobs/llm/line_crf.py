"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's potential comes from its own counts, those of the lines beside it, and its hashed words; transitions tie
neighbours. Forward-backward gives each line's marginal, and the length-weighted mean of the marginals is the text's
score. The field learns from labelled documents, alone and joined to chains of several, in which lines change label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.llm.language import in_fold
from rasterjobs.llm.textops import U, Texts, slices
from rasterjobs.runtime import ship, snapshot

#: Learning reads a hashed sample of about so many documents of either label; of a longer one so many consecutive lines, of a longer line so many evenly spaced words.
TRAINING_DOCS, TRAINING_LINES, TRAINING_WORDS = 1_500, 100, 1_000
#: Bytes of training rows that the driver takes; what a hash puts beyond them is not learned from.
TRAINING_BYTES = 64 << 20
#: Documents joined to a chain for learning; buckets of hashed words.
JOINED, BUCKETS = 4, 1 << 12
GOOD = 0.7

_KIND = {name: np.zeros(256, np.int64) for name in ("symbol", "upper", "lower", "digit", "space", "stop", "bang")}
_KIND["symbol"][[ord(c) for c in "#*$%&|<>{}[]=_~^\\"]] = 1
_KIND["upper"][65:91] = 1
_KIND["lower"][97:123] = 1
_KIND["lower"][128:] = 1
_KIND["digit"][48:58] = 1
_KIND["space"][[9, 11, 12, 13, 32]] = 1
_KIND["stop"][[ord(c) for c in ".,;:?"]] = 1
_KIND["bang"][ord("!")] = 1
OWN = 15


@dataclass
class Lines:
    """Lines of documents: ``own`` counts, ``bounds`` of documents, bytes (``length``), ``words`` per line and the ``buckets`` of the words."""

    own: np.ndarray
    bounds: np.ndarray
    length: np.ndarray
    words: np.ndarray
    buckets: np.ndarray


def features(texts: Texts) -> Lines:
    start, end, bounds = texts.lines()
    length = end - start
    n = len(start)
    safe = np.maximum(length, 1)
    sums = {k: np.concatenate([[0], np.cumsum(t[texts.data])]) for k, t in _KIND.items()}
    part = {k: (s[end] - s[start]) / safe for k, s in sums.items()}
    ws, we, _ = texts.words()
    h = texts.hashes(ws, we, lower=True)
    first = np.searchsorted(ws, start)
    words = np.searchsorted(ws, end) - first
    many = np.maximum(words, 1)
    line = np.repeat(np.arange(n), words)
    again = np.zeros(n)
    fresh = np.zeros(n)
    if len(h):
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[same], minlength=n)
        order = np.lexsort((h, line))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        fresh = np.bincount(line[order][new], minlength=n)
    lh = texts.hashes(start, end)
    owner = np.repeat(np.arange(texts.n), np.diff(bounds))
    order = np.lexsort((lh, owner))
    repeated = np.zeros(n, bool)
    repeated[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    own = np.stack(
        [part[k] * w for k, w in (("symbol", 5), ("upper", 2), ("lower", 1), ("digit", 3), ("space", 3), ("stop", 5), ("bang", 5))]
        + [(part["symbol"] > 0.05).astype(float), (part["upper"] > 0.4).astype(float), again / many * 2, 1 - fresh / many, np.log1p(words) / 4, np.minimum(length / many, 40) / 10, repeated & (words > 0), (length == 0).astype(float)]
    ).T.astype(np.float32)
    return Lines(own, bounds, length, words, ((h >> U(40)) % U(BUCKETS)).astype(np.uint16))


def beside(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of every line beside those of the line before and after it in its chain; flags of first and last lines; a constant."""
    n = len(own)
    edge, last = np.zeros(n, bool), np.zeros(n, bool)
    edge[bounds[:-1]] = True
    last[bounds[1:] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[edge], after[last] = 0, 0
    return np.concatenate([own, before, after, edge[:, None], last[:, None], np.ones((n, 1))], axis=1).astype(np.float32)


def lexical(weights: np.ndarray, words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The mean weight of each line's words."""
    return np.bincount(np.repeat(np.arange(len(words)), words), weights=weights[buckets], minlength=len(words)) / np.maximum(words, 1)


def _chains(bounds: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First line of each document, longest first, and how many documents have a t-th line."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), "right")
    return bounds[:-1][order], alive.tolist()


def marginals(e: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of every line, forward, backward): ``e`` is each line's log odds, ``t[i, j]`` the weight of j after i."""
    heads, alive = _chains(bounds)
    a, b = np.zeros((2, len(e))), np.zeros((2, len(e)))
    for step, n in enumerate(alive):
        at = heads[:n] + step
        if step:
            p, q = a[0, at - 1], a[1, at - 1]
            a[0, at] = np.logaddexp(p + t[0, 0], q + t[1, 0])
            a[1, at] = np.logaddexp(p + t[0, 1], q + t[1, 1]) + e[at]
        else:
            a[1, at] = e[at]
    for step in range(len(alive) - 2, -1, -1):
        at = heads[: alive[step + 1]] + step
        p, q = b[0, at + 1], b[1, at + 1] + e[at + 1]
        b[0, at] = np.logaddexp(p + t[0, 0], q + t[0, 1])
        b[1, at] = np.logaddexp(p + t[1, 0], q + t[1, 1])
    odds = np.clip((a[0] + b[0]) - (a[1] + b[1]), -500, 500)
    return 1 / (1 + np.exp(odds)), a, b


@dataclass
class LineCrf:
    weights: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray

    def scores(self, texts: Texts) -> np.ndarray:
        x = features(texts)
        odds = (beside(x.own, x.bounds) @ self.weights).astype(np.float64) + lexical(self.lexicon, x.words, x.buckets)
        good, _, _ = marginals(odds, x.bounds, self.transitions)
        weight = x.length + 1.0
        return np.clip(np.add.reduceat(weight * good, x.bounds[:-1]) / np.add.reduceat(weight, x.bounds[:-1]), 0, 1) if texts.n else np.zeros(0)


def untaught() -> LineCrf:
    return LineCrf(np.zeros(3 * OWN + 3, np.float32), np.zeros(BUCKETS), np.zeros((2, 2)))


def fit(docs: list[Lines], labels: np.ndarray, rounds: int = 100, rate: float = 0.15, penalty: float = 1e-3, seed: int = 5) -> LineCrf:
    """Maximum likelihood by Adam; a document's label holds for its lines. Documents weigh the same in sum by label.

    Every document stands in two chains: alone, and joined to others in a seeded order, so that transitions see both
    lines that keep and lines that change their label.
    """
    sizes = np.array([len(d.words) for d in docs])
    start = np.concatenate([[0], np.cumsum(sizes)])
    own, words, buckets = (np.concatenate([getattr(d, c) for d in docs]) for c in ("own", "words", "buckets"))
    mixed = np.random.default_rng(seed).permutation(len(docs))
    line = np.concatenate([np.arange(start[-1]), *(np.arange(start[i], start[i + 1]) for i in mixed)])
    joined = [sizes[mixed[i : i + JOINED]].sum() for i in range(0, len(docs), JOINED)]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([sizes, joined]))]).astype(np.int64)
    x = beside(own[line], bounds)
    y = np.repeat(labels, sizes).astype(np.float64)[line]
    share = np.where(labels == 1, 1 / max(1, (labels == 1).sum()), 1 / max(1, (labels == 0).sum()))
    per_line = np.repeat(share / np.maximum(sizes, 1), sizes)[line] / 2
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    inner = np.flatnonzero(inner)
    n, widths = x.shape[1], np.maximum(words, 1)
    w, m, v = (np.zeros(n + BUCKETS + 4) for _ in range(3))
    for k in range(1, rounds + 1):
        t = w[-4:].reshape(2, 2)
        e = (x @ w[:n].astype(np.float32)).astype(np.float64) + lexical(w[n:-4], words, buckets)[line]
        good, a, b = marginals(e, bounds, t)
        left = per_line * (y - good)
        of_word = np.repeat(np.bincount(line, weights=left, minlength=len(words)) / widths, words)
        gl = np.bincount(buckets, weights=of_word, minlength=BUCKETS)
        z = np.logaddexp(a[0] + b[0], a[1] + b[1])[inner]
        gt = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                p = np.exp(a[i, inner - 1] + t[i, j] + (e[inner] if j else 0) + b[j, inner] - z)
                seen = (y[inner - 1] == i) & (y[inner] == j)
                gt[i, j] = (per_line[inner] * (seen - p)).sum()
        g = np.concatenate([x.T @ left.astype(np.float32), gl, gt.reshape(-1)]) - penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineCrf(w[:n].astype(np.float32), w[n:-4].copy(), w[-4:].reshape(2, 2).copy())


def _lines(batches: Iterator[pa.RecordBatch], most: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """What learning needs of each document: of a longer one a window of ``most`` lines whose place is a hash of the text."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            x = features(texts)
            places = texts.hashes(texts.offsets[:-1], texts.offsets[1:], seed=7)
            first_word = np.concatenate([[0], np.cumsum(x.words)])
            own, words, buckets = [], [], []
            for i in range(texts.n):
                a, b = int(x.bounds[i]), int(x.bounds[i + 1])
                if b - a > most:
                    a += int(places[i] % U(b - a - most + 1))
                    b = a + most
                kept = [np.arange(first_word[k], first_word[k + 1], 1 + x.words[k] // most_words) for k in range(a, b)]
                own.append(x.own[a:b].tobytes())
                words.append(np.array([len(p) for p in kept], np.int32).tobytes())
                buckets.append(x.buckets[np.concatenate(kept)].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), *(pa.array(c, pa.binary()) for c in (own, words, buckets))], ["doc_id", "quality", "own", "words", "buckets"])


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCS, lines: int = TRAINING_LINES, words: int = TRAINING_WORDS) -> LineCrf:
    """A field from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); a bounded sample of about ``bound`` rows of either label.

    Null doc_ids and labels other than 0 and 1 teach nothing. Without both labels every line scores 0.5.
    """
    ship(docs.sparkSession)
    given = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in given.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return untaught()
    limit = F.when(F.col("quality") == 1, 10**12 * bound // sizes[1] + 1).otherwise(10**12 * bound // sizes[0] + 1)
    some = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < limit).dropDuplicates()  # about 2 x bound rows
    rows = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality")
    kinds = "quality int, own binary, words binary, buckets binary"
    made = rows.select("doc_id", "text", "quality").mapInArrow(lambda it: _lines(it, lines, words), f"doc_id long, {kinds}")
    # the driver takes a row per label and at most so many bytes, in the order of a hash; a repeated id teaches once
    size, h = F.length("own") + F.length("words") + F.length("buckets"), F.xxhash64("own", "words", "buckets")
    one = made.groupBy("doc_id", "quality").agg(F.min(F.struct(h.alias("h"), "own", "words", "buckets")).alias("x")).select("doc_id", "quality", "x.*")
    table = snapshot(one.withColumn("bytes", size), "training")
    before = Window.orderBy("h", "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0)  # about 2 x bound rows
    fitting = table.select("doc_id", "quality", F.sum("bytes").over(before).alias("upto")).where(F.col("upto") <= TRAINING_BYTES).select("doc_id", "quality")
    table = table.join(F.broadcast(fitting), ["doc_id", "quality"], "left_semi").select("quality", "own", "words", "buckets").toArrow()
    found = sorted(zip(*(table[c].to_pylist() for c in ("quality", "own", "words", "buckets")), strict=True))
    if len({q for q, *_ in found}) < 2:
        return untaught()
    some = [Lines(np.frombuffer(o, np.float32).reshape(-1, OWN), np.zeros(0), np.zeros(0), np.frombuffer(w, np.int32), np.frombuffer(b, np.uint16)) for _, o, w, b in found]
    return fit(some, np.array([q for q, *_ in found]))


def score(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """``docs`` (which must have ``text``) with ``score``; a null text is empty. A column of that name gives way."""
    ship(docs.sparkSession)
    docs = docs.drop("score")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(crf.scores(texts), pa.float64())], [*part.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double")


def document_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, learned from labels of rows that aren't held out.

    Repeated rows are scored one by one; a null doc_id isn't held out and teaches nothing. A text of any length is
    scored whole; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crf = learn(rows, labels.where(~in_fold(folds, held_out)))
    out = score(rows.select("doc_id", in_fold(folds, held_out).alias("held_out"), "text"), crf)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
