"""Hard negatives by an inverted multi-index: two half-space codebooks form cells, searched by summed half-score bounds.

A vector's first half has a code of one codebook, its second half one of another; a cell is a pair of codes. Shards
are runs of cells with the same first code, and a cell of more rows than a shard holds is dealt over several by hash. Within a
shard the multi-sequence heap gives cells by falling bound ``q1 . c1 + |q1| r1 + q2 . c2 + |q2| r2`` with the radii of the
shard's own rows, and ends at the first cell that can't reach any open window of scores: all windows are then certified.
An anchor searches its own shard first; what it finds there bounds which other shards it meets at all.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, ship, snapshot

#: Rows per cell on average, vectors in the sample that trains the codebooks, its vectors per code at least, rounds of training.
CELL, SAMPLE, PER_CODE, TRAINING = 32, 65_536, 16, 8
#: Numbers in a shard of vectors on average (rows times length), anchors per block, roots of shards per page.
SHARD_NUMBERS, BLOCK, PAGE = 1 << 18, 2048, 2048
#: Rows that an anchor scores at first before it looks at its windows again; doubled each time.
FIRST_ROWS = 64
_LOW, _HIGH = -(1 << 62), 1 << 62


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The code of each row; equal distances go to the smaller code."""
    out = np.empty(len(x), np.int64)
    norms = (centres * centres).sum(axis=1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (norms[None, :] - 2 * x[i : i + 4096] @ centres.T).argmin(axis=1)
    return out


def codebook(x: np.ndarray, codes: int, seed: int = 0) -> np.ndarray:
    """At most ``codes`` centres of ``x`` by Lloyd's rounds from distinct random rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:codes]].copy()
    for _ in range(TRAINING if len(distinct) > codes else 0):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, k], len(centres)) for k in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros_like(centres)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of both arrays, by falling sum."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def _radii(x: np.ndarray, code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The greatest distance of a code's rows from its centre."""
    out = np.zeros(len(centres))
    np.maximum.at(out, code, np.sqrt(((x - centres[code]) ** 2).sum(axis=1)))
    return out


class Shard:
    """Rows of some cells, in order of cells, with the centres and radii that bound their scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, one: np.ndarray, two: np.ndarray):
        order = np.lexsort((ids, two, one))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        x, half = self.v.astype(np.float64), v.shape[1] // 2
        # codes are numbered anew inside the shard; the mean of a code's own rows is the centre that bounds best
        (self.one, i), (self.two, j) = (np.unique(c[order], return_inverse=True) for c in (one, two))
        self.halves = []
        for part, code, n in ((x[:, :half], i, len(self.one)), (x[:, half:], j, len(self.two))):
            size = np.bincount(code, minlength=n)[:, None]
            centres = np.stack([np.bincount(code, part[:, k], n) for k in range(part.shape[1])], axis=1) / size if part.shape[1] else np.zeros((n, 0))
            self.halves.append((centres, _radii(part, code, centres)))
        new = np.flatnonzero(np.diff(i * len(self.two) + j, prepend=-1))
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(new, [*new[1:], len(x)], strict=True)}
        self.size = float(np.sqrt((x * x).sum(axis=1)).max(initial=0))

    def root(self) -> list[np.ndarray]:
        """Centre and radius of each half of all rows."""
        x, half, out = self.v.astype(np.float64), self.v.shape[1] // 2, []
        for part in (x[:, :half], x[:, half:]):
            centre = part.mean(axis=0)
            out += [centre, np.sqrt(((part - centre) ** 2).sum(axis=1)).max(keepdims=True)]
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, out = len(q) // 2, []
        for part, (centres, radii) in zip((q[:half], q[half:]), self.halves, strict=True):
            out.append(centres @ part + np.sqrt(part @ part) * radii)
        return out[0], out[1] + 1e-9 * (1 + np.sqrt(q @ q) * self.size)


def search(shard: Shard, query: int, label: int, v: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per window the (ids, scores) of the k best rows with low <= score <= high, and how many rows were scored.

    Rows have the query's label if ``same``, else another; rows of the query's id are never found.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
    reach = low.copy()  # below this a row is not among a window's k best
    q = v.astype(np.float64)
    exact = float(np.sqrt(q @ q)) * shard.size < 2**52  # sums of products of integers: exact in doubles below 2^53
    rows, n, limit, scored = [], 0, FIRST_ROWS, 0

    def look() -> None:
        at = np.concatenate([np.arange(a, b) for a, b in rows])
        s = (shard.v[at].astype(np.float64) @ q).astype(np.int64) if exact else shard.v[at].astype(np.int64) @ v.astype(np.int64)
        good = (s >= reach.min()) & (s <= high.max()) & ((shard.labels[at] == label) == same) & (shard.ids[at] != query)
        if not good.any():
            return
        ids, s = shard.ids[at[good]], s[good]
        for w in range(len(low)):
            own = (s >= reach[w]) & (s <= high[w])
            if own.any():
                i, t = np.concatenate([best[w][0], ids[own]]), np.concatenate([best[w][1], s[own]])
                order = np.lexsort((i, -t))[:k]
                best[w] = (i[order], t[order])
                if len(order) == k:
                    reach[w] = max(reach[w], t[order[-1]])

    for bound, i, j in multi_sequence(*shard.bounds(q)):
        if bound < reach.min():
            break
        span = shard.cells.get((i, j))
        if span is not None:
            rows.append(span)
            n += span[1] - span[0]
            if n >= limit:
                look()
                scored, rows, n, limit = scored + n, [], 0, 2 * limit
    if rows:
        look()
    return best, scored + n


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.int64)


def _pack(shard: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{c: a.astype(np.int32) if c == "v" and np.abs(a).max(initial=0) < 2**31 else a for c, a in shard.items()})
    return out.getvalue()


def _unpack(blob: bytes) -> Shard:
    with np.load(io.BytesIO(blob)) as z:
        return Shard(*(z[c] for c in ("ids", "labels", "v", "one", "two")))


def _codes(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with codes ``one`` and ``two``, from codebooks of a hashed sample of about SAMPLE rows, by length of vectors."""
    part = 10**12 if n <= SAMPLE else max(1, 10**12 * SAMPLE // n)
    some = rows.where(F.pmod(F.xxhash64("vec_id", "v", F.lit(5)), F.lit(10**12)) < part).select("vec_id", "v", "dim").toPandas()
    books = {}
    for dim, g in some.groupby("dim"):
        if dim:
            x = _stack(g).astype(np.float64)
            x = x[np.lexsort((*x.T[::-1], g["vec_id"].to_numpy()))]
            codes = max(1, min(int(np.sqrt(n / CELL)), len(x) // PER_CODE))
            books[int(dim)] = codebook(x[:, : dim // 2], codes), codebook(x[:, dim // 2 :], codes, 1)

    def place(frames):
        for pdf in frames:
            one, two = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            dims = pdf["dim"].to_numpy()
            for dim in np.unique(dims):
                if int(dim) in books:  # lengths that the sample misses have one cell
                    own = np.flatnonzero(dims == dim)
                    x = np.stack(pdf["v"].to_numpy()[own]).astype(np.float64)
                    one[own], two[own] = (_nearest(h, b) for h, b in zip((x[:, : dim // 2], x[:, dim // 2 :]), books[int(dim)], strict=True))
            yield pdf.assign(one=one, two=two)

    return rows.mapInPandas(place, "vec_id long, label long, v array<long>, dim int, one long, two long")


class Index:
    """All rows in shards: ``placed`` (rows with their shard), ``shards`` (a packed row per shard), ``roots`` (their balls)."""

    KEY = ["dim", "one", "run", "sub"]

    def __init__(self, rows: DataFrame, shard_numbers: int):
        n = rows.count()
        coded = snapshot(_codes(rows, n), "coded")
        cells = coded.groupBy("dim", "one", "two").agg(F.count(F.lit(1)).alias("n"))
        room = F.greatest(F.lit(1), F.floor(F.lit(shard_numbers) / F.greatest("dim", F.lit(1))))
        order = Window.partitionBy("dim", "one").orderBy("two").rowsBetween(Window.unboundedPreceding, -1)  # a row per second code
        before = F.coalesce(F.sum(F.when(F.col("n") <= room, F.col("n"))).over(order), F.lit(0))
        big = F.col("n") > room
        run = F.when(big, -1 - F.col("two")).otherwise(F.floor(before / room))  # a big cell has shards of its own
        cells = snapshot(cells.withColumns({"run": run.cast("long"), "subs": F.when(big, F.ceil(F.col("n") / room)).otherwise(1).cast("int")}), "cells")
        placed = salted_join(coded, cells, ["dim", "one", "two"], "n", ["vec_id"], small=True)
        placed = placed.withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int"))
        self.placed = snapshot(placed.select(*self.KEY, "two", "vec_id", "label", "v"), "placed")
        drop(coded, cells)

        names = self.KEY

        def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            parts = {"ids": pdf["vec_id"].to_numpy(np.int64), "labels": pdf["label"].to_numpy(np.int64), "v": _stack(pdf), "one": pdf["one"].to_numpy(), "two": pdf["two"].to_numpy()}
            blob = _pack(parts)
            root = np.concatenate(_unpack(blob).root())
            return pd.DataFrame([(*key, blob, root)], columns=[*names, "blob", "root"])

        kinds = "dim int, one long, run long, sub int, blob binary, root array<double>"
        self.shards = snapshot(self.placed.groupBy(*self.KEY).applyInPandas(plant, kinds), "shards")
        self.count = self.shards.count()

    def drop(self) -> None:
        drop(self.placed, self.shards)

    def _searched(self, asked: DataFrame, same: bool, k: int, load: DataFrame, block: int) -> DataFrame:
        """``(query_id, tag, vec_id, score, scored)`` of rows ``asked`` (the shard's key, query_id, label, v, tags, low, high) in their shards."""
        blocks = F.ceil(F.col("asks") / block).cast("int")
        copies = self.shards.join(load, self.KEY).select(*self.KEY, "blob", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        dealt = salted_join(asked, load, self.KEY, "asks", ["query_id"]).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))

        def walk(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out, scored = [(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], []
            for blob in found["blob"]:
                shard = _unpack(blob)
                for query, label, v, tags, low, high in asked[["query_id", "label", "v", "tags", "low", "high"]].itertuples(index=False, name=None):
                    best, seen = search(shard, query, label, np.asarray(v), same, np.asarray(low, np.int64), np.asarray(high, np.int64), k)
                    scored.append((query, seen))
                    out += [(np.tile((query, tag), (len(ids), 1)), ids, s) for tag, (ids, s) in zip(tags, best, strict=True) if len(ids)]
            keys, ids, s = (np.concatenate(x) for x in zip(*out, strict=True))
            made = pd.DataFrame({"query_id": keys[:, 0], "tag": keys[:, 1], "vec_id": ids, "score": s}, dtype="Int64")
            seen = pd.DataFrame(scored, columns=["query_id", "scored"], dtype="Int64")
            return pd.concat([made, seen]).reindex(columns=["query_id", "tag", "vec_id", "score", "scored"]).astype("Int64")

        return copies.groupBy(*self.KEY, "block").cogroup(dealt.groupBy(*self.KEY, "block")).applyInPandas(walk, "query_id long, tag long, vec_id long, score long, scored long")

    def _meetings(self, asked: DataFrame, block: int) -> DataFrame:
        """The key of every shard, but the asker's own, whose bound reaches the lowest window of ``asked``, with its query_id."""
        pages, blocks = max(1, -(-self.count // PAGE)), max(1, -(-asked.count() // block))
        roots = self.shards.select(*self.KEY, "root", F.pmod(F.xxhash64(*self.KEY), F.lit(pages)).cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        ask = asked.select(*self.KEY, "query_id", "v", F.array_min("low").alias("least"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
        key = self.KEY

        def meet(roots: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            if not len(roots) or not len(ask):
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in [*key, "query_id"]})
            q, root = _stack(ask).astype(np.float64), np.stack(roots["root"].to_numpy())
            half, d = q.shape[1] // 2, q.shape[1]
            bound = q[:, :half] @ root[:, :half].T + np.sqrt((q[:, :half] ** 2).sum(axis=1))[:, None] * root[:, half]
            bound += q[:, half:] @ root[:, half + 1 : d + 1].T + np.sqrt((q[:, half:] ** 2).sum(axis=1))[:, None] * root[:, d + 1]
            bound += 1e-9 * (1 + np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((root * root).sum(axis=1)))
            away = np.ones(bound.shape, bool)
            for c in key[1:]:
                away &= ask[c].to_numpy()[:, None] == roots[c].to_numpy()
            a, r = np.nonzero((bound >= ask["least"].to_numpy()[:, None]) & ~away)
            out = roots[key].iloc[r].reset_index(drop=True)
            return out.assign(query_id=ask["query_id"].to_numpy()[a])

        return roots.groupBy("dim", "page", "block").cogroup(ask.groupBy("dim", "page", "block")).applyInPandas(meet, "dim int, one long, run long, sub int, query_id long")

    def windows(self, asked: DataFrame, same: bool, k: int, block: int = BLOCK, count: bool = False) -> DataFrame:
        """``(query_id, tag, rank, vec_id, score)``: for each window of ``asked`` its k best rows of all shards.

        ``asked`` has, per query_id, the key of its own shard, label, v, and arrays tags, low and high, an entry per window. With
        ``count``, all rows that shards gave instead, and rows with the number of scores that each query and shard needed.
        """

        def loads(rows: DataFrame) -> DataFrame:
            return snapshot(rows.groupBy(*self.KEY).agg(F.count(F.lit(1)).alias("asks")), "load")

        here = snapshot(self._searched(asked, same, k, loads(asked), block), "home")
        order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
        kth = here.where("vec_id is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("kth"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("kth")[F.element_at("tags", (i + 1).cast("int"))], x)))
        floors = snapshot(asked.join(kth, "query_id", "left").withColumn("low", raised).drop("kth"), "floors")
        pairs = snapshot(self._meetings(floors, block), "meetings")
        far = self._searched(pairs.join(floors.drop(*self.KEY), "query_id"), same, k, loads(pairs), block)
        met = here.unionByName(far)
        if count:
            return met
        return met.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "tag", "rank", "vec_id", "score")


def _numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, v, dim)`` with ``v = floor(scale * x)`` of the rows that take part."""
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = fine.where("vec_id is not null and label is not null and x is not null").where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return fine.select("vec_id", "label", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"), F.size("x").alias("dim"))


def index_of(vectors: DataFrame, scale: int = 256, shard_numbers: int = SHARD_NUMBERS) -> Index:
    """The inverted multi-index of labelled vectors; rows that take no part in :func:`mine` are not in it."""
    ship(vectors.sparkSession)
    rows = snapshot(_numbers(vectors, scale), "labelled")
    out = Index(rows, shard_numbers)
    drop(rows)
    return out


def anchors_of(index: Index, every: int) -> DataFrame:
    """A row per vec_id divisible by ``every``, as :meth:`Index.windows` asks for it: its smallest label and vector, one open window."""
    first = F.min(F.struct("label", "dim", "v", "one", "run", "sub")).alias("x")
    rows = index.placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(first).select(F.col("vec_id").alias("query_id"), "x.*")
    return snapshot(rows.withColumns({"tags": F.array(F.lit(0).cast("long")), "low": F.array(F.lit(_LOW)), "high": F.array(F.lit(_HIGH))}), "anchors")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, shard_numbers: int = SHARD_NUMBERS, block: int = BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the anchors, whose vec_id is divisible by ``every``.

    An anchor's positives are its ``positives`` best rows of the same label, by integer inner product, ties by smaller
    vec_id; each has the best ``negatives`` rows of another label whose score is ``least`` to ``most`` percent of the
    positive's, so a negative positive has none. Rows with a null vec_id or label, a null vector, or one with a null or
    non-finite entry take no part. An id that repeats is one anchor, by its smallest label and vector; rows of the anchor's id are
    neither positives nor negatives of it, and all rows of other ids are candidates, so a repeated id may stand twice.
    Only vectors of the anchor's length meet it. An empty table gives an empty table; other columns are not read.
    """
    index = index_of(vectors, scale, shard_numbers)
    anchors = anchors_of(index, every)
    found = snapshot(index.windows(anchors, True, positives, block).select("query_id", F.col("rank").cast("long").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = F.struct("tag", F.expr(f"(positive_score * {least} + 99) div 100").alias("low"), F.expr(f"positive_score * {most} div 100").alias("high"))
    open_ = found.where("positive_score >= 0").groupBy("query_id").agg(F.array_sort(F.collect_list(bounds)).alias("w"))
    asked = snapshot(anchors.drop("tags", "low", "high").join(open_, "query_id").select("*", "w.tag", "w.low", "w.high").drop("w").withColumnRenamed("tag", "tags"), "asked")
    hard = index.windows(asked, False, negatives, block).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    out = hard.join(found, ["query_id", "tag"]).withColumnRenamed("query_id", "anchor_id")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
