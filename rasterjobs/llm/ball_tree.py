"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Vectors are dealt over shards by space: a bounded sample is halved again and again, and every vector follows the cuts;
a region that is still too large is halved from a sample of its own, round after round, until only equal vectors are
left to be dealt by hash. Each shard becomes a ball tree. A query first searches its own shard; with the k-th score found there
it meets the balls of all shards (the nodes of all levels); it goes to the few shards with the highest bounds, and then
only to those whose bound still reaches the k-th score. Within a
shard, blocks of queries walk the tree level by level, leave nodes whose bound ``q . centre + |q| * radius`` can't
beat their k-th score, and take the leaves that stay by falling bound, with a k-th score that rises as they go.
"""

from __future__ import annotations

import io
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, ship, snapshot

#: Vectors per shard on average, per leaf at most; queries per block on average.
SHARD, LEAF, BLOCK = 4096, 16, 2048
#: Vectors in the sample that places the cuts between regions, and regions of one round of cuts at most.
SAMPLE, REGIONS = 16_384, 512
#: Shards in a part on average at most; balls that a block of queries meets at once; leaves in the lowest of these balls at most; shards that a query searches before the others.
PART, PAGE, UPPER, NEAR = 16, 4096, 1, 4
#: Queries that a task searches at once, leaves that a query takes at once; from this part of a shard's leaves on all are scored in one product.
AT_ONCE, LEAVES, DENSE = 256, 4, 0.2


def quantise(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v, dim)`` with ``v = floor(scale * x)`` as integers; null vectors and those with a null or non-finite component are left out.

    Rows with a null id are left out. Rows that repeat an id all stay.
    """
    x = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    fine = fine.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    v = F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long"))
    return fine.select("vec_id", v.alias("v")).withColumn("dim", F.size("v"))


def _halve(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(direction between two far points, its median, place of each row on it) of ``x[rows]``."""
    part = x[rows]
    d = ((part - part.mean(axis=0)) ** 2).sum(axis=1)
    p = part[d.argmax()]
    q = part[((part - p) ** 2).sum(axis=1).argmax()]
    side = part @ (q - p)
    return q - p, float(np.median(side)), side


class Cuts:
    """Halvings of space, as a binary heap of (direction, place); ``region`` follows them."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth, self.cuts = depth, []
        groups = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in groups:
                if len(rows) < 2:
                    self.cuts.append((np.zeros(x.shape[1]), 0.0))
                    below += [rows, rows[:0]]
                    continue
                way, at, side = _halve(x, rows)
                if not (side > at).any() and (side < at).any():  # most lie at the far end: cut before it
                    at = float(side[side < at].max())
                self.cuts.append((way, at))
                below += [rows[side <= at], rows[side > at]]
            groups = below

    def region(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            for node in np.unique(at):
                own = at == node
                way, place = self.cuts[first + node]
                at[own] = 2 * node + (v[own] @ way > place)
        return at


def build(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A balanced ball tree: rows ``ids`` and ``v`` by id, ``order`` of rows in leaf order; per node (a binary heap) span, centre, radius."""
    by_id = np.argsort(ids, kind="stable")
    ids, v = ids[by_id], v[by_id]
    x = v.astype(np.float64)
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
    order, spans = np.arange(len(ids)), [(0, len(ids))]
    for node in range((1 << depth) - 1):
        a, b = spans[node]
        rows = order[a:b]
        if b - a > 1:
            order[a:b] = rows[np.argsort(_halve(x, rows)[2], kind="stable")]
        spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
    centre = np.array([x[order[a:b]].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in spans])
    radius = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(axis=1).max(initial=0)) for (a, b), c in zip(spans, centre, strict=True)])
    return {"ids": ids, "v": v, "order": order, "span": np.array(spans, np.int64), "centre": centre, "radius": radius}


class Best:
    """The k greatest (score, then smallest id) of each of n queries so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.kth = k, floor.copy()  # a candidate below kth can't be among the k best
        self.q, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.scored = np.zeros(n, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.kth[q]
        if not good.any():
            return
        q, ids, score = (np.concatenate([x, y[good]]) for x, y in ((self.q, q), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        last = place == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[last])
        self.q, self.ids, self.score = q[top], ids[top], score[top]


def search(tree: dict[str, np.ndarray], ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best rows of a shard for queries ``ids``, ``v``, of which only scores of at least ``floor`` are wanted."""
    q = v.astype(np.float64)
    best = Best(len(ids), k, floor)
    size = np.sqrt((q * q).sum(axis=1))
    rows = tree["v"].astype(np.float64)
    # sums of products of integers: exact in doubles below 2^53
    exact = size.max(initial=0) * np.sqrt((rows * rows).sum(axis=1).max(initial=0)) < 2**52
    slack = 1e-9 * (1 + size * (np.sqrt((tree["centre"] ** 2).sum(axis=1)).max(initial=0) + tree["radius"].max(initial=0)))

    def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (q[a] @ rows[b].T).astype(np.int64) if exact else v[a].astype(np.int64) @ tree["v"][b].astype(np.int64).T

    def product(at: np.ndarray) -> None:
        s = scores(at, np.arange(len(rows)))
        own = tree["ids"][None, :] == ids[at][:, None]
        s[own] = np.iinfo(np.int64).min
        best.scored[at] += len(rows)
        n = min(k, s.shape[1])
        cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        above, tie = s > cut[:, None], s == cut[:, None]
        keep = above | (tie & (np.cumsum(tie, axis=1) <= n - above.sum(axis=1)[:, None]))  # columns stand by id
        a, b = np.nonzero(keep & ~own)
        best.add(at[a], tree["ids"][b], s[a, b])

    alive, bound, first, width = np.ones((len(ids), 1), bool), None, 0, 1
    while first < len(tree["span"]):
        nodes = np.arange(first, first + width)
        if width > 1:
            alive = np.repeat(alive, 2, axis=1)
        some = np.flatnonzero(alive.any(axis=0))
        bound = np.full((len(ids), width), -np.inf)
        bound[:, some] = np.floor(q @ tree["centre"][nodes[some]].T + size[:, None] * tree["radius"][nodes[some]] + slack[:, None])
        alive &= bound >= best.kth[:, None]
        first, width = first + width, 2 * width
    leaves = tree["span"][-alive.shape[1] :]
    longest = int((leaves[:, 1] - leaves[:, 0]).max())
    places = leaves[:, :1] + np.arange(longest)
    filled = places < leaves[:, 1:]
    member = tree["order"][np.where(filled, places, 0)]  # rows of each leaf
    order = np.argsort(np.where(alive, -bound, np.inf), axis=1, kind="stable")
    every = np.arange(len(ids))[:, None]
    for turn in range(0, alive.shape[1], LEAVES):
        if turn == LEAVES:  # the k-th scores of the best leaves are known: where many leaves stay, one product is cheaper
            many = np.flatnonzero((alive & (bound >= best.kth[:, None])).mean(axis=1) > DENSE)
            if len(many):
                mine = np.isin(best.q, many)  # their rows come once more
                best.q, best.ids, best.score = best.q[~mine], best.ids[~mine], best.score[~mine]
                product(many)
                alive[many] = False
        leaf = order[:, turn : turn + LEAVES]
        open_ = alive[every, leaf] & (bound[every, leaf] >= best.kth[:, None])
        if not open_.any():
            break
        at, i = np.nonzero(open_)
        rows_of, there = member[leaf[at, i]], filled[leaf[at, i]]
        np.add.at(best.scored, at, there.sum(axis=1))
        made = ([], [], [])
        for p in range(0, len(at), 1024):
            a, r = at[p : p + 1024], rows_of[p : p + 1024]
            s = np.einsum("pd,pld->pl", q[a], rows[r]).astype(np.int64) if exact else np.einsum("pd,pld->pl", v[a].astype(np.int64), tree["v"][r].astype(np.int64))
            x, y = np.nonzero(there[p : p + 1024] & (s >= best.kth[a][:, None]) & (tree["ids"][r] != ids[a][:, None]))
            for out, part in zip(made, (a[x], tree["ids"][r[x, y]], s[x, y]), strict=True):
                out.append(part)
        best.add(*map(np.concatenate, made))
    return best


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64)


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    small = {k: a.astype(np.int32) if k == "v" and np.abs(a).max(initial=0) < 2**31 else a for k, a in tree.items()}
    np.savez(out, **small)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _follow(rows: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """``rows`` (vec_id, v, dim) with ``region`` by the cuts of their length; lengths without cuts have one region."""

    def place(frames):
        for pdf in frames:
            region = np.zeros(len(pdf), np.int64)
            dims = pdf["dim"].to_numpy()
            for dim in np.unique(dims):
                if int(dim) in cuts and dim > 0:
                    own = np.flatnonzero(dims == dim)
                    region[own] = cuts[int(dim)].region(np.stack(pdf["v"].to_numpy()[own]).astype(np.float64))
            yield pdf.assign(region=region)

    return rows.mapInPandas(place, "vec_id long, v array<long>, dim int, region long")


def _depth(shards: int) -> int:
    return min(REGIONS.bit_length() - 1, (max(1, shards) - 1).bit_length())


def _regions(whole: DataFrame, shard: int) -> DataFrame:
    """``whole`` with ``region``, by space: first by cuts of a hashed sample of about SAMPLE vectors, then large regions by samples of their own."""
    n = whole.count()
    depth = _depth(-(-n // shard))
    if not depth:
        return whole.withColumn("region", F.lit(0).cast("long"))
    part = 10**12 if n <= SAMPLE else max(1, 10**12 * SAMPLE // n)
    hashed = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(10**12))
    some = whole.where(hashed < part).select("vec_id", "v", "dim").toPandas().sort_values("vec_id", kind="stable")
    placed = snapshot(_follow(whole, {int(dim): Cuts(np.stack(g["v"].to_numpy()).astype(np.float64), depth) for dim, g in some.groupby("dim")}), "placed")
    key = ["dim", "region"]
    while True:  # a round divides the largest region by up to REGIONS
        load = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        load = snapshot(load.withColumn("large", (F.col("low") != F.col("high")) & (F.col("n") > 2 * shard)), "load")
        large = load.where("large")
        if not large.limit(1).count():
            drop(load)
            return placed
        rows = salted_join(placed, load.select(*key, "n", "large"), key, "n", ["vec_id"], small=True)
        # a sample always has two different vectors, so that it divides its region
        wanted = F.least(F.lit(SAMPLE), 8 * F.ceil(F.col("n") / shard))
        sample = rows.where("large").where(hashed * F.col("n") < wanted * F.lit(10.0**12)).select(*key, "n", "v")
        sample = sample.unionByName(large.select(*key, "n", F.explode(F.array("low", "high")).alias("v")))

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.unique(np.stack(pdf["v"].to_numpy()).astype(np.float64), axis=0)
            made = Cuts(x, _depth(-(-int(pdf["n"].iloc[0]) // shard)))
            return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "region": [pdf["region"].iloc[0]], "cuts": [pickle.dumps(made)]})

        cuts = snapshot(sample.groupBy(*key).applyInPandas(cut, "dim int, region long, cuts binary"), "cuts")
        salts = F.ceil(F.col("n") / (4 * shard)).cast("int")  # rows that follow one copy of the cuts
        copies = large.join(cuts, key).select(*key, "cuts", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        dealt = rows.where("large").select("vec_id", "v", *key, F.pmod(F.xxhash64("vec_id", "v", F.lit(11)), salts).cast("int").alias("salt"))

        def again(cuts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"vec_id": [], "v": [], "dim": [], "region": []})
            below = pickle.loads(cuts["cuts"].iloc[0]).region(np.stack(rows["v"].to_numpy()).astype(np.float64))
            return rows[["vec_id", "v", "dim"]].assign(region=rows["region"].to_numpy(np.int64) * REGIONS + below)

        moved = copies.groupBy(*key, "salt").cogroup(dealt.groupBy(*key, "salt")).applyInPandas(again, "vec_id long, v array<long>, dim int, region long")
        stay = rows.where("not large").select("vec_id", "v", "dim", (F.col("region") * REGIONS).alias("region"))
        before, placed = placed, snapshot(stay.unionByName(moved), "placed")
        drop(before, load, cuts)


KEY = ["dim", "region", "sub"]


def searched(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, count: bool = False) -> DataFrame:
    """``(query_id, vec_id, score, scored)``: candidates by shard; with ``count`` also a row for each meeting of query and shard, vec_id null, with how many rows were scored."""
    spark = vectors.sparkSession
    ship(spark)
    raw = snapshot(quantise(vectors, scale), "vectors")
    n = raw.count()
    placed = snapshot(_regions(raw, shard), "placed")
    drop(raw)
    # only regions of equal vectors still have more than two shards' worth; they are dealt by hash
    load = placed.groupBy("region", "dim").agg(F.count(F.lit(1)).alias("n"))
    load = snapshot(load.withColumn("subs", F.ceil(F.col("n") / (2 * shard)).cast("int")), "regions")
    sub = F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int").alias("sub")
    key = KEY

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(*_rows(pdf), leaf)
        leaves = (len(tree["span"]) + 1) // 2
        upper = slice(0, 2 * max(1, leaves // UPPER) - 1)  # nodes of the upper levels
        radius = np.where(tree["span"][upper, 1] > tree["span"][upper, 0], tree["radius"][upper], -1e300)  # an empty node reaches nothing
        balls = np.concatenate([tree["centre"][upper], radius[:, None]], axis=1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in key}, "tree": [_pack(tree)], "balls": [list(balls)]})

    shards = salted_join(placed, load, ["region", "dim"], "n", ["vec_id"], small=True).select("region", "dim", sub, "vec_id", "v").groupBy(*key)
    trees = snapshot(shards.applyInPandas(plant, "dim int, region long, sub int, tree binary, balls array<array<double>>"), "trees")
    # a repeated id asks once, with its smallest vector
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "region")).alias("x")).select("vec_id", "x.dim", "x.v", "x.region")
    asked = salted_join(asked, load, ["region", "dim"], "n", ["vec_id"], small=True).select("vec_id", "dim", "v", "region", sub)
    asked = snapshot(asked, "asked")
    drop(placed, load)

    def walk(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            ids, v = _rows(asked)
            floor, meets = asked["floor"].to_numpy(np.int64, copy=True), [{(m["region"], m["sub"]) for m in x} for x in asked["meets"]]
            for r, s, blob in found[["region", "sub", "tree"]].itertuples(index=False, name=None):
                here = np.array([i for i, m in enumerate(meets) if (r, s) in m], np.int64)
                tree = _unpack(blob) if len(here) else None
                for i in range(0, len(here), AT_ONCE):
                    at = here[i : i + AT_ONCE]
                    best = search(tree, ids[at], v[at], k, floor[at])
                    floor[at] = best.kth  # shared with the task's next shard
                    out.append(pd.DataFrame({"query_id": ids[at][best.q], "vec_id": best.ids, "score": best.score}))
                    if count:
                        out.append(pd.DataFrame({"query_id": ids[at], "scored": best.scored}))
        made = pd.concat(out) if out else pd.DataFrame({"query_id": []})
        return made.reindex(columns=["query_id", "vec_id", "score", "scored"]).astype("Int64")

    kinds = "query_id long, vec_id long, score long, scored long"
    planted = trees.count()
    parts = max(1, min(planted, max(4 * spark.sparkContext.defaultParallelism, -(-planted // PART))))
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")

    def meeting(rows: DataFrame) -> DataFrame:
        """What shards give to the queries of ``rows`` (KEY of a shard, vec_id, v, floor): parts of shards by blocks of queries, each vector once a part."""
        asks = rows.select("dim", part, "vec_id", "v", "floor", F.struct("region", "sub").alias("meet"))
        asks = asks.groupBy("dim", "part", "vec_id").agg(F.first("v").alias("v"), F.first("floor").alias("floor"), F.collect_list("meet").alias("meets"))  # at most a part's shards
        asks = snapshot(asks, "asks")
        each = snapshot(asks.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "blocks")
        asks = salted_join(asks, each, ["dim", "part"], "n", ["vec_id"], small=True).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).drop("n", "blocks")
        copies = trees.select("*", part).join(each, ["dim", "part"]).select("dim", "part", "region", "sub", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        group = ["dim", "part", "block"]
        return copies.groupBy(*group).cogroup(asks.groupBy(*group)).applyInPandas(walk, kinds)

    lowest = F.lit(np.iinfo(np.int64).min)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def with_floor(rows: DataFrame, met: DataFrame) -> DataFrame:
        """``rows`` with ``floor``, their query's k-th score so far."""
        kth = met.where("vec_id is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        return rows.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))

    first = snapshot(meeting(asked.withColumn("floor", lowest)), "home")  # at home: one shard of the query's region
    known = snapshot(with_floor(asked, first), "floors")
    # queries in blocks against the balls of shards in pages: only pairs with a bound that reaches the k-th score go on
    balls = trees.agg(F.sum(F.size("balls"))).first()[0] or 0
    pages, blocks = max(1, -(-balls // PAGE)), max(1, -(-n // (every * block)))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    roots = trees.select(*key, F.posexplode("balls").alias("node", "ball"), F.pmod(F.xxhash64(*key), F.lit(pages)).cast("int").alias("page")).withColumn("block", every_of(blocks))
    ask = known.select(*key, "vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), every_of(pages).alias("page"))

    def meet(roots: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(roots) or not len(ask):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in [*key, "vec_id", "bound"]})
        roots = roots.sort_values(["region", "sub", "node"])
        first = np.flatnonzero(~roots[["region", "sub"]].duplicated().to_numpy())  # of each shard
        q, ball, own = np.stack(ask["v"].to_numpy()).astype(np.float64), np.stack(roots["ball"].to_numpy()), roots[key].iloc[first]
        size = np.sqrt((q * q).sum(axis=1))
        bound = q @ ball[:, :-1].T + size[:, None] * ball[:, -1]
        bound += 1e-9 * (1 + size[:, None] * np.sqrt((ball[:, :-1] ** 2).sum(axis=1) + np.maximum(ball[:, -1], 0) ** 2))
        away = (ask["region"].to_numpy()[:, None] != own["region"].to_numpy()) | (ask["sub"].to_numpy()[:, None] != own["sub"].to_numpy())
        best = np.empty((len(ask), len(first)))
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(roots)], strict=True)):
            nodes, width = bound[:, a:b], 1  # a heap: a node reaches no further than those above it
            while 2 * width <= b - a:
                nodes[:, 2 * width - 1 : 4 * width - 1] = np.minimum(nodes[:, 2 * width - 1 : 4 * width - 1], np.repeat(nodes[:, width - 1 : 2 * width - 1], 2, axis=1))
                width *= 2
            best[:, i] = nodes[:, width - 1 :].max(axis=1)
        a, r = np.nonzero((best >= ask["floor"].to_numpy(np.float64)[:, None]) & away)
        return own.iloc[r].reset_index(drop=True).assign(vec_id=ask["vec_id"].to_numpy()[a], bound=best[a, r])

    group = ["dim", "page", "block"]
    pairs = roots.groupBy(*group).cogroup(ask.groupBy(*group)).applyInPandas(meet, "dim int, region long, sub int, vec_id long, bound double")
    pairs = snapshot(pairs.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("bound"), "region", "sub"))), "meetings")
    near = pairs.where(F.col("place") <= NEAR).join(known.select("vec_id", "v", "floor"), "vec_id")
    second = snapshot(meeting(near), "near")
    met = first.unionByName(second)
    raised = snapshot(with_floor(asked.select("vec_id", "v"), met), "floors")
    rest = pairs.where(F.col("place") > NEAR).join(raised, "vec_id").where(F.col("bound") >= F.col("floor"))
    return met.unionByName(meeting(rest))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k greatest integer inner products of each query with rows of other ids.

    Queries are the vectors whose vec_id is divisible by ``every``; a repeated id asks once, with its smallest
    vector, and every row of another id is a candidate. Ties go to the smaller vec_id; fewer candidates give
    fewer rows. Only vectors of the query's length are its candidates. See :func:`quantise` for rows that
    take no part. An empty table gives an empty table; other columns are not read.
    """
    met = searched(vectors, every, k, scale, shard, block, leaf).where("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
