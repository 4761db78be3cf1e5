"""Exact contributions of features to each prediction of a forest: Shapley values over the paths of Spark's trees.

A leaf's path gives each of its features an interval and the share of training weight that stays in it. With a set of known
features, the leaf counts by the product of hits (known) and shares (unknown), so a feature's Shapley value is a sum over leaves of
``value * (hit - share) * sum over subsets of the path's other features``; the weights of the subsets are integrals of powers of t and
1 - t, so the sum is the integral over t of the product of ``share * (1 - t) + hit * t``, a polynomial that Gauss-Legendre points integrate
exactly. A task takes batches of rows and leaves in arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterjobs.runtime import new_path, ship

#: Numbers in one array of rows x leaves x features.
AT_ONCE = 1 << 20


class Paths:
    """All leaves of a forest: weighted ``value``, and per place on the path ``feature``, interval ``low < x <= high`` and ``share``; places that are left over have share 1."""

    def __init__(self, leaves: list[tuple[float, dict[int, tuple[float, float, float]]]], features: int):
        depth = max([1, *(len(p) for _, p in leaves)])
        self.features, self.value = features, np.array([v for v, _ in leaves])
        self.feature = np.zeros((len(leaves), depth), np.int64)
        self.low, self.high, self.share = np.full(self.feature.shape, -np.inf), np.full(self.feature.shape, np.inf), np.ones(self.feature.shape)
        for i, (_, path) in enumerate(leaves):
            for j, (f, (low, high, share)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = f, low, high, share
        self.base = float((self.value * self.share.prod(axis=1)).sum())
        x, w = np.polynomial.legendre.leggauss(depth // 2 + 1)
        self.points, self.weights = (x + 1) / 2, w / 2

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows x features."""
        out = np.zeros((len(x), self.features))
        leaves = max(1, min(len(self.value), AT_ONCE // (16 * self.feature.shape[1])))
        rows = max(1, AT_ONCE // (leaves * self.feature.shape[1]))
        for b in range(0, len(self.value), leaves):
            cut = slice(b, b + leaves)
            feature, share = self.feature[cut], self.share[cut]
            order = np.argsort(feature.ravel(), kind="stable")
            firsts = np.flatnonzero(np.diff(feature.ravel()[order], prepend=-1))
            for a in range(0, len(x), rows):
                own = x[a : a + rows][:, feature]
                hit = (own > self.low[cut]) & (own <= self.high[cut])
                total = np.zeros(hit.shape)
                for t, w in zip(self.points, self.weights, strict=True):
                    part = share * (1 - t) + hit * t
                    total += w * part.prod(axis=2)[:, :, None] / part
                total *= self.value[cut][:, None] * (hit - share)
                sums = np.add.reduceat(total.reshape(len(own), -1)[:, order], firsts, axis=1)
                out[a : a + rows, feature.ravel()[order][firsts]] += sums
        return out


def paths_of(model, features: int) -> Paths:
    """The leaves of a fitted Spark forest or boosted ensemble, read from the table that it saves: a forest's leaf gives the share of class 1, a boosted tree's its value."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    where = new_path(spark, "model")
    model.save(where)
    rows = spark.read.parquet(f"{where}/data").select("treeID", "nodeData.*").toArrow().to_pylist()  # as many as the model's nodes, which the driver holds
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    regress = hasattr(model, "getLossType")  # boosted trees regress, their statistics are weight, sum and sum of squares
    weights, leaves = ([*model.treeWeights] if regress else [1 / len(trees)] * len(trees)), []
    for k, nodes in trees.items():
        cover = {i: n["impurityStats"][0] if regress else sum(n["impurityStats"]) for i, n in nodes.items()}
        todo = [(0, {})]
        while todo:
            i, path = todo.pop()
            n = nodes[i]
            if n["leftChild"] < 0:
                leaves.append((weights[k] * (n["prediction"] if regress else n["impurityStats"][1] / cover[i]), path))
                continue
            f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            if n["split"]["numCategories"] != -1:
                raise ValueError("contributions need trees of continuous features")
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((n["leftChild"], (low, min(high, at))), (n["rightChild"], (max(low, at), high))):
                todo.append((child, path | {f: (*interval, share * cover[child] / cover[i])}))
    return Paths(leaves, features)


def contributions(model, pixels: DataFrame, features: list[str]) -> DataFrame:
    """``pixels`` with ``base`` and ``phi_<feature>`` for each of ``features``: with the base they sum to the prediction.

    ``model`` is a pipeline whose last stage is a forest, explained by its share of class 1, or boosted trees, explained by their margin.
    A pixel with a missing feature has NULLs; columns of these names give way.
    """
    spark = pixels.sparkSession
    ship(spark)
    made = ["base", *[f"phi_{f}" for f in features]]
    pixels = pixels.drop(*made)
    paths = spark.sparkContext.broadcast(paths_of(model.stages[-1], len(features)))  # the model's size
    rows = pixels.select(*[F.col(f"`{c}`") for c in pixels.columns], *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    kinds = T.StructType([*pixels.schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = len(batch.schema.names) - len(features)
            x = np.stack([batch.column(own + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))], axis=1)
            known = ~np.isnan(x).any(axis=1)
            out = np.zeros((len(x), len(made)))
            out[:, 0] = paths.value.base
            out[known, 1:] = paths.value.contributions(x[known])
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *[pa.array(c, mask=~known) for c in out.T]], kinds.names)

    return rows.mapInArrow(run, kinds)


def mean_contributions(explained: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, importance)``: mean absolute contributions, largest first; a row per feature."""
    sums = explained.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])
    return sums.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("importance"), "feature")
