"""Samples, folds, learning-rate curve and Spark ML classifiers on labelled pixels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterjobs.functions.algebra import valid_only
from rasterjobs.operators.accuracy import accuracy_scores, confusion
from rasterjobs.operators.ranked import row_numbers
from rasterjobs.runtime import ship, snapshot

#: Labelled samples are points that people set; more than this are joined by shuffle instead of a broadcast.
BROADCAST_SAMPLES = 1_000_000


def sample_at(pixels: DataFrame, samples: DataFrame) -> DataFrame:
    """Pixels at labelled locations; the samples' count decides whether they are broadcast."""
    on = [c for c in ("scene_id", "row", "col") if c in samples.columns]
    small = samples.count() <= BROADCAST_SAMPLES
    return pixels.join(F.broadcast(samples) if small else samples, on)


def label_balance(samples: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n, weight)``: balanced weights n_all / (classes * n)."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # a row per label
    return counts.withColumn("weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))


def with_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.join(F.broadcast(label_balance(samples, label).drop("n")), label)  # a row per label


def stratified_folds(samples: DataFrame, k: int = 5, label: str = "label", order: list | None = None, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0 .. k - 1, sizes equal within one per label; rows stand by ``order`` or a seeded hash of their place."""
    order = order or [F.xxhash64(F.lit(seed), "row", "col"), F.col("row"), F.col("col")]
    return row_numbers(samples, [label], order, "__k").withColumn("fold", ((F.col("__k") - 1) % k).cast("int")).drop("__k")


def hashed_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """The form for large inputs: no window, sizes equal on average."""
    return samples.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "row", "col"), F.lit(k)).cast("int"))


def onecycle_lr(spark: SparkSession, total: int, max_lr: float = 1e-3, warmup: float = 0.1, start: float = 25.0, end: float = 1e4) -> DataFrame:
    """``(step, lr)``: cosine up from max_lr / start over the warm-up, then cosine down to max_lr / start / end."""
    top = warmup * total - 1
    step = F.col("id").cast("double")

    def wave(a: float, b: float, share):
        return b + (a - b) / 2 * (1 + F.cos(math.pi * share))

    low = max_lr / start
    up = wave(low, max_lr, F.try_divide(step, F.lit(float(top)))) if top > 0 else F.lit(max_lr)
    down = wave(max_lr, low / end, F.try_divide(step - top, F.lit(total - 1 - top)))
    return spark.range(total).select(F.col("id").alias("step"), F.when(step <= top, up).otherwise(down).alias("lr"))


def _assembled(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip")


def train_random_forest(samples: DataFrame, features: list[str], trees: int = 300, min_leaf: int = 2, depth: int = 30, seed: int = 42):
    """Balanced random forest; Spark's trees end at depth 30."""
    rows = with_weights(valid_only(samples, features))
    return Pipeline(stages=[_assembled(features), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed)]).fit(rows)


def train_boosted_trees(samples: DataFrame, features: list[str], rounds: int = 300, rate: float = 0.05, depth: int = 6, seed: int = 42):
    """Gradient-boosted trees; positives weigh n0 / n1."""
    rows = valid_only(samples, features)
    n = rows.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("q")).first()
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, n["q"] / max(n["p"], 1)).otherwise(1.0))
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[_assembled(features), gbt]).fit(rows)


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """cos(w x + b) features whose dot products approximate the RBF kernel exp(-gamma |x - y|^2) (Rahimi and Recht 2007).

    w and b follow from the parameters, so a saved pipeline holds no more than these.
    """

    size = Param(Params._dummy(), "size", "length of the input vectors", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "gamma of the kernel", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, size: int = 1, width: int = 256, gamma: float = 1.0, seed: int = 42):
        super().__init__()
        self._setDefault(size=1, width=256, gamma=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.size), self.getOrDefault(self.width)
        rng = np.random.default_rng(self.getSeed())
        w, b = rng.normal(0, math.sqrt(2 * self.getOrDefault(self.gamma)), (size, width)), rng.uniform(0, 2 * math.pi, width)
        scale = math.sqrt(2 / width)

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ w + b))) if len(x) else pd.Series([], dtype=object)

        ship(dataset.sparkSession)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(self.getInputCol()))))


def train_svm(samples: DataFrame, features: list[str], c: float = 10.0, width: int = 256, seed: int = 42):
    """Scaled features, random Fourier map of the RBF kernel (gamma 1 / number of features), balanced linear SVM."""
    rows = with_weights(valid_only(samples, features))
    n = max(1, rows.count())
    stages = [_assembled(features, "raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), RandomFourier(inputCol="scaled", outputCol="features", size=len(features), gamma=1 / len(features), width=width, seed=seed), LinearSVC(labelCol="label", weightCol="weight", regParam=1 / (c * n), maxIter=100)]
    return Pipeline(stages=stages).fit(rows)


def predict_map(model, pixels: DataFrame, features: list[str]) -> DataFrame:
    """``pixels`` with ``mask`` from the model; missing features give NULL."""
    key = ["scene_id", "row", "col"]
    made = model.transform(valid_only(pixels, features)).select(*key, F.col("prediction").cast("int").alias("mask"))
    return pixels.drop("mask").join(made, key, "left")


def cross_validate_f1(samples: DataFrame, features: list[str], train, k: int = 5) -> DataFrame:
    """``(mean_f1, std_f1)`` over stratified folds, population deviation; one model per fold.

    Folds are ranked once and written: each model passes its rows several times.
    """
    rows = snapshot(stratified_folds(samples, k), "folds")
    out = None
    for i in range(k):
        model = train(rows.where(F.col("fold") != i).drop("fold"), features)
        scored = model.transform(valid_only(rows.where(F.col("fold") == i), features))
        one = accuracy_scores(confusion(scored.withColumn("pred", F.col("prediction").cast("int")), "pred", "label"), None).select("f1")
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))


def rank_importance(model, features: list[str], spark: SparkSession) -> DataFrame:
    """``(feature, importance)`` of a tree model, largest first; a row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model, samples: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """``(feature, drop)``: how much F1 falls when a feature's values are dealt anew among the rows of a bounded sample."""
    spark = samples.sparkSession
    rows = head_sample(valid_only(samples, features), 500)
    by_place, by_hash = Window.partitionBy(F.lit(1)).orderBy("row", "col"), Window.partitionBy(F.lit(1)).orderBy(F.xxhash64(F.lit(seed), "row", "col"), "row", "col")
    rows = rows.withColumns({"__a": F.row_number().over(by_place), "__b": F.row_number().over(by_hash)})  # at most 500 rows

    def f1(df: DataFrame) -> float:
        scored = model.transform(df).withColumn("pred", F.col("prediction").cast("int"))
        return accuracy_scores(confusion(scored, "pred", "label"), None).first()["f1"]

    whole, out = f1(rows), []
    for name in features:
        other = rows.select(F.col("__b").alias("__a"), F.col(name).alias("__v"))
        out.append((name, whole - f1(rows.drop(name).join(other, "__a").withColumnRenamed("__v", name))))
    return spark.createDataFrame(out, "feature string, drop double").orderBy(F.desc("drop"), "feature")


def head_sample(df: DataFrame, n: int = 500, key: tuple = ("row", "col")) -> DataFrame:
    return df.orderBy(*key).limit(n)
