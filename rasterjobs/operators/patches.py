"""Patches: origins, extraction by bucketed range join, statistics, model scoring and overlap averaging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.functions.algebra import sigmoid, uniform
from rasterjobs.operators.ranked import row_numbers
from rasterjobs.operators.summed import SummedArea
from rasterjobs.operators.tiles import TILE
from rasterjobs.runtime import drop, ship, snapshot


def sliding_patches(spark: SparkSession, height: int, width: int, p: int = 512, overlap: int = 64) -> DataFrame:
    """``(patch_id, r0, c0, size)`` at stride p - overlap, the last origin moved to the edge; a grid smaller than p starts at 0."""
    step = p - overlap

    def line(n: int):
        last = max(n - p, 0)
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(-(-last // step))), lambda k: F.least(k * step, F.lit(last)).cast("int")))

    one = spark.range(1).select(F.explode(line(height)).alias("r0")).select("r0", F.explode(line(width)).alias("c0"))
    return one.select((F.col("r0").cast("long") * width + F.col("c0")).alias("patch_id"), "r0", "c0", F.lit(p).alias("size"))


def random_patches(spark: SparkSession, height: int, width: int, p: int, n: int, seed: int = 42) -> DataFrame:
    """n origins uniform in [0, height - p) x [0, width - p); they depend on seed and number only."""
    draw = lambda what, most: (uniform("id", F.lit(what), seed=seed) * max(most, 1)).cast("int")
    return spark.range(n).select(F.col("id").alias("patch_id"), draw("r", height - p).alias("r0"), draw("c", width - p).alias("c0"), F.lit(p).alias("size"))


def summed_masks(pixels: DataFrame, mask: str = "mask", tile: int = TILE) -> SummedArea:
    """Summed-area tables of cells, valid cells (0 or 1) and flooded cells (1)."""
    m = F.col(mask)
    return SummedArea(pixels.select("scene_id", "row", "col", mask), {"cells": F.lit(1), "valid": m.isin(0, 1).cast("int"), "flood": (m == 1).cast("int")}, tile)


def patch_ratios(tables: SummedArea, patches: DataFrame) -> DataFrame:
    """``(patch_id, valid_ratio, flood_ratio)`` of patches (patch_id, r0, c0, size) by four lookups each, as :func:`patch_stats` without extraction.

    Patches with a scene_id are of that scene, others of all scenes together; a patch without cells has no row.
    """
    boxes = patches.withColumns({"r1": F.col("r0") + F.col("size"), "c1": F.col("c0") + F.col("size")})
    per = tables.sums(boxes, "patch_id").groupBy("patch_id").agg(*[F.sum(c).alias(c) for c in ("cells", "valid", "flood")]).where("cells > 0")
    return per.select("patch_id", (F.col("valid") / F.col("cells")).alias("valid_ratio"), (F.col("flood") / F.col("cells")).alias("flood_ratio"))


def filter_patches(tables: SummedArea, patches: DataFrame, max_nodata: float = 0.5, min_flood: float = 0.0) -> DataFrame:
    """:func:`patch_ratios` of patches with at most ``max_nodata`` missing and at least ``min_flood`` flooded."""
    return patch_ratios(tables, patches).where((1 - F.col("valid_ratio") <= max_nodata) & (F.col("flood_ratio") >= min_flood))


def random_flood_patches(tables: SummedArea, height: int, width: int, p: int, n: int, seed: int = 42, quota: float = 0.5, min_flood: float = 0.05, max_nodata: float = 0.5, most: int | None = None) -> DataFrame:
    """The first ``n`` of :func:`random_patches`' endless draws with at most ``max_nodata`` missing, of which a part ``quota`` has ``min_flood`` flooded; with ratios.

    Draws are rejected by four lookups each. The first ``ceil(quota * n)`` flooded draws and the first others, flooded or not, are taken. Rounds
    double the draws until both are there or ``most`` (64 n, if not given) are drawn; fewer patches are returned then.
    """
    spark, wet = tables.sizes.sparkSession, -int(-quota * n // 1)
    most, draws = 64 * n if most is None else most, min(2 * n, 64 * n if most is None else most)
    while True:
        origins = random_patches(spark, height, width, p, draws, seed)
        good = snapshot(filter_patches(tables, origins, max_nodata).join(origins, "patch_id"), "draws")
        flooded = row_numbers(good.where(F.col("flood_ratio") >= min_flood).select("patch_id"), [], ["patch_id"], "k").where(F.col("k") <= wet).select("patch_id")
        flooded = snapshot(flooded, "flooded")
        others = row_numbers(good.join(flooded, "patch_id", "left_anti").select("patch_id"), [], ["patch_id"], "k").where(F.col("k") <= n - wet).select("patch_id")
        others = snapshot(others, "others")
        if draws >= most or (flooded.count() >= wet and others.count() >= n - wet):
            return good.join(flooded.unionByName(others), "patch_id", "left_semi").select("patch_id", "r0", "c0", "size", "valid_ratio", "flood_ratio")
        drop(good, flooded, others)
        draws = min(most, 2 * draws)


def block_split(df: DataFrame, block: int = 1024, every: int = 5) -> DataFrame:
    """Adds ``part``: ``val`` for every n-th spatial block, else ``train``, so that the two don't overlap."""
    number = F.floor(F.col("row") / block) * 7919 + F.floor(F.col("col") / block)
    return df.withColumn("part", F.when(F.pmod(number, F.lit(every)) == 0, "val").otherwise("train"))


def tile_grid(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")})


def patch_extract(pixels: DataFrame, patches: DataFrame, p: int) -> DataFrame:
    """Pixels of each patch (patch_id, r0, c0, size <= p) with local coordinates (pr, pc).

    A patch touches at most four p x p cells; pixels join on their cell, then the range is checked.
    """
    cells = F.flatten(F.transform(F.sequence(F.floor(F.col("r0") / p), F.floor((F.col("r0") + F.col("size") - 1) / p)), lambda r: F.transform(F.sequence(F.floor(F.col("c0") / p), F.floor((F.col("c0") + F.col("size") - 1) / p)), lambda c: F.struct(r.cast("int").alias("cell_r"), c.cast("int").alias("cell_c")))))
    spread = patches.select("*", F.explode(cells).alias("__x")).select(*patches.columns, "__x.*")
    keyed = pixels.withColumns({"cell_r": F.floor(F.col("row") / p).cast("int"), "cell_c": F.floor(F.col("col") / p).cast("int")})
    on = ["cell_r", "cell_c"] + (["scene_id"] if "scene_id" in patches.columns else [])
    met = keyed.join(spread, on).where("row >= r0 and row < r0 + size and col >= c0 and col < c0 + size")
    return met.withColumns({"pr": F.col("row") - F.col("r0"), "pc": F.col("col") - F.col("c0")}).drop("cell_r", "cell_c")


def overlap_average(preds: DataFrame, prob: str = "prob", key: tuple = ("scene_id", "row", "col")) -> DataFrame:
    """The mean of all patches' predictions for a pixel."""
    return preds.groupBy(*key).agg(F.avg(prob).alias(prob))


def stitch(preds: DataFrame, grid: DataFrame, prob: str = "prob") -> DataFrame:
    """The average on a whole grid; 0 where no patch reaches."""
    return grid.join(overlap_average(preds, prob), ["scene_id", "row", "col"], "left").withColumn(prob, F.coalesce(prob, F.lit(0.0)))


def patch_stats(patch_pixels: DataFrame, mask: str = "mask") -> DataFrame:
    """``(patch_id, valid_ratio, flood_ratio)``; 255 and NULL are no data."""
    m = F.col(mask)
    return patch_pixels.groupBy("patch_id").agg(F.avg(F.when(m.isin(0, 1), 1.0).otherwise(0.0)).alias("valid_ratio"), F.avg(F.when(m == 1, 1.0).otherwise(0.0)).alias("flood_ratio"))


def patch_filter(patch_pixels: DataFrame, mask: str = "mask", max_nodata: float = 0.5, min_flood: float = 0.0) -> DataFrame:
    """Patches with at most ``max_nodata`` missing and at least ``min_flood`` flooded."""
    return patch_stats(patch_pixels, mask).where((1 - F.col("valid_ratio") <= max_nodata) & (F.col("flood_ratio") >= min_flood))


def score_patches(patch_pixels: DataFrame, channels: list[str], fn: Callable[[np.ndarray], np.ndarray], size: int, logits: bool = True, batch: int | None = None) -> DataFrame:
    """``(patch_id, scene_id, row, col, prob)`` from a user's model ``fn``: array (channels, size, size) to array (size, size).

    With ``batch``, ``fn`` takes up to so many patches a call, (patches, channels, size, size) to (patches, size, size), and a task holds the
    patches of a few calls; else a patch is one group of size x size rows. Missing values are 0. ``logits`` go through the sigmoid.
    """
    ship(patch_pixels.sparkSession)
    most = batch or 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, ids = pd.factorize(pdf["patch_id"])
        r, c, prob = pdf["pr"].to_numpy(), pdf["pc"].to_numpy(), np.empty(len(pdf))
        values = [np.nan_to_num(pdf[name].to_numpy(np.float32, na_value=np.nan)) for name in channels]
        for first in range(0, len(ids), most):
            own = np.flatnonzero((number >= first) & (number < first + most))
            x = np.zeros((min(most, len(ids) - first), len(channels), size, size), np.float32)
            for i, v in enumerate(values):
                x[number[own] - first, i, r[own], c[own]] = v[own]
            y = np.asarray(fn(x) if batch else fn(x[0])[None], np.float64)
            prob[own] = y[number[own] - first, r[own], c[own]]
        return pdf[["patch_id", "scene_id", "row", "col"]].assign(prob=prob)

    kinds = "patch_id long, scene_id string, row int, col int, prob double"
    rows = patch_pixels.select(F.col("patch_id").cast("long"), "scene_id", "row", "col", "pr", "pc", *[F.col(c).cast("double") for c in channels])
    if batch:  # groups of about `batch` patches
        groups = max(1, -(-rows.select("patch_id").distinct().count() // batch))
        grouped = rows.groupBy(F.pmod(F.xxhash64("patch_id"), F.lit(groups)))
    else:
        grouped = rows.groupBy("patch_id")
    out = grouped.applyInPandas(run, kinds)
    return out.withColumn("prob", sigmoid("prob")) if logits else out
