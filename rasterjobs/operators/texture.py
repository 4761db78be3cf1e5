"""Co-occurrence texture per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.slices import percentile_rows


def quantise(df: DataFrame, x: str, levels: int = 64, lo: float = 2, hi: float = 98, out: str = "q") -> DataFrame:
    """Levels 0 .. levels - 1 between two percentiles of the scene, cut first and floored after."""
    p = percentile_rows(df, x, {"__lo": lo, "__hi": hi}, ["scene_id"])
    share = F.try_divide(F.col(x) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (levels - 1))
    return df.join(p, "scene_id", "left").withColumn(out, F.when(F.col(x).isNotNull(), F.coalesce(level, F.lit(0)).cast("int"))).drop("__lo", "__hi")


def glcm_texture(df: DataFrame, q: str = "q", tile: int = 256, least: int = 4) -> DataFrame:
    """``(scene_id, tile_r, tile_c, contrast, correlation, energy, homogeneity)``: symmetric pairs at distance 1 along rows.

    Pairs don't cross tiles and need both cells; tiles of fewer than ``least`` cells have no row. Energy is the
    root of the summed squares; the correlation of a constant tile is 1.
    """
    t = df.select("scene_id", "row", "col", q).withColumns({"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")})
    key = ["scene_id", "tile_r", "tile_c"]
    side = t.groupBy(*key).agg((F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w")).where(f"h * w >= {least}")
    order = Window.partitionBy(*key, "row").orderBy("col")
    pairs = t.withColumns({"j": F.lead(q).over(order), "next": F.lead("col").over(order)}).where(f"{q} is not null and j is not null and next = col + 1")
    counts = pairs.groupBy(*key, F.col(q).alias("i"), "j").agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(*key, "i", "j").agg(F.sum("n").alias("n"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    sums = both.groupBy(*key).agg(F.sum("n").alias("N"), F.sum(n * (i - j) * (i - j)).alias("d2"), F.sum(n * i).alias("si"), F.sum(n * i * i).alias("sii"), F.sum(n * i * j).alias("sij"), F.sum(n * n).alias("sq"), F.sum(n / (1 + (i - j) * (i - j))).alias("hom"))
    N = F.col("N")
    mean = F.col("si") / N
    var = F.col("sii") / N - mean * mean
    cov = F.col("sij") / N - mean * mean
    out = sums.join(side, key, "left_semi")
    return out.select(*key, (F.col("d2") / N).alias("contrast"), F.when(var < 1e-12, 1.0).otherwise(cov / var).alias("correlation"), (F.sqrt(F.col("sq").cast("double")) / N).alias("energy"), (F.col("hom") / N).alias("homogeneity"))


def texture_map(df: DataFrame, q: str = "q", tile: int = 256) -> DataFrame:
    """Each pixel with its tile's texture."""
    tiled = df.withColumns({"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")})
    return tiled.join(glcm_texture(df, q, tile), ["scene_id", "tile_r", "tile_c"], "left")
