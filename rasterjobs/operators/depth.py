"""Water level and depth per flooded region, depth classes and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.functions.algebra import classify_bins
from rasterjobs.operators.focal import gaussian_smooth
from rasterjobs.operators.slices import percentile_row, percentiles
from rasterjobs.operators.regions import connected_regions
from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import snapshot

#: Bounds of the depth classes in metres; class i is [bounds[i - 1], bounds[i]).
DEPTH_BOUNDS = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 9999.0]


def depth_labels() -> list[str]:
    return [f"{a:g}-{b:g} m" if b < 9999 else f"> {a:g} m" for a, b in zip(DEPTH_BOUNDS, DEPTH_BOUNDS[1:], strict=False)]


def zonal_percentile(df: DataFrame, x: str, p: float = 0.9, min_px: int = 5, digits: int | None = None, out: str = "wse") -> DataFrame:
    """``(scene_id, region_id, n_px, wse)``: an interpolated percentile per region of at least ``min_px`` pixels.

    A region may hold most pixels: it is ranked in ranges. ``digits`` rounds values first, so that more are equal.
    """
    value = F.col(x) if digits is None else F.round(x, digits)
    found = percentiles(df, value, [100 * p], ["scene_id", "region_id"])
    return found.where(F.col("n") >= min_px).select("scene_id", "region_id", F.col("n").alias("n_px"), F.col("value").alias(out))


def flood_depth(df: DataFrame, dem: str = "z", mask: str = "mask", sigma: float = 3.0, p: float = 0.9, min_px: int = 5) -> DataFrame:
    """``df`` (dense grid) with ``depth``: the region's water level less the smoothed ground, at least 0; NULL outside the mask.

    Regions below ``min_px`` pixels have depth 0.
    """
    df = snapshot(df, "grid")  # sizes, tiles and the result read it
    smooth = gaussian_smooth(df, dem, sigma, "__z").where(F.col(mask) == 1).select("scene_id", "row", "col", mask, "__z")
    regions = snapshot(connected_regions(snapshot(smooth, "smooth"), mask), "regions")  # both are read several times
    level = snapshot(zonal_percentile(regions, "__z", p, min_px), "levels")
    deep = salted_join(regions, level, ["scene_id", "region_id"], "n_px", ["row", "col"], "left", small=True).select("scene_id", "row", "col", F.coalesce(F.greatest(F.col("wse") - F.col("__z"), F.lit(0.0)), F.lit(0.0)).alias("depth"))
    return df.join(deep, ["scene_id", "row", "col"], "left")


def depth_classes(df: DataFrame, depth: str = "depth", out: str = "depth_class") -> DataFrame:
    return df.withColumn(out, classify_bins(depth, DEPTH_BOUNDS))


def depth_class_stats(df: DataFrame, pixel_m: float = 18.0, cls: str = "depth_class") -> DataFrame:
    """``(class, label, pixels, area_ha, pct)`` of all 14 classes, empty ones as well; percent of flooded pixels."""
    spark = df.sparkSession
    labels = spark.createDataFrame(list(enumerate(depth_labels(), 1)), "class int, label string")
    counts = df.where(F.col(cls) > 0).groupBy(F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("pixels"))
    out = labels.join(counts, "class", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))
    total = counts.agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("__t"))
    return out.crossJoin(F.broadcast(total)).select("class", "label", "pixels", (F.col("pixels") * pixel_m * pixel_m / 10000).alias("area_ha"), F.coalesce(F.try_divide(F.col("pixels") * 100.0, F.col("__t")), F.lit(0.0)).alias("pct"))  # one row


def depth_summary(df: DataFrame, depth: str = "depth") -> DataFrame:
    d = F.col(depth)
    df = snapshot(df.select(depth).where(d.isNotNull()), "depth")  # read twice
    rest = df.agg(F.min(d).alias("min_depth"), F.avg(d).alias("mean_depth"), F.max(d).alias("max_depth"))
    return rest.crossJoin(F.broadcast(percentile_row(df, depth, {"median_depth": 50}))).select("min_depth", "mean_depth", "median_depth", "max_depth")  # one row each
