"""The three workloads end to end, as plans over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.functions.algebra import basic_features, below_threshold_mask, calibrated, to_db
from rasterjobs.operators.accuracy import mask_area
from rasterjobs.operators.depth import depth_classes, flood_depth
from rasterjobs.operators.focal import lee_filters, open_close
from rasterjobs.operators.hist import channel_stats, otsu_threshold
from rasterjobs.operators.regions import sieve
from rasterjobs.schema import BANDS, FEATURES


def despeckled(df: DataFrame, size: int = 7, enl: float = 2.0, sizes: DataFrame | None = None) -> DataFrame:
    """The speckle filter on all four bands at once, on the same tiles."""
    return lee_filters(df, {b: b for b in BANDS}, size, enl, sizes)


def preprocess(dn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calibrate, despeckle, to features; and the statistics of the eight channels."""
    features = basic_features(despeckled(calibrated(dn)))
    return features, channel_stats(features, FEATURES)


def flood_by_threshold(dn: DataFrame, band: str = "during_hh") -> DataFrame:
    """``dn`` with ``db`` and ``mask``: calibrated band in dB below its automatic threshold; 255 where missing."""
    db = calibrated(dn).withColumn("db", to_db(band))
    cut = otsu_threshold(db, "db").select(F.col("threshold").alias("__t"))
    return db.crossJoin(F.broadcast(cut)).withColumn("mask", below_threshold_mask("db", F.col("__t"))).drop("__t")  # one row


def otsu_flood_area(dn: DataFrame, pixel_m: float = 18.0) -> DataFrame:
    return mask_area(flood_by_threshold(dn), "mask", pixel_m)


def cleaned(masked: DataFrame, min_px: int = 25) -> DataFrame:
    return sieve(open_close(masked), min_px)


def depth_of(masked: DataFrame, dem: str = "z") -> DataFrame:
    return depth_classes(flood_depth(masked, dem))
