"""Scalar map algebra on pixel rows: one pass each, no shuffle, NULL for missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterjobs.schema import CAL_CONST, FEATURES, KEY, NOISE_BIAS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def calibrate(dn, noise_bias, cal_const=CAL_CONST) -> Column:
    """Backscatter ``(DN^2 - bias) / 10^(cal/10)``; NULL for DN 0 and for results that aren't positive."""
    dn = _c(dn).cast("double")
    bias, cal = (x if isinstance(x, Column) else F.lit(float(x)) for x in (noise_bias, cal_const))
    value = (dn * dn - bias) / F.pow(F.lit(10.0), cal / 10)
    return F.when((dn != 0) & (value > 0), value)


def calibration_table(spark) -> DataFrame:
    rows = [(d, p, b, CAL_CONST) for (d, p), b in NOISE_BIAS.items()]
    return spark.createDataFrame(rows, "date_key string, pol string, noise_bias double, cal_const double")


def calibrate_long(df: DataFrame, table: DataFrame, dn: str = "dn") -> DataFrame:
    """Long form (date_key, pol, dn): constants come from ``table``, a few rows per scene date."""
    return df.join(F.broadcast(table), ["date_key", "pol"]).withColumn("sigma", calibrate(dn, F.col("noise_bias"), F.col("cal_const"))).drop("noise_bias", "cal_const")


def to_db(x) -> Column:
    """``10 log10(x)``; NULL unless x is finite and positive."""
    x = _c(x)
    return F.when((x > 0) & (x < float("inf")), 10 * F.log10(x))  # NaN is greater than infinity


def cross_pol_ratio(hh, hv) -> Column:
    return F.try_divide(_c(hh), _c(hv))


def rfdi(hh, hv) -> Column:
    return F.try_divide(_c(hh) - _c(hv), _c(hh) + _c(hv))


def change(after, before) -> Column:
    return _c(after) - _c(before)


def combined_change(delta_hh="delta_hh", delta_hv="delta_hv") -> Column:
    return _c(delta_hh) + _c(delta_hv)


def calibrated(df: DataFrame) -> DataFrame:
    """The four bands of digital numbers become linear backscatter under the same names."""
    bands = {f"{d}_{p.lower()}": calibrate(f"{d}_{p.lower()}", b) for (d, p), b in NOISE_BIAS.items()}
    return df.withColumns(bands)


def basic_features(df: DataFrame) -> DataFrame:
    """From linear backscatter: four bands in dB, two ratios, two RFDI, three changes; other columns stay."""
    df = df.withColumns({f"{b}_db": to_db(b) for b in ("before_hh", "before_hv", "during_hh", "during_hv")})
    df = df.withColumns({f"{d}_cr": cross_pol_ratio(f"{d}_hh", f"{d}_hv") for d in ("before", "during")} | {f"{d}_rfdi": rfdi(f"{d}_hh", f"{d}_hv") for d in ("before", "during")})
    return df.withColumns({"delta_hh": change("during_hh_db", "before_hh_db"), "delta_hv": change("during_hv_db", "before_hv_db"), "delta_cr": change("during_cr", "before_cr")})


def feature_stack(df: DataFrame, channels: list[str] = FEATURES) -> DataFrame:
    return df.select(*KEY, *channels)


def zscore(x, mean, std) -> Column:
    """``(x - mean) / (std + 1e-6)`` with missing as 0."""
    return (F.coalesce(_c(x), F.lit(0.0)) - _c(mean)) / (_c(std) + 1e-6)


def threshold_mask(prob, t: float = 0.5, strict: bool = False) -> Column:
    """1 where prob >= t (or > t if strict), else 0; NULL stays NULL."""
    p = _c(prob)
    return ((p > t) if strict else (p >= t)).cast("int")


def below_threshold_mask(x, t, nodata: int | None = 255) -> Column:
    """1 where x < t, 0 otherwise, ``nodata`` where x is missing."""
    x, t = _c(x), t if isinstance(t, Column) else F.lit(t)
    return F.when(x.isNull(), F.lit(nodata).cast("int")).when(x < t, 1).otherwise(0)


def valid_only(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose ``cols`` are all finite."""
    for c in cols:
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))  # false for NaN, NULL for NULL
    return df


def stretch(x, lo, hi) -> Column:
    """``(x - lo) / (hi - lo + 1e-8)`` cut to [0, 1]; NULL stays NULL."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    y = (x - lo) / (hi - lo + 1e-8)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), y)))


def pixel_to_world(row, col, x0, dx, y0, dy, centre: bool = False) -> tuple[Column, Column]:
    shift = 0.5 if centre else 0.0
    return _c(x0) + (_c(col) + shift) * _c(dx), _c(y0) + (_c(row) + shift) * _c(dy)


def classify_bins(x, bounds: list[float], outside: int = 0) -> Column:
    """Class i for bounds[i - 1] <= x < bounds[i], i from 1; ``outside`` for NULL and other values."""
    x, out = _c(x), F.lit(outside)
    for i in range(len(bounds) - 1, 0, -1):
        out = F.when((x >= bounds[i - 1]) & (x < bounds[i]), i).otherwise(out)
    return out.cast("int")


#: Fixed value: the overlay colour of a flooded pixel, red, green, blue, alpha.
FLOOD_RGBA = (0, 112, 255, 180)


def overlay_rgba(mask, rgba: tuple = FLOOD_RGBA) -> Column:
    """``array<int>`` of four channels: ``rgba`` where mask is 1, else transparent."""
    return F.when(_c(mask) == 1, F.array(*[F.lit(v) for v in rgba])).otherwise(F.array(*[F.lit(0)] * 4))


def hex_rgb(colour) -> Column:
    """``#RRGGBB`` as ``array<int>``."""
    return F.array(*[F.conv(F.substring(_c(colour), i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def augment_geom(df: DataFrame, op: str, size: int) -> DataFrame:
    """Patch pixels (pr, pc) flipped (``hflip``, ``vflip``) or turned counter-clockwise (``rot90``, ``rot180``, ``rot270``)."""
    pr, pc, last = F.col("pr"), F.col("pc"), size - 1
    moved = {"hflip": (pr, last - pc), "vflip": (last - pr, pc), "rot90": (last - pc, pr), "rot180": (last - pr, last - pc), "rot270": (pc, last - pr)}[op]
    return df.withColumns({"pr": moved[0].cast("int"), "pc": moved[1].cast("int")})


def uniform(*keys, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on keys and seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *[_c(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)


def random_geom(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Each patch is flipped, turned or left as it is by a draw that depends on seed and patch_id."""
    u = (uniform("patch_id", seed=seed) * 6).cast("int")
    pr, pc, last = F.col("pr"), F.col("pc"), size - 1
    row = F.when(u == 1, pr).when(u == 2, last - pr).when(u == 3, last - pc).when(u == 4, last - pr).when(u == 5, pc).otherwise(pr)
    col = F.when(u == 1, last - pc).when(u == 2, pc).when(u == 3, pr).when(u == 4, last - pc).when(u == 5, last - pr).otherwise(pc)
    return df.withColumns({"pr": row.cast("int"), "pc": col.cast("int")})


def augment_speckle(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """Half of the patches: values times ``1 + N(0, 1) * sigma``, sigma uniform in (0.02, 0.08) per patch."""
    on = uniform("patch_id", F.lit("on"), seed=seed) < 0.5
    sigma = 0.02 + 0.06 * uniform("patch_id", F.lit("sigma"), seed=seed)
    # Box and Muller's normal from two uniform draws: unlike randn() it doesn't depend on partitions
    normal = {c: F.sqrt(-2 * F.log(1 - uniform("patch_id", "pr", "pc", F.lit(c), seed=seed))) * F.cos(2 * math.pi * uniform("patch_id", "pr", "pc", F.lit(c + "'"), seed=seed)) for c in columns}
    return df.withColumns({c: F.when(on, F.col(c) * (1 + normal[c] * sigma)).otherwise(F.col(c)) for c in columns})


def augment_jitter(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """Half of the patches: a shift uniform in (-1, 1) per patch and channel."""
    on = uniform("patch_id", F.lit("jitter"), seed=seed) < 0.5
    return df.withColumns({c: F.when(on, F.col(c) + 2 * uniform("patch_id", F.lit(c), seed=seed) - 1).otherwise(F.col(c)) for c in columns})


def sigmoid(logit) -> Column:
    return 1 / (1 + F.exp(-_c(logit)))
