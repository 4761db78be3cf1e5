"""Statistics, percentiles, histograms and the automatic threshold, per scene or any other group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.slices import percentile_row, percentile_rows, percentiles
from rasterjobs.runtime import snapshot


def channel_stats(df: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., channel, mean, std)``: mean and population deviation of the values that are there, all channels in one pass."""
    by = by or []
    wide = df.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in channels], *[F.stddev_pop(c).alias(f"s_{c}") for c in channels])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in channels]))
    return wide.select(*by, pairs.alias("x")).select(*by, "x.*")


def change_summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each column, as ``<column>_mean`` and so on."""
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return df.groupBy(*(by or [])).agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in kinds.items()])


def band_percentiles(df: DataFrame, x: str, ps: list[float], by: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """``(by..., p, value)``: linearly interpolated percentiles; with ``accuracy`` the bounded-memory approximation."""
    if accuracy is None:
        return percentiles(df, x, ps, by).drop("n")
    one = df.groupBy(*(by or [])).agg(F.percentile_approx(x, F.array(*[F.lit(p / 100) for p in ps]), accuracy).alias("v"))
    return one.select(*(by or []), F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in ps]).alias("p"), F.col("v").alias("value"))).alias("z")).select(*(by or []), "z.p", F.col("z.value").alias("value"))


def symmetric_limit(df: DataFrame, x: str, p: float = 98) -> DataFrame:
    """One row: the percentile of absolute values."""
    return percentile_row(df, F.abs(F.col(x)), {"limit": p})


def _binned(df: DataFrame, x: str, nbins: int, by: list[str]) -> DataFrame:
    """``(by..., lo, hi, bin, n)`` of the values that are there; the last bin is closed.

    The limits are one row per group, written once and joined back: Spark broadcasts them if that table is small.
    """
    df = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    limits = df.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    if by:
        df = df.join(snapshot(limits, "limits"), by)
    else:
        df = df.crossJoin(F.broadcast(limits))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * nbins)).otherwise(0)
    return df.groupBy(*by, "lo", "hi", F.least(at, F.lit(nbins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x: str, bins: int = 120, density: bool = True, by: list[str] | None = None) -> DataFrame:
    """``(by..., bin, left, n, value)``: every bin of equal width; ``value`` is the density or the count. Without values: no rows."""
    by = by or []
    found = _binned(df, x, bins, by)
    every = found.select(*by, "lo", "hi").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(found.drop("lo", "hi"), [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    width = (F.col("hi") - F.col("lo")) / bins
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])))
    value = F.try_divide(F.col("n"), total * width) if density else F.col("n").cast("double")
    return full.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n", value.alias("value"))


def otsu_threshold(df: DataFrame, x: str, nbins: int = 256, by: list[str] | None = None) -> DataFrame:
    """``(by..., bin, threshold)``: the centre of the first bin with the greatest variance between classes.

    A constant input gives that constant; no values give no row. Only bins reach the cumulative windows.
    """
    by = by or []
    h = _binned(df, x, nbins, by).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / nbins)
    group = Window.partitionBy(*(by or [F.lit(1)]))
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"w1": F.sum("n").over(upto), "m1": F.sum(F.col("n") * F.col("centre")).over(upto), "wt": F.sum("n").over(group), "mt": F.sum(F.col("n") * F.col("centre")).over(group)})
    gap = F.try_divide(F.col("m1"), F.col("w1")) - F.try_divide(F.col("mt") - F.col("m1"), F.col("wt") - F.col("w1"))
    # an empty last class (all values in one bin, or the last bin) has no variance and ranks behind the others
    between = F.when(F.col("w1") < F.col("wt"), F.col("w1") * (F.col("wt") - F.col("w1")) * gap * gap).otherwise(-1.0)
    best = h.withColumn("between", between).groupBy(*by).agg(F.max(F.struct("between", -F.col("bin"), "centre", "lo", "hi")).alias("b")).where("b is not null")
    return best.select(*by, (-F.col("b.col2")).cast("int").alias("bin"), F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).otherwise(F.col("b.centre")).alias("threshold"))


def percentile_stretch(df: DataFrame, x: str, lo: float = 2, hi: float = 98, out: str = "stretched") -> DataFrame:
    """``df`` with x stretched between two percentiles of its scene and cut to [0, 1]."""
    from rasterjobs.functions.algebra import stretch

    p = percentile_rows(df, x, {"__lo": lo, "__hi": hi}, ["scene_id"])
    return df.join(p, "scene_id", "left").withColumn(out, stretch(x, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def subsample_every(df: DataFrame, n: int, x: str) -> DataFrame:
    """Exactly every n-th valid value in row-major order, from the first.

    Rank = valid values in earlier rows (a window over one row per raster row) + rank inside the row.
    """
    valid = df.where(F.col(x).isNotNull())
    counts = valid.groupBy("scene_id", "row").agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("skip", F.sum("m").over(Window.partitionBy("scene_id").orderBy("row")) - F.col("m")).drop("m")
    inside = F.row_number().over(Window.partitionBy("scene_id", "row").orderBy("col"))
    return valid.withColumn("__k", inside - 1).join(before, ["scene_id", "row"]).where((F.col("skip") + F.col("__k")) % n == 0).drop("skip", "__k")


def subsample_grid(df: DataFrame, n: int, x: str, width: int) -> DataFrame:
    """The one-pass form for dense grids: valid pixels whose cell number is divisible by n."""
    return df.where(F.col(x).isNotNull()).where((F.col("row").cast("long") * width + F.col("col")) % n == 0)


def distribution_table(df: DataFrame, bands: list[str], bins: int = 120) -> DataFrame:
    """``(band, bin, left, n, value, threshold)``: density histogram and threshold of each band."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in bands])).alias("z")).select("z.*")
    return histogram(long_, "x", bins, by=["band"]).join(otsu_threshold(long_, "x", by=["band"]).drop("bin"), "band")
