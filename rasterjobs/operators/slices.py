"""Exact selection by bit slices: ranks of large groups are found by counting 16 bits of order-preserving keys at a time.

A pass counts only the buckets that hold a wanted rank, and exchanges counts, at most 65,536 for each of them and task; values
stay where they are. After the first pass a range of values keeps all other rows in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterjobs.operators.skew import HOT_KEYS
from rasterjobs.runtime import drop, ship, snapshot

#: A group of at most so many values takes one aggregate, and a bucket of at most so many is counted value by value.
LARGE = 100_000
_ALL = np.int64((1 << 63) - 1)


def keys_of(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of doubles; NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x).astype(np.float64).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ _ALL)


def values_of(keys: np.ndarray) -> np.ndarray:
    """The doubles of :func:`keys_of`."""
    return np.where(keys >= 0, keys, keys ^ _ALL).view(np.float64)


def _bucketed(rows: DataFrame, shift: int) -> DataFrame:
    """``rows`` with ``bucket``: the bits of x's key from ``shift`` up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = keys_of(batch.column("x").to_numpy(zero_copy_only=False)) >> np.int64(shift)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(bucket)], ["g", "bucket"])

    return rows.select("g", "x").mapInArrow(add, T.StructType([rows.schema["g"], T.StructField("bucket", T.LongType())]))


def _with_bounds(hit: DataFrame, shift: int) -> DataFrame:
    """``hit`` (g, k, below, bucket, n) with the least and greatest value of its bucket."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("bucket").to_numpy() << np.int64(shift)
            lo, hi = values_of(first), values_of(first | np.int64((1 << shift) - 1))
            lo = np.where((first < 0) & np.isnan(lo), -np.inf, lo)  # keys before that of -inf belong to no value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo), pa.array(hi)], [*batch.schema.names, "lo", "hi"])

    return hit.mapInArrow(bounds, T.StructType([*hit.schema.fields, T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))


def _inside(rows: DataFrame, now: DataFrame) -> DataFrame:
    """``rows`` in the buckets of ``now``, with the bucket as ``prefix``; the buckets are broadcast up to HOT_KEYS of them."""
    buckets = now.select("g", F.col("bucket").alias("prefix"), "lo", "hi").distinct()
    met = rows.join(F.broadcast(buckets) if now.count() <= HOT_KEYS else buckets, "g")
    return met.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select("g", "x", "prefix")


def _covering(counts: DataFrame, wanted: DataFrame, place: str) -> DataFrame:
    """For ranks ``wanted`` (g, k, prefix, below): the ``place`` whose count ``n`` covers rank k, and the values below it."""
    before = Window.partitionBy("g", "prefix").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    met = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(wanted, ["g", "prefix"])
    first = F.col("below") + F.col("__before")
    return met.where((first <= F.col("k")) & (F.col("k") < first + F.col("n"))).select("g", "k", first.alias("below"), place, "n")


def select_ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(g, k, value)``: the k-th least (from 0) of the values ``x`` of ``rows`` (g, x) in groups ``wanted`` (g, k).

    Both should be snapshots, and ranks must exist. At most four passes; buckets of at most LARGE rows end them.
    """
    zero = F.lit(0).cast("long")
    now = wanted.select("g", "k", zero.alias("bucket"), zero.alias("below"))
    for shift in (48, 32, 16, 0):
        if shift == 48:
            rest = rows.join(F.broadcast(wanted.select("g").distinct()) if wanted.count() <= HOT_KEYS else wanted.select("g").distinct(), "g", "left_semi")
            counts = _bucketed(rest, shift).groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", zero)
        else:
            counts = _bucketed(_inside(rows, now), shift).groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", F.shiftright("bucket", 16))
        hit = snapshot(_covering(counts, now.select("g", "k", F.col("bucket").alias("prefix"), "below"), "bucket"), "slices")
        drop(now)
        now = snapshot(_with_bounds(hit, shift), "buckets")
        drop(hit)
        if not now.where(F.col("n") > LARGE).limit(1).count():
            break
    if shift == 0:
        return now.select("g", "k", F.col("lo").alias("value"))
    counts = _inside(rows, now).groupBy("g", "prefix", "x").agg(F.count(F.lit(1)).alias("n"))
    return _covering(counts, now.select("g", "k", F.col("bucket").alias("prefix"), "below"), "x").select("g", "k", F.col("x").alias("value"))


def percentiles(df: DataFrame, x: str | Column, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """``(by..., p, value, n)``: linearly interpolated percentiles (0 to 100) of the ``n`` values that are there.

    Groups of at most LARGE values take one aggregate, larger ones :func:`select_ranks`. A group without values has no row;
    a null in ``by`` is a group like others; NaN counts as the greatest value.
    """
    ship(df.sparkSession)
    by = by or []
    x = F.col(x) if isinstance(x, str) else x
    g = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = snapshot(df.select(g.alias("g"), (x.cast("double") + 0.0).alias("x")).where("x is not null"), "values")
    sizes = snapshot(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > LARGE)
    some, plain = large.count(), rows
    if some:
        plain = rows.join(F.broadcast(large) if some <= HOT_KEYS else large, "g", "left_anti")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ps)])
    found = plain.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p / 100) for p in ps])).alias("v"), F.count(F.lit(1)).alias("n"))
    out = found.select("g", "n", F.posexplode("v").alias("i", "value")).select("g", F.get(wanted, F.col("i"))["p"].alias("p"), "value", "n")
    if some:
        at = F.col("p") / 100 * (F.col("n") - 1)
        ranks = snapshot(large.select("g", "n", F.explode(wanted).alias("w")).select("g", "n", F.col("w.p").alias("p")).withColumn("at", at), "ranks")
        asked = snapshot(ranks.select("g", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k")).distinct(), "asked")
        found = snapshot(select_ranks(rows, asked), "found")
        low = found.select("g", F.col("k").alias("low"), F.col("value").alias("lo"))
        high = found.select("g", F.col("k").alias("high"), F.col("value").alias("hi"))
        met = ranks.withColumns({"low": F.floor("at"), "high": F.ceil("at")}).join(low, ["g", "low"]).join(high, ["g", "high"])
        part = F.col("at") - F.col("low")
        out = out.unionByName(met.select("g", "p", F.when(part == 0, F.col("lo")).otherwise((1 - part) * F.col("lo") + part * F.col("hi")).alias("value"), "n"))
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "p", "value", "n")


def percentile_row(df: DataFrame, x: str | Column, names: dict[str, float]) -> DataFrame:
    """One row with a column for each of ``names`` (name: percentile), NULL without values."""
    found = percentiles(df, x, list(names.values()))
    return found.agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(c) for c, p in names.items()])


def percentile_rows(df: DataFrame, x: str | Column, names: dict[str, float], by: list[str]) -> DataFrame:
    """A row per group ``by`` with a column for each of ``names``; written once, so that a small table is broadcast by its size."""
    found = percentiles(df, x, list(names.values()), by)
    return snapshot(found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(c) for c, p in names.items()]), "percentiles")
