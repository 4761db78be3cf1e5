"""Exact ranks of large groups: rows are dealt into sorted ranges, and only ranges meet in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.skew import HOT_KEYS
from rasterjobs.runtime import drop, snapshot


#: Up to so many rows make one range, which needs no sample for bounds.
ONE_RANGE = 50_000


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with ``__range``, the number of a row's range in ``order``; equal rows share one.

    It is written once, as another run could draw other bounds.
    """
    whole = snapshot(df, "rows")
    if whole.limit(ONE_RANGE + 1).count() <= ONE_RANGE:
        out = whole.withColumn("__range", F.lit(0))
        out._one_range = True
        return out
    placed = snapshot(whole.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    drop(whole)
    return placed


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def with_ranges(placed: DataFrame, by: list[str], total: Column) -> DataFrame:
    """``placed`` with ``__before`` and ``__all``: ``total`` (a sum) over a group's earlier ranges, and over all of them."""
    if getattr(placed, "_one_range", False):  # nothing comes before it
        group = Window.partitionBy(*(by or [F.lit(1)]))
        out = placed.withColumn("__all", total.over(group)).withColumn("__before", F.col("__all") - F.col("__all"))
        out._one_range = True
        return out
    sums = placed.groupBy(*by, "__range").agg(total.alias("__n"))
    group = Window.partitionBy(*(by or [F.lit(1)]))  # a row per range
    sums = sums.withColumns({"__before": F.sum("__n").over(group.orderBy("__range")) - F.col("__n"), "__all": F.sum("__n").over(group)}).drop("__n")
    keys = [*by, "__range"]
    sums = sums.withColumnsRenamed({c: f"__{c}" for c in keys})
    if by:
        sums = snapshot(sums, "sums")
    if not by or sums.limit(HOT_KEYS + 1).count() <= HOT_KEYS:  # without groups a row per range
        sums = F.broadcast(sums)  # or Spark, which can't tell how few they are, exchanges all rows
    return placed.join(sums, _same(placed, sums, keys)).drop(*[f"__{c}" for c in keys])


def row_numbers(df: DataFrame, by: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in ``order`` within each group ``by``, however large a group is."""
    placed = in_ranges(df, [*by, *order])
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    ranked = with_ranges(placed, by, F.count(F.lit(1))).withColumn(out, (F.col("__before") + inside).cast("long"))
    return ranked.drop("__range", "__before", "__all")
