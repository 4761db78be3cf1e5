"""Four-connected regions: cells are labelled inside tiles, whose labels merge up a quadtree; outlines, sizes, sieve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterjobs.functions.algebra import threshold_mask
from rasterjobs.operators.focal import open_close
from rasterjobs.runtime import drop, ship, snapshot

#: Cells of a scene are numbered row * STRIDE + col: a region's id is its first cell in raster order.
STRIDE = 1 << 31
#: Side of the tiles that are labelled in one task each.
TILE = 256


def first_cells(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell the number of the first cell, in raster order, of its component among these cells."""
    order = np.lexsort((col, row))
    r, c = row[order], col[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] - c[:-1] > 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(r)) - 1
    width = int(c.max() - c.min()) + 2
    head = (r[at] - r.min()) * width + c[at] - c.min()  # runs of cells by first and last place
    tail = head + c[last] - c[at]
    low = np.searchsorted(tail, head + width, "left")
    n = np.maximum(0, np.searchsorted(head, tail + width, "right") - low)  # runs of the next row that touch
    a = np.repeat(np.arange(len(at)), n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(at))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    out = np.empty(len(r), np.int64)
    out[order] = (r[at] * STRIDE + c[at])[label][np.cumsum(new) - 1]
    return out


def _labelled(df: DataFrame, mask: str, tile: int, every: bool = False) -> DataFrame:
    """The cells that are 1 with ``__label``, the first cell of their component inside their tile; with ``every`` the other cells too, without a label."""
    ship(df.sparkSession)
    placed = df.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    one = F.coalesce(F.col(mask) == 1, F.lit(False))
    rows = placed.withColumn("__one", one) if every else placed.where(one)

    def label(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        on = table.column("__one").to_numpy(zero_copy_only=False) if every else np.ones(len(row), bool)
        found = np.zeros(len(row), np.int64)
        if on.any():
            found[on] = first_cells(row[on], col[on])
        return table.select(names).append_column("__label", pa.array(found, mask=~on))

    names = df.columns
    tiled = rows.withColumns({"__r": F.floor(F.col("row") / tile), "__c": F.floor(F.col("col") / tile)})
    kinds = T.StructType([*df.schema.fields, T.StructField("__label", T.LongType())])
    return tiled.groupBy("scene_id", "__r", "__c").applyInArrow(label, kinds)


def join_labels(row: np.ndarray, col: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct labels, the least label of each one's component) where cells that touch join their labels."""
    place, at = np.unique(row * STRIDE + col, return_index=True)
    labels, own = np.unique(label[at], return_inverse=True)
    a, b = [], []
    for step in (1, STRIDE):
        there = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        met = place[there] == place + step
        a.append(own[met])
        b.append(own[there[met]])
    a, b = np.concatenate(a), np.concatenate(b)
    low = np.arange(len(labels))
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
    return labels, labels[low]


def region_names(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``(scene_id, __label, __first)`` of the labels of tiles whose region begins in another tile.

    Tiles merge by fours, bottom-up: a node sees the border cells of its four parts, joins their labels and keeps only the
    cells on its own outer border, so the largest group is a scene's perimeter. Rounds are the tree's height, the
    logarithm of a scene's side in tiles; the names given on the way up are resolved on the way down, by joins of labels.
    """
    spark = cells.sparkSession
    node = lambda axis, base, k: F.floor((F.floor(F.col(axis) / tile) - base) / (1 << k)).cast("long")
    edge = lambda axis, base, k: F.pmod(F.col(axis) - base * tile, F.lit(tile << k)).isin(0, (tile << k) - 1)
    tiles = cells.agg(*[f(F.floor(F.col(axis) / tile)).alias(f"{name}_{axis}") for axis in ("row", "col") for name, f in (("low", F.min), ("high", F.max))]).first()
    kinds = T.StructType([cells.schema["scene_id"], *[T.StructField(c, T.LongType()) for c in ("label", "name", "row", "col")]])
    if tiles["low_row"] is None:
        return spark.createDataFrame([], T.StructType([kinds[0], T.StructField("__label", T.LongType()), T.StructField("__first", T.LongType())]))
    base = {axis: int(tiles[f"low_{axis}"]) for axis in ("row", "col")}
    height = max(int(tiles[f"high_{axis}"]) - base[axis] for axis in ("row", "col")).bit_length()
    outer = lambda df, k: df.where(edge("row", base["row"], k) | edge("col", base["col"], k))

    def merge(table: pa.Table) -> pa.Table:
        row, col, label = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "name"))
        labels, least = join_labels(row, col, label)
        changed = labels != least
        new, none = least[np.searchsorted(labels, label)], np.full(int(changed.sum()), -1)
        scene = pa.array([table.column("scene_id")[0].as_py()], kinds_arrow).take(pa.array(np.zeros(len(none) + len(row), np.int64)))
        cell = np.concatenate([np.zeros(len(none), bool), np.ones(len(row), bool)])
        parts = ((labels[changed], new), (least[changed], new), (none, row), (none, col))
        values = [np.concatenate(p) for p in parts]
        return pa.table([scene, pa.array(values[0]), pa.array(values[1]), pa.array(values[2], mask=~cell), pa.array(values[3], mask=~cell)], ["scene_id", "label", "name", "row", "col"])

    kinds_arrow = to_arrow_type(kinds[0].dataType)
    border = outer(cells.where("__label is not null"), 0).select("scene_id", F.col("row").cast("long"), F.col("col").cast("long"), F.col("__label").alias("name"))
    levels, made = [], []
    for k in range(1, height + 1):
        nodes = border.withColumns({"__r": node("row", base["row"], k), "__c": node("col", base["col"], k)})
        made.append(snapshot(nodes.groupBy("scene_id", "__r", "__c").applyInArrow(merge, kinds), "merged"))
        levels.append(made[-1].where("row is null").select("scene_id", "label", "name"))
        border = outer(made[-1].where("row is not null"), k).select("scene_id", "row", "col", "name")
    names = spark.createDataFrame([], T.StructType([kinds[0], kinds[1], kinds[2]]))
    for lower in reversed(levels):
        upper = names.select("scene_id", F.col("label").alias("name"), F.col("name").alias("__up"))
        names = names.unionByName(lower.join(upper, ["scene_id", "name"], "left").select("scene_id", "label", F.coalesce("__up", "name").alias("name")))
    out = snapshot(names.select("scene_id", F.col("label").alias("__label"), F.col("name").alias("__first")), "names")
    drop(*made)
    return out


def _named(cells: DataFrame, tile: int) -> DataFrame:
    """``cells`` with ``region_id`` in place of ``__label``. A label has at most a tile's cells, so no key is hot."""
    found = cells.join(region_names(cells, tile), ["scene_id", "__label"], "left")
    return found.withColumn("region_id", F.coalesce("__first", "__label")).drop("__first", "__label")


def connected_regions(df: DataFrame, mask: str = "mask", dense: bool = False, tile: int = TILE) -> DataFrame:
    """The cells that are 1, with ``region_id``: the first cell of the region in raster order as row * 2^31 + col.

    ``dense`` numbers the regions of each scene 1, 2, ... in that order instead.
    """
    found = _named(snapshot(_labelled(df, mask, tile), "cells"), tile)
    if dense:
        ids = found.select("scene_id", "region_id").distinct()
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("scene_id").orderBy("region_id")).cast("long"))
        found = found.join(ids, ["scene_id", "region_id"]).drop("region_id").withColumnRenamed("n", "region_id")
    return found.select(*df.columns, "region_id")


def region_sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("scene_id", "region_id").agg(F.count(F.lit(1)).alias("n_px"))


def largest_regions(regions: DataFrame, k: int) -> DataFrame:
    return region_sizes(regions).orderBy(F.desc("n_px"), "scene_id", "region_id").limit(k)


def region_join(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """A region's values on its pixels; adaptive execution broadcasts a small region table by its measured size."""
    return pixels.join(values, ["scene_id", "region_id"], "left")


def sieve(df: DataFrame, min_px: int = 25, mask: str = "mask", tile: int = TILE) -> DataFrame:
    """``df`` with regions of fewer than ``min_px`` cells set to 0.

    Labels and their cells are counted in the tile pass, which carries the other columns along: pixels meet only the table of kept labels.
    Rows without a place are left out.
    """
    cells = snapshot(_labelled(df, mask, tile, every=True), "cells")
    labels = cells.where("__label is not null").groupBy("scene_id", "__label").agg(F.count(F.lit(1)).alias("n"))
    sized = labels.join(region_names(cells, tile), ["scene_id", "__label"], "left").withColumn("region_id", F.coalesce("__first", "__label"))
    sized = snapshot(sized.select("scene_id", "__label", "region_id", "n"), "labels")
    large = sized.groupBy("scene_id", "region_id").agg(F.sum("n").alias("n_px")).where(F.col("n_px") >= min_px)
    kept = sized.join(large, ["scene_id", "region_id"]).select("scene_id", "__label", F.lit(1).alias("__keep"))
    return cells.join(kept, ["scene_id", "__label"], "left").withColumn(mask, F.coalesce("__keep", F.lit(0))).select(*df.columns)


def postprocess(df: DataFrame, prob: str = "prob", t: float = 0.5, min_px: int = 25, open_size: int = 3, close_size: int = 5) -> DataFrame:
    """Threshold, open, close, drop small regions; adds ``mask``."""
    return sieve(open_close(df.withColumn("mask", threshold_mask(prob, t)), open_size, close_size), min_px)


def _sides(regions: DataFrame) -> DataFrame:
    """``regions`` with ``top``, ``left``, ``bottom`` and ``right``: whether the cell beside is no region's. Two windows, by row and by column."""
    across, down = Window.partitionBy("scene_id", "row").orderBy("col"), Window.partitionBy("scene_id", "col").orderBy("row")
    free = lambda f, axis, step, over: ~F.coalesce(f(axis).over(over) == F.col(axis) + step, F.lit(False))
    cells = regions.select("scene_id", "region_id", "row", "col").withColumns({"left": free(F.lag, "col", -1, across), "right": free(F.lead, "col", 1, across)})
    return cells.withColumns({"top": free(F.lag, "row", -1, down), "bottom": free(F.lead, "row", 1, down)})


def polygon_stats(regions: DataFrame, pixel_m: float = 18.0) -> DataFrame:
    """``(scene_id, region_id, n_px, area_m2, perimeter_m)``."""
    open_ = sum((F.col(side).cast("int") for side in ("left", "bottom", "right")), F.col("top").cast("int"))
    out = _sides(regions).groupBy("scene_id", "region_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum(open_).alias("n_edges"))
    return out.select("scene_id", "region_id", "n_px", (F.col("n_px") * pixel_m * pixel_m).alias("area_m2"), (F.col("n_edges") * pixel_m).alias("perimeter_m"))


def ring_table(polygons: DataFrame) -> DataFrame:
    """``polygons`` with ``n_rings``, ``area`` (outline less holes) and ``length`` from the corners of ``geometry``."""
    point = lambda p: F.transform(F.split(F.trim(p), " "), lambda v: v.cast("double"))
    texts = F.regexp_extract_all("geometry", F.lit(r"\(([-0-9.e+, ]+)\)"), F.lit(1))
    out = polygons.withColumn("__rings", F.transform(texts, lambda t: F.transform(F.split(t, ","), point)))

    def over(ring, f):
        pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), f)
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    # an outline and its holes turn in opposite ways, so their signed areas have opposite signs
    area = F.aggregate(F.transform("__rings", lambda r: over(r, lambda p, q: (p[0] * q[1] - q[0] * p[1]) / 2)), F.lit(0.0), lambda a, x: a + x)
    length = F.aggregate(F.transform("__rings", lambda r: over(r, lambda p, q: F.abs(p[0] - q[0]) + F.abs(p[1] - q[1]))), F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"n_rings": F.size("__rings"), "area": F.abs(area), "length": length}).drop("__rings")
