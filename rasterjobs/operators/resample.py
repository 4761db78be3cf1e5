"""Alignment of grids: stacking by pixel, bilinear resampling by grid shape, warping from geographic to UTM, densifying."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterjobs.operators.skew import HOT_KEYS
from rasterjobs.operators.tiles import TILE
from rasterjobs.runtime import ship, snapshot
from rasterjobs.schema import KEY

#: Side of the source blocks that meet target tiles; a box of more than so many times a target tile's cells is not shipped.
BLOCK, WIDE = 64, 16


def stack_bands(bands: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """One wide row per pixel that all bands have: long rows, one pivot with known names, one shuffle."""
    long_ = None
    for name, df in bands.items():
        one = df.select(*KEY, F.lit(name).alias("channel"), F.col(value).alias("v"))
        long_ = one if long_ is None else long_.unionByName(one)
    wide = long_.groupBy(*KEY).agg(*[F.max(F.when(F.col("channel") == n, F.col("v"))).alias(n) for n in bands], F.count_distinct("channel").alias("__n"))
    return wide.where(F.col("__n") == len(bands)).drop("__n")


def _taps(targets: np.ndarray, src: int, dst: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first source cell, second, share of the second) of target cells: centres aligned, edges clamped."""
    at = (targets + 0.5) * (src / dst) - 0.5
    low = np.floor(at)
    return np.clip(low, 0, src - 1).astype(np.int64), np.clip(low + 1, 0, src - 1).astype(np.int64), at - low


def _target_tiles(axis: str, src: int, dst: int, tile: int) -> Column:
    """The target tiles with a cell that a source cell may reach, as a sequence; null if there are none."""
    at, q = F.col(axis), dst / src
    low = F.when(at <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((at - 0.5) * q - 0.5 - 1e-6)))
    high = F.when(at >= src - 1, F.lit(dst - 1)).otherwise(F.least(F.lit(dst - 1), F.floor((at + 1.5) * q - 0.5 + 1e-6)))
    return F.when(low <= high, F.sequence(F.floor(low / tile).cast("int"), F.floor(high / tile).cast("int")))


def resample_to(df: DataFrame, x: str, src: tuple[int, int], dst: tuple[int, int], tile: int = TILE) -> DataFrame:
    """``(scene_id, row, col, x)`` on a grid of ``dst`` = (height, width): bilinear, weights renewed over valid taps.

    Source cells are dealt to the target tiles that they reach, in one exchange; a tile holds only source rows and columns
    that it weighs, two a target row or column at most, so its memory is bounded whatever the ratio of the grids. A target
    cell without a source cell has no row; one whose source cells are all missing is NULL.
    """
    ship(df.sparkSession)
    both = F.flatten(F.transform(_target_tiles("row", src[0], dst[0], tile), lambda r: F.transform(_target_tiles("col", src[1], dst[1], tile), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    inside = f"row between 0 and {src[0] - 1} and col between 0 and {src[1] - 1}"
    rows = df.where(inside).select(*KEY, F.col(x).cast("double").alias("__x"), F.explode(both).alias("t")).select(*KEY, "__x", F.col("t.r").alias("__r"), F.col("t.c").alias("__c"))
    kinds = T.StructType([rows.schema["scene_id"], T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField(x, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        places, taps = [], []
        for axis, s, d, t in (("row", src[0], dst[0], "__r"), ("col", src[1], dst[1], "__c")):
            first = table.column(t)[0].as_py() * tile
            target = np.arange(first, min(d, first + tile))
            one, two, share = _taps(target, s, d)
            known = np.unique(np.concatenate([one, two]))  # source rows (columns) in use
            at = np.searchsorted(known, table.column(axis).to_numpy())
            at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == table.column(axis).to_numpy()), at, -1)
            places.append(at)
            taps.append((target, len(known), np.searchsorted(known, one), np.searchsorted(known, two), share))
        use = (places[0] >= 0) & (places[1] >= 0)
        shape = (taps[0][1], taps[1][1])
        value, valid, there = (np.zeros(shape) for _ in range(3))
        r, c, v = places[0][use], places[1][use], table.column("__x").to_numpy()[use]
        known = ~np.isnan(v)
        value[r, c], valid[r, c], there[r, c] = np.where(known, v, 0.0), known, 1.0

        def weigh(a: np.ndarray) -> np.ndarray:
            for _, _, one, two, share in (taps[1], taps[0]):
                a = (a[:, one] * (1 - share) + a[:, two] * share).T
            return a

        total, share, reached = weigh(value), weigh(valid), weigh(there) > 0
        i, j = np.nonzero(reached)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(share > 0, total / share, np.nan)[i, j]
        scene = pa.array([table.column("scene_id")[0].as_py()] * len(i), table.schema.field("scene_id").type)
        return pa.table({"scene_id": scene, "row": pa.array(taps[0][0][i], pa.int32()), "col": pa.array(taps[1][0][j], pa.int32()), x: pa.array(out, pa.float64(), mask=np.isnan(out))})

    return rows.groupBy("scene_id", "__r", "__c").applyInArrow(run, kinds)


def utm_to_geographic(x: Column, y: Column, zone: int = 44, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude in degrees (WGS84): inverse transverse Mercator by Karney's series to the third order.

    C. F. F. Karney, Transverse Mercator with an accuracy of a few nanometers, 2011.
    """
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    xi = (y - (0.0 if north else 1e7)) / (k0 * radius)
    eta = (x - 500000.0) / (k0 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))  # conformal latitude; a series gives the geographic one
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    phi = sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (6 * zone - 183)
    return lon, F.degrees(phi)


def _taps_of(fr: Column, fc: Column) -> Column:
    """The four source cells (sr, sc, w) around a place."""
    r, c = F.floor(fr), F.floor(fc)
    v, u = fr - r, fc - c
    return F.array(*[F.struct((r + i).cast("long").alias("sr"), (c + j).cast("long").alias("sc"), ((v if i else 1 - v) * (u if j else 1 - u)).alias("w")) for i in (0, 1) for j in (0, 1)])


def _by_taps(cells: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """``targets`` (with __fr, __fc) with ``__z``: four rows a target join the source cells by equality."""
    four = targets.select(*KEY, *on, F.explode(_taps_of(F.col("__fr"), F.col("__fc"))).alias("t")).select(*KEY, *on, "t.*").where("w > 0")
    got = four.join(cells, [*on, "sr", "sc"]).groupBy(*KEY).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("__z"))
    return targets.join(got, KEY, "left")


def _by_tiles(cells: DataFrame, targets: DataFrame, boxes: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """``targets`` (with __fr, __fc and the tile ``key``) with ``__z``: each target tile meets the source cells of its box once, in arrays."""
    blocks = lambda low, high: F.sequence(F.floor(F.col(low) / BLOCK), F.floor(F.col(high) / BLOCK))
    met = F.flatten(F.transform(blocks("r0", "r1"), lambda r: F.transform(blocks("c0", "c1"), lambda c: F.struct(r.alias("br"), c.alias("bc")))))
    pairs = boxes.select(*key, "r0", "r1", "c0", "c1", F.explode(met).alias("b")).select(*key, "r0", "r1", "c0", "c1", "b.*")
    pairs = F.broadcast(pairs) if pairs.count() <= HOT_KEYS else pairs
    blocked = cells.withColumns({"br": F.floor(F.col("sr") / BLOCK), "bc": F.floor(F.col("sc") / BLOCK)})
    shipped = blocked.join(pairs, [*on, "br", "bc"]).where("sr between r0 and r1 and sc between c0 and c1").select(*key, "sr", "sc", "__v")
    kinds = T.StructType([*targets.schema.fields, T.StructField("__z", T.DoubleType())])

    def gather(targets: pa.Table, cells: pa.Table) -> pa.Table:
        total, weight = np.zeros(targets.num_rows), np.zeros(targets.num_rows)
        if targets.num_rows and cells.num_rows:
            sr, sc, v = (cells.column(c).to_numpy() for c in ("sr", "sc", "__v"))
            top, left, wide = sr.min(), sc.min(), int(sc.max() - sc.min()) + 1
            place = (sr - top) * wide + sc - left
            order = np.argsort(place)
            place, v = place[order], v[order]
            fr, fc = (targets.column(c).to_numpy() for c in ("__fr", "__fc"))
            known = np.isfinite(fr) & np.isfinite(fc)
            fr, fc = np.where(known, np.clip(fr, top - 9.0, sr.max() + 9.0), top - 9.0), np.where(known, np.clip(fc, left - 9.0, left + wide + 9.0), left - 9.0)
            r, c = np.floor(fr), np.floor(fc)
            for i, wr in ((0, 1 - (fr - r)), (1, fr - r)):
                for j, wc in ((0, 1 - (fc - c)), (1, fc - c)):
                    y, x = r.astype(np.int64) + i - top, c.astype(np.int64) + j - left
                    at = np.minimum(np.searchsorted(place, y * wide + x), len(place) - 1)
                    w = np.where((x >= 0) & (x < wide) & (place[at] == y * wide + x), wr * wc, 0.0)
                    total, weight = total + w * v[at], weight + w
        out = np.divide(total, weight, out=np.zeros(len(total)), where=weight > 0)
        return targets.append_column("__z", pa.array(out, mask=weight == 0))

    return targets.groupBy(*key).cogroup(shipped.groupBy(*key)).applyInArrow(gather, kinds)


def warp(source: DataFrame, value: str, targets: DataFrame, x: Column, y: Column, affine: tuple[float, float, float, float], tile: int = TILE) -> DataFrame:
    """``targets`` (scene_id, row, col, ...) with ``value``: bilinear from a source grid at world coordinates (x, y); 0 outside.

    ``affine`` = (x0, dx, y0, dy) of the source's corner. A target tile's box in the source bounds where its cells map to; source blocks meet the
    boxes that they overlap, and a tile gathers from the cells of its box, so about the source's cells are shuffled. A tile whose box
    has more than WIDE times its own cells (a strong reduction) joins the four cells of each target by equality instead. A
    source of several scenes is an error, unless ``targets`` names each target's in a column source_id.
    """
    ship(source.sparkSession)
    x0, dx, y0, dy = affine
    named = "source_id" in targets.columns
    if not named and len(source.select("scene_id").distinct().take(2)) > 1:
        raise ValueError("a source of several scenes needs targets with source_id")
    on = ["source_id"] if named else []
    key = [*on, "scene_id", "__tr", "__tc"]
    names = [c for c in targets.columns if c != value]
    t = targets.withColumns({"__fc": ((x - x0) / dx - 0.5).cast("double"), "__fr": ((y - y0) / dy - 0.5).cast("double")}).drop(value)
    t = t.withColumns({"__tr": F.floor(F.col("row") / tile), "__tc": F.floor(F.col("col") / tile)})
    cells = source.select(F.col("scene_id").alias("source_id"), F.col("row").cast("long").alias("sr"), F.col("col").cast("long").alias("sc"), F.col(value).cast("double").alias("__v")).where("__v is not null")
    cells = cells.select(*on, "sr", "sc", "__v")
    finite = lambda c: F.col(c).between(-1e15, 1e15)
    span = [f(F.floor(c)).cast("long").alias(name) for c, low, high in (("__fr", "r0", "r1"), ("__fc", "c0", "c1")) for f, name in ((F.min, low), (F.max, high))]
    boxes = t.where(finite("__fr") & finite("__fc")).groupBy(*key).agg(*span)
    size = cells.groupBy(*on).agg(*[f(c).alias(name) for c, low, high in (("sr", "__r0", "__r1"), ("sc", "__c0", "__c1")) for f, name in ((F.min, low), (F.max, high))])
    boxes = boxes.join(size, on) if named else boxes.crossJoin(F.broadcast(size))  # one row
    clipped = {"r0": F.greatest("r0", "__r0"), "r1": F.least(F.col("r1") + 1, F.col("__r1")), "c0": F.greatest("c0", "__c0"), "c1": F.least(F.col("c1") + 1, F.col("__c1"))}
    boxes = snapshot(boxes.select(*key, *[e.alias(n) for n, e in clipped.items()]).where("r0 <= r1 and c0 <= c1"), "boxes")
    wide = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) > WIDE * tile * tile
    far = boxes.where(wide).select(*key)
    some = far.limit(1).count()
    near = t.join(far, key, "left_anti") if some else t
    out = _by_tiles(cells, near, boxes.where(~wide), key, on)
    if some:
        out = out.unionByName(_by_taps(cells, t.join(far, key, "left_semi"), on).select(*out.columns))
    return out.select(*names, F.coalesce("__z", F.lit(0.0)).alias(value))


def reproject_to(dem: DataFrame, targets: DataFrame, scene: dict, dem_affine: tuple[float, float, float, float], zone: int = 44, value: str = "z") -> DataFrame:
    """A geographic DEM on a UTM grid whose corner and steps are ``scene`` (x0, dx, y0, dy)."""
    x = scene["x0"] + (F.col("col") + 0.5) * scene["dx"]
    y = scene["y0"] + (F.col("row") + 0.5) * scene["dy"]
    lon, lat = utm_to_geographic(x, y, zone)
    return warp(dem, value, targets, lon, lat, dem_affine)


def densify(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every cell of each scene (scene_id, height, width), NULL where ``df`` has none."""
    rows = scenes.select("scene_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    return rows.select("scene_id", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col")).join(df, KEY, "left")


def mask_by(df: DataFrame, mask: DataFrame, how: str = "zero", columns: list[str] | None = None, fill: float = 0.0) -> DataFrame:
    """``keep`` or ``drop`` pixels where the mask is 1, or set ``columns`` to ``fill`` elsewhere (``zero``)."""
    on = mask.where("mask = 1").select(*KEY)
    if how in ("keep", "drop"):
        return df.join(on, KEY, "left_semi" if how == "keep" else "left_anti")
    joined = df.join(on.withColumn("__on", F.lit(1)), KEY, "left")
    return joined.withColumns({c: F.when(F.col("__on") == 1, F.col(c)).otherwise(F.lit(fill)) for c in columns or []}).drop("__on")
