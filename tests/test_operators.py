"""Goldens, brute force on small grids, properties and edge cases."""

import json
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rasterjobs.functions import algebra as A
from rasterjobs.operators import accuracy, components, contributions, depth, focal, hist, ml, outlines, patches, regions, resample, slices, summed, texture, tiles
from rasterjobs.plans import report, workloads
from rasterjobs.schema import BANDS
from rasterjobs.sources import io, morton, tiff


def pixels(spark, array, name="x", scene="s"):
    rows = [(scene, r, c, None if isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v) for r, line in enumerate(array) for c, v in enumerate(line)]
    kind = "double" if np.asarray(array).dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"scene_id string, row int, col int, {name} {kind}")


def raster(df, name, shape, default=0.0):
    out = np.full(shape, default, float)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def reflected(a, k):
    return np.pad(a, k, mode="symmetric")


def test_accuracy_goldens(spark):
    df = spark.createDataFrame([(10684336, 965166, 1577423, 65709121)], "tp long, fp long, fn long, tn long")
    r = accuracy.accuracy_scores(df).first()
    assert (r.overall_accuracy, r.iou, r.f1, r.precision, r.recall, r.kappa) == (0.9678, 0.8078, 0.8937, 0.9171, 0.8714, 0.8747)
    none = accuracy.accuracy_scores(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")).first()
    assert none.kappa is None and none.iou == 0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0,), (117.0,), (200.0,), (None,)], "dn double")
    got = [r.v for r in df.select(A.calibrate("dn", 13783.756).alias("v")).collect()]
    assert got[0] is None and got[1] is None and got[3] is None and got[2] == pytest.approx((40000 - 13783.756) / 10**6.8664)
    odd = spark.createDataFrame([(-1.0,), (0.0,), (float("inf"),), (float("nan"),), (10.0,)], "x double")
    assert [r.v for r in odd.select(A.to_db("x").alias("v")).collect()] == [None, None, None, None, pytest.approx(10.0)]
    long_ = spark.createDataFrame([("before", "HH", 200.0)], "date_key string, pol string, dn double")
    assert A.calibrate_long(long_, A.calibration_table(spark)).first().sigma == pytest.approx(got[2])


@pytest.mark.parametrize("shape", [(20, 30), (2, 5), (1, 9)])
def test_windows_match_numpy(spark, shape):
    rng = np.random.default_rng(1)
    a = rng.normal(5, 2, shape)
    a[rng.random(shape) < 0.1] = np.nan
    df, z = pixels(spark, a), np.nan_to_num(a)
    p = reflected(z, 3) if min(shape) >= 3 else np.pad(z, 3, mode="symmetric")
    mean = np.array([[p[r : r + 7, c : c + 7].mean() for c in range(shape[1])] for r in range(shape[0])])
    sq = np.array([[(p[r : r + 7, c : c + 7] ** 2).mean() for c in range(shape[1])] for r in range(shape[0])])
    var = np.maximum(sq - mean**2, 0)
    assert np.allclose(raster(focal.box_mean(df, "x"), "mean", shape), mean)
    assert np.allclose(raster(focal.local_stats(df, "x"), "local_std", shape), np.sqrt(var), atol=1e-6)
    lee = np.where(np.isnan(a), np.nan, mean + var / (var + mean**2 / 2 + 1e-10) * (a - mean))
    assert np.allclose(raster(focal.lee_filter(df, "x"), "filtered", shape), lee, equal_nan=True)
    w = np.array(focal.gaussian_weights(1.0))
    g = np.pad(z, len(w) // 2, mode="symmetric")
    g = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, g)
    g = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, g)
    smooth = focal.gaussian_smooth(pixels(spark, z), "x", 1.0)
    assert np.allclose(raster(smooth, "smooth", shape), g)


def brute(a, k, worst):
    p = np.pad(a, k, constant_values=0)
    return np.array([[worst(p[r : r + 2 * k + 1, c : c + 2 * k + 1]) for c in range(a.shape[1])] for r in range(a.shape[0])])


def test_morphology_matches_brute_force(spark):
    a = (np.random.default_rng(2).random((25, 31)) < 0.8).astype(int)
    df = pixels(spark, a, "mask")
    opened, closed = brute(brute(a, 1, np.min), 1, np.max), brute(brute(a, 2, np.max), 2, np.min)
    assert (raster(focal.opening(df), "mask", a.shape) == opened).all() and (raster(focal.closing(df), "mask", a.shape) == closed).all()
    both = brute(brute(opened, 2, np.max), 2, np.min)
    assert (raster(focal.open_close(df), "mask", a.shape) == both).all() and not both[:2].any() and not both[:, -2:].any()
    assert (raster(focal.erode(df, 3), "mask", a.shape) == brute(a, 1, np.min)).all() and (raster(focal.dilate(df, 3), "mask", a.shape) == brute(a, 1, np.max)).all()


def test_chains_of_windows_take_one_exchange_of_pixels(spark):
    df = pixels(spark, np.random.default_rng(2).random((5, 6)), "x").withColumn("mask", F.lit(1))
    sizes = spark.createDataFrame([("s", 5, 6)], "scene_id string, height int, width int")
    bands = df.select("scene_id", "row", "col", *[F.col("x").alias(b) for b in BANDS])
    chains = {
        "despeckle": workloads.despeckled(bands, sizes=sizes),
        "features": A.basic_features(workloads.despeckled(bands, sizes=sizes)),
        "gaussian": focal.gaussian_smooth(df, "x", sizes=sizes),
        "open_close": focal.open_close(df, sizes=sizes),
        "resample": resample.resample_to(df, "x", (5, 6), (9, 4)),
    }
    for name, made in chains.items():
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name
    plan = focal.open_close(df)._jdf.queryExecution().executedPlan().toString()  # sizes unknown: one more, of a row per scene
    assert plan.count("Exchange hashpartitioning") == 2 and "hashpartitioning(scene_id" in plan


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_windows_do_not_depend_on_tiles(spark, tile, monkeypatch):
    rng = np.random.default_rng(tile)
    a = rng.normal(50, 2, (23, 17))
    a[rng.random(a.shape) < 0.1] = np.nan
    whole = {"m": focal.moments(reflected(a, 9), 7)[0], "g": focal.window_convolution(reflected(np.nan_to_num(a), 9), focal.gaussian_weights(2.0))}
    df = pixels(spark, a)
    monkeypatch.setattr(tiles.over_tiles, "__defaults__", (None, tile))
    assert np.allclose(raster(focal.box_mean(df, "x"), "mean", a.shape), whole["m"][9:-9, 9:-9])
    assert np.allclose(raster(focal.gaussian_smooth(pixels(spark, np.nan_to_num(a)), "x", 2.0), "smooth", a.shape), whole["g"][9:-9, 9:-9])
    valid = np.lib.stride_tricks.sliding_window_view(reflected(a, 3), (7, 7)).reshape(23, 17, 49)
    with np.errstate(all="ignore"):
        assert np.allclose(raster(focal.local_stats(df, "x", valid_only=True), "local_std", a.shape), np.nanstd(valid, axis=2), equal_nan=True)
    m = (rng.random((23, 17)) < 0.8).astype(int)
    gaps = pixels(spark, m, "mask").where("(row * 17 + col) % 29 <> 5").withColumn("extra", F.lit("e"))  # cells that the table doesn't have are 0
    m[np.arange(m.size).reshape(m.shape) % 29 == 5] = 0
    there = (np.arange(m.size).reshape(m.shape) % 29 != 5).astype(int)
    opened = brute(brute(m, 1, np.min) * there, 1, np.max) * there
    both = brute(brute(opened, 2, np.max) * there, 2, np.min) * there
    made = focal.open_close(gaps)
    assert (raster(made, "mask", m.shape) == both).all() and made.columns == gaps.columns and made.where("extra = 'e'").count() == gaps.count()
    again = resample.resample_to(df, "x", a.shape, (40, 9), tile=tile)
    assert np.allclose(raster(again, "x", (40, 9)), raster(resample.resample_to(df, "x", a.shape, (40, 9)), "x", (40, 9)), equal_nan=True) and again.count() == 360


def test_window_sums_and_extremes_of_arrays():
    rng = np.random.default_rng(8)
    for k in (0, 1, 3, 6):
        a = rng.normal(size=(21, 30))
        view = np.lib.stride_tricks.sliding_window_view(a, (2 * k + 1, 2 * k + 1))
        inner = (slice(k, 21 - k), slice(k, 30 - k))
        assert np.allclose(focal.window_sums(a, k)[inner], view.sum(axis=(2, 3)))
        assert (focal.window_extremes(a, k, True)[inner] == view.min(axis=(2, 3))).all() and (focal.window_extremes(a, k, False)[inner] == view.max(axis=(2, 3))).all()


def labels(a):
    out, n = np.zeros(a.shape, int), 0
    for r, c in zip(*np.nonzero(a), strict=True):
        if not out[r, c]:
            n += 1
            todo = deque([(r, c)])
            out[r, c] = n
            while todo:
                y, x = todo.popleft()
                for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and a[v, u] == 1 and not out[v, u]:
                        out[v, u] = n
                        todo.append((v, u))
    return out


def test_regions_sieve_and_outlines(spark):
    a = (np.random.default_rng(3).random((20, 30)) < 0.55).astype(int)
    df, want = pixels(spark, a, "mask"), labels(a)
    found = regions.connected_regions(df, dense=True).cache()
    assert (raster(found, "region_id", a.shape) == want).all()
    sizes = np.bincount(want.ravel())
    sizes[0] = 0
    kept = sizes[want] >= 24
    assert (raster(regions.sieve(df, 24), "mask", a.shape) == kept).all()
    top = regions.largest_regions(found, 3).collect()
    assert [r.n_px for r in top] == sorted(sizes, reverse=True)[:3]
    stats = {r.region_id: r for r in regions.polygon_stats(found, 1.0).collect()}
    for p in outlines.polygonize(found).collect():
        rings = [[tuple(map(float, q.split(" "))) for q in ring.split(", ")] for ring in p.geometry.removeprefix("POLYGON ((").removesuffix("))").split("), (")]
        area = sum(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(r, r[1:], strict=False)) / 2 for r in rings)
        length = sum(abs(x1 - x0) + abs(y1 - y0) for r in rings for (x0, y0), (x1, y1) in zip(r, r[1:], strict=False))
        assert abs(area) == stats[p.region_id].n_px and length == stats[p.region_id].perimeter_m
    assert regions.connected_regions(df.where("false")).count() == 0 and regions.sieve(df.where("mask = 0")).agg(F.sum("mask")).first()[0] == 0


def spiral(n):
    a = np.zeros((n, n), int)
    r = c = 0
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top <= bottom and left <= right:
        a[top, left : right + 1] = 1
        a[top : bottom + 1, right] = 1
        a[bottom, left : right + 1] = 1
        a[top + 2 : bottom + 1, left] = 1
        if left + 1 <= right and top + 2 <= bottom:
            a[top + 2, left + 1] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return a


def comb(n):
    a = np.zeros((n, n), int)
    a[:, ::2] = 1
    a[-1, : n // 2] = 1
    return a


@pytest.mark.parametrize("tile", [3, 8])
def test_regions_merge_up_a_quadtree(spark, tile):
    rng = np.random.default_rng(tile)
    masks = [spiral(40), comb(33), (rng.random((37, 50)) < 0.6).astype(int), np.ones((25, 9), int), np.zeros((5, 5), int)]
    df, want, kept = None, {}, {}
    for k, a in enumerate(masks):
        move = 1000 * k  # grids needn't begin at 0
        one = pixels(spark, a, "mask", f"s{k}").withColumns({"row": F.col("row") + move, "col": F.col("col") + 7 * k, "extra": F.col("row")})
        df = one if df is None else df.unionByName(one)
        found, sizes = labels(a), None
        sizes = np.bincount(found.ravel())
        for n in range(1, found.max() + 1):
            cells = [(int(r) + move, int(c) + 7 * k) for r, c in zip(*np.nonzero(found == n), strict=True)]
            want |= {(f"s{k}", *x): cells[0][0] * regions.STRIDE + cells[0][1] for x in cells}
            kept |= {(f"s{k}", *x): int(sizes[n] >= 9) for x in cells}
    got = {(r.scene_id, r.row, r.col): r.region_id for r in regions.connected_regions(df, tile=tile).collect()}
    assert got == want
    left = regions.sieve(df, 9, tile=tile)
    assert left.columns == df.columns and left.count() == df.count() and {(r.scene_id, r.row, r.col): r.mask for r in left.where("mask = 1").collect()} == {x: 1 for x, on in kept.items() if on}


def rings_by_hand(a):
    """{region: rings} by walking one side after the other; each ring from its smallest corner on, outline first."""
    found, out = labels(a), {}
    inside = lambda r, c: 0 <= r < a.shape[0] and 0 <= c < a.shape[1] and a[r, c] == 1
    moves = [(0, -1), (1, 0), (0, 1), (-1, 0)]
    left = {(r, c, s) for r, c in zip(*map(lambda x: x.tolist(), np.nonzero(a)), strict=True) for s, (y, x) in enumerate([(-1, 0), (0, -1), (1, 0), (0, 1)]) if not inside(r + y, c + x)}
    while left:
        at = start = min(left)
        corners, area = [], 0
        while True:
            left.discard(at)
            r, c, s = at
            v = (r, c) if s == 0 else (r + 1, c) if s == 1 else (r + 1, c + 1) if s == 2 else (r, c + 1)
            y, x = moves[s]
            ahead = (r + y, c + x)
            side = moves[(s + 3) % 4]
            diagonal = (ahead[0] + side[0], ahead[1] + side[1])
            nxt = (r, c, (s + 1) % 4) if not inside(*ahead) else (*ahead, s) if not inside(*diagonal) else (*diagonal, (s + 3) % 4)
            if nxt[2] != s:
                corners.append(v)
            area += {1: -c, 3: c + 1}.get(s, 0)
            at = nxt
            if at == start:
                break
        k = corners.index(min(corners))
        ring = corners[k:] + corners[: k + 1]
        out.setdefault(int(found[start[0], start[1]]), []).append((area < 0, ring))
    return {n: [ring for _, ring in sorted(rings)] for n, rings in out.items()}


@pytest.mark.parametrize("tile", [3, 64])
def test_outlines_match_a_walk_along_cells(spark, tile):
    rng = np.random.default_rng(tile)
    blob = (rng.random((30, 26)) < 0.62).astype(int)
    for a in (blob, spiral(21), comb(14), np.array([[1, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 1]]), np.ones((9, 9), int)):
        found = regions.connected_regions(pixels(spark, a, "mask"), dense=True)
        got = {}
        for p in outlines.polygonize(found, tile=tile).collect():
            rings = p.geometry.removeprefix("POLYGON ((").removesuffix("))").split("), (")
            got[p.region_id] = [[(-int(y), int(x)) for x, y in (q.split(" ") for q in ring.split(", "))] for ring in rings]
        assert got == rings_by_hand(a)
    assert outlines.polygonize(found.where("false")).count() == 0


def test_a_comb_of_very_many_corners_has_no_large_group(spark):
    teeth = 250_000
    comb_ = spark.range(2 * teeth).selectExpr("'s' AS scene_id", "0 AS row", "cast(id AS int) AS col").unionByName(spark.range(teeth).selectExpr("'s' AS scene_id", "1 AS row", "cast(2 * id AS int) AS col"))
    ring = outlines.rings(comb_.withColumn("region_id", F.lit(7))).cache()
    r = ring.first()
    assert ring.count() == 1 and not r.hole and r.ring == 0
    corners = r.corners.split(", ")
    assert len(corners) == 4 * teeth + 3 and corners[0] == corners[-1] == "0 0" and corners[1:4] == ["0 -2", "1 -2", "1 -1"] and corners[-2] == f"{2 * teeth} 0"
    # rows of a ring's group are its chains: at most a few for each of the tiles along the comb
    assert outlines._pieces(comb_.withColumn("region_id", F.lit(7)), (0, 1, 0, -1), 256).count() <= 3 * (2 * teeth // 256)


def test_rounds_of_merging_are_the_height_of_the_tree(spark, monkeypatch):
    rounds = []
    plain = regions.snapshot
    monkeypatch.setattr(regions, "snapshot", lambda df, name: rounds.append(name) or plain(df, name))
    regions.connected_regions(pixels(spark, spiral(33), "mask"), tile=4).count()
    assert rounds.count("merged") == 4  # nine tiles a side


def test_components_of_a_long_path_and_repeats(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    rows = [(order[i], order[i + 1]) for i in range(n - 1)] * 2 + [(1000, 1001), (1001, 1002), (7, 7), (None, 3)]
    out = dict(map(tuple, components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert len(out) == n + 3 and {out[i] for i in range(n)} == {0} and out[1002] == 1000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_depth_of_small_and_large_regions(spark):
    mask = np.zeros((12, 12), int)
    mask[1:4, 1:4] = 1
    mask[8, 8:12] = 1  # four cells: depth 0
    z = np.add.outer(np.arange(12.0), np.arange(12.0))
    df = pixels(spark, mask, "mask").join(pixels(spark, z, "z"), ["scene_id", "row", "col"])
    out = depth.flood_depth(df, sigma=0.2)
    d = raster(out, "depth", mask.shape)
    assert np.isnan(d[mask == 0]).all() and (d[8, 8:] == 0).all()
    level = np.quantile(z[1:4, 1:4], 0.9)
    assert np.allclose(d[1:4, 1:4], np.maximum(level - z[1:4, 1:4], 0), atol=1e-4)
    stats = depth.depth_class_stats(depth.depth_classes(out)).collect()
    assert len(stats) == 14 and sum(r.pixels for r in stats) == mask.sum() and depth.depth_labels()[-1] == "> 6.5 m"
    assert {r["class"]: r.pixels for r in stats}[1] >= 4


def test_thresholds_and_histograms(spark):
    x = np.concatenate([np.random.default_rng(5).normal(-20, 1, 300), np.random.default_rng(6).normal(-8, 1, 700)])[None, :]
    t = hist.otsu_threshold(pixels(spark, x), "x").first().threshold
    assert -18 < t < -10
    assert hist.otsu_threshold(pixels(spark, np.full((2, 3), 4.5)), "x").first().threshold == 4.5
    assert hist.otsu_threshold(pixels(spark, np.full((2, 3), np.nan)), "x").count() == 0
    h = hist.histogram(pixels(spark, x), "x", 50).collect()
    assert len(h) == 50 and sum(r.n for r in h) == 1000 and sum(r.value for r in h) * (x.max() - x.min()) / 50 == pytest.approx(1)
    got = {r.p: r.value for r in hist.band_percentiles(pixels(spark, x), "x", [5, 50, 95]).collect()}
    assert all(v == pytest.approx(np.percentile(x, p)) for p, v in got.items())
    df = pixels(spark, np.where(np.arange(40).reshape(4, 10) % 3 == 0, np.nan, 1.0 * np.arange(40).reshape(4, 10)))
    kept = sorted(r.x for r in hist.subsample_every(df, 4, "x").collect())
    assert kept == [v for v in range(40) if v % 3][::4]


def test_resampling_and_warping(spark):
    a = np.random.default_rng(7).normal(size=(7, 9))
    df = pixels(spark, a)
    assert np.allclose(raster(resample.resample_to(df, "x", (7, 9), (7, 9)), "x", (7, 9)), a)
    out = raster(resample.resample_to(df, "x", (7, 9), (10, 5)), "x", (10, 5))
    for r in range(10):
        for c in range(5):
            y, x = (r + 0.5) * 0.7 - 0.5, (c + 0.5) * 1.8 - 0.5
            i, j = math.floor(y), math.floor(x)
            want = sum(a[min(max(i + u, 0), 6), min(max(j + v, 0), 8)] * (y - i if u else 1 - y + i) * (x - j if v else 1 - x + j) for u in (0, 1) for v in (0, 1))
            assert out[r, c] == pytest.approx(want)
    lon, lat = resample.utm_to_geographic(F.lit(500000.0), F.lit(2432817.0))
    r = spark.range(1).select(lon.alias("a"), lat.alias("b")).first()
    assert r.a == pytest.approx(81) and 21.9 < r.b < 22.1
    one = pixels(spark, np.full((2, 2), 3.0), "z")
    far = resample.warp(one, "z", pixels(spark, np.zeros((1, 1))), F.lit(99.0), F.lit(99.0), (0, 1, 0, 1))
    assert far.first().z == 0
    sizes = spark.createDataFrame([("s", 3, 2)], "scene_id string, height int, width int")
    assert resample.densify(pixels(spark, np.array([[1.0]])), sizes).count() == 6
    both = resample.stack_bands({"a": df.withColumnRenamed("x", "value"), "b": df.where("row > 0").withColumnRenamed("x", "value")})
    assert both.count() == 54 and both.columns[-2:] == ["a", "b"]


def utm_forward(lat, lon, zone):
    """Transverse Mercator by the forward series, whose coefficients are others than the inverse's."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    north = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    east = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return 500000 + k0 * radius * east, k0 * radius * north


def test_utm_series_invert_the_forward_series(spark):
    points = [(lat, 81 + away) for lat in (1.0, 21.7, 45.0) for away in (-1.9, 0.3, 1.9)]
    df = spark.createDataFrame([(*utm_forward(lat, lon, 44), lat, lon) for lat, lon in points], "x double, y double, lat double, lon double")
    lon, lat = resample.utm_to_geographic(F.col("x"), F.col("y"))
    for r in df.select("lat", "lon", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)


def warp_by_hand(source, fr, fc):
    total = weight = 0.0
    r, c = math.floor(fr), math.floor(fc)
    for i in (0, 1):
        for j in (0, 1):
            w = (fr - r if i else 1 - fr + r) * (fc - c if j else 1 - fc + c)
            if w > 0 and 0 <= r + i < source.shape[0] and 0 <= c + j < source.shape[1] and not np.isnan(source[r + i, c + j]):
                total, weight = total + w * source[r + i, c + j], weight + w
    return total / weight if weight else 0.0


@pytest.mark.parametrize("tile,wide", [(5, 16), (64, 16), (5, 0)])
def test_warps_by_tiles_match_brute_force(spark, tile, wide, monkeypatch):
    monkeypatch.setattr(resample, "WIDE", wide)
    monkeypatch.setattr(resample, "BLOCK", 7)
    rng = np.random.default_rng(4)
    source = rng.normal(size=(40, 33))
    source[rng.random(source.shape) < 0.2] = np.nan
    df = pixels(spark, source, "z", "dem")
    targets = pixels(spark, np.zeros((17, 23)), "extra", "t").withColumn("z", F.lit(-1))
    for x, y in ((F.col("col") * 0.9 + 3.3 + F.sin("row"), F.col("row") * 1.7 - 2.2), (F.col("row") * 1.5, F.col("col") * -0.5 + 20.25), (F.when(F.col("row") == 3, F.lit(float("nan"))).when(F.col("col") > 4, F.col("col") * 4.0), F.col("row") * 1e6)):
        out = resample.warp(df, "z", targets, x, y, (0.0, 1.0, 0.0, 1.0), tile)
        assert out.columns == ["scene_id", "row", "col", "extra", "z"] and out.count() == targets.count()
        for r in out.withColumns({"x": x, "y": y}).collect():
            want = warp_by_hand(source, r.y - 0.5, r.x - 0.5) if r.x is not None and not math.isnan(r.x) and abs(r.y) < 1e5 else 0.0
            assert r.z == pytest.approx(want, abs=1e-9)
    two = df.unionByName(pixels(spark, np.full((40, 33), 7.0), "z", "other"))
    named = targets.withColumn("source_id", F.when(F.col("row") % 2 == 0, "dem").otherwise("other"))
    for r in resample.warp(two, "z", named, F.col("col") + 0.75, F.col("row") + 1.0, (0.0, 1.0, 0.0, 1.0), tile).collect():
        assert r.z == pytest.approx(7.0 if r.row % 2 else warp_by_hand(source, r.row + 0.5, r.col + 0.25))
    with pytest.raises(ValueError):
        resample.warp(two, "z", targets, F.col("col"), F.col("row"), (0.0, 1.0, 0.0, 1.0), tile)


def test_a_warp_ships_about_the_source_cells(spark, monkeypatch):
    seen, plain = [], resample._by_tiles
    monkeypatch.setattr(resample, "_by_tiles", lambda cells, targets, boxes, key, on: seen.append(boxes.selectExpr("sum((r1 - r0 + 1) * (c1 - c0 + 1))").first()[0]) or plain(cells, targets, boxes, key, on))
    df = spark.range(300 * 300).selectExpr("'s' AS scene_id", "cast(id div 300 AS int) AS row", "cast(id % 300 AS int) AS col", "1.5 AS z")
    out = resample.warp(df, "z", df.select("scene_id", "row", "col"), F.col("col") + 0.7, F.col("row") + 0.7, (0.0, 1.0, 0.0, 1.0), 64)
    assert out.where("abs(z - 1.5) < 1e-9").count() == 90_000 and seen[0] < 1.1 * 90_000  # cells of all boxes together


def test_patches(spark):
    origins = patches.sliding_patches(spark, 10401, 10401).collect()
    assert len(origins) == 576 and max(r.r0 for r in origins) == 9889
    assert [(r.r0, r.c0) for r in patches.sliding_patches(spark, 5, 5, 8, 2).collect()] == [(0, 0)]
    a = np.arange(30 * 20.0).reshape(30, 20)
    df = pixels(spark, a)
    cut = patches.patch_extract(df, patches.sliding_patches(spark, 30, 20, 8, 2), 8)
    assert cut.groupBy("patch_id").count().where("count <> 64").count() == 0
    back = patches.stitch(patches.score_patches(cut, ["x"], lambda x: x[0], 8, logits=False), df.drop("x"))
    assert np.allclose(raster(back, "prob", a.shape), a)
    four = cut
    for _ in range(4):
        four = A.augment_geom(four, "rot90", 8)
    assert four.select("patch_id", "row", "col", "pr", "pc").exceptAll(cut.select("patch_id", "row", "col", "pr", "pc")).count() == 0
    r = patches.random_patches(spark, 100, 50, 16, 500).agg(F.max("r0"), F.min("r0"), F.max("c0")).first()
    assert r[0] < 84 and r[1] >= 0 and r[2] < 34
    for f in (lambda d: A.augment_speckle(d, ["x"], 1), lambda d: A.augment_jitter(d, ["x"], 1), lambda d: A.random_geom(d, 8, 1)):
        assert f(cut).exceptAll(f(cut.repartition(3))).count() == 0 and f(cut).exceptAll(cut).count() > 0
    masked = cut.withColumn("mask", F.when(F.col("col") < 10, 255).otherwise(1))
    assert 0 < patches.patch_filter(masked).count() < cut.select("patch_id").distinct().count()
    assert patches.block_split(df, 5).select("part").distinct().count() == 2


def test_texture_of_a_constant_tile(spark):
    r = texture.glcm_texture(pixels(spark, np.full((6, 6), 3), "q"), tile=8).first()
    assert (r.contrast, r.correlation, r.energy, r.homogeneity) == (0, 1, 1, 1)
    q = texture.quantise(pixels(spark, np.arange(100.0).reshape(10, 10)), "x", 8).agg(F.min("q"), F.max("q")).first()
    assert tuple(q) == (0, 7) and texture.texture_map(pixels(spark, np.full((6, 6), 3), "q"), tile=8).count() == 36
    assert texture.glcm_texture(pixels(spark, np.full((3, 20), 3), "q"), tile=32).count() == 1  # fewer than four cells are left out
    assert texture.glcm_texture(pixels(spark, np.full((1, 3), 3), "q"), tile=16).count() == 0


def test_warp_of_several_scenes_needs_their_names(spark):
    one, two = pixels(spark, np.full((2, 2), 1.0)), pixels(spark, np.full((2, 2), 9.0)).withColumn("scene_id", F.lit("other"))
    both = one.unionByName(two).withColumnRenamed("x", "z")
    target = one.select("scene_id", "row", "col")
    with pytest.raises(ValueError):
        resample.warp(both, "z", target, F.col("col") + 0.5, F.col("row") + 0.5, (0, 1, 0, 1))
    out = resample.warp(both, "z", target.withColumn("source_id", F.lit("other")), F.col("col") + 0.5, F.col("row") + 0.5, (0, 1, 0, 1))
    assert {r.z for r in out.collect()} == {9.0}


def test_regions_over_many_tiles_match_brute_force(spark):
    rng = np.random.default_rng(12)
    grid = (rng.random((40, 53)) < 0.6).astype(int)
    label = np.where(grid == 1, np.arange(grid.size).reshape(grid.shape), -1)
    while True:
        before = label.copy()
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved = np.roll(label, step, axis)
            edge = [slice(None)] * 2
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = -1
            label = np.where((grid == 1) & (moved >= 0), np.minimum(label, moved), label)
        if (label == before).all():
            break
    df = pixels(spark, grid, "mask")
    found = regions.connected_regions(df, tile=8).collect()
    assert len(found) == grid.sum() and all(divmod(r.region_id, regions.STRIDE) == divmod(int(label[r.row, r.col]), 53) for r in found)
    rings = {r.region_id: r for r in regions.ring_table(outlines.polygonize(regions.connected_regions(df, tile=16))).collect()}
    stats = {r.region_id: r for r in regions.polygon_stats(regions.connected_regions(df), 1.0).collect()}
    assert {k: (r.area, r.length) for k, r in rings.items()} == {k: (r.area_m2, r.perimeter_m) for k, r in stats.items()}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from rasterjobs import runtime

    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master="yarn"), conf=none)
    with pytest.raises(ValueError):
        runtime.shared_dir(fake)


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    for i, (kind, deflate) in enumerate([("u1", True), ("u2", False), ("f4", True)]):
        a = (rng.random((2, 70, 33)) * 200 + 1).astype(kind)
        a[0, 3, 4] = 0
        (tmp_path / f"{i}.tif").write_bytes(tiff.write(a, 10, 2, 20, -2, deflate=deflate))
        b, p = tiff.read((tmp_path / f"{i}.tif").read_bytes())
        assert (a == b).all() and p == {"x0": 10, "dx": 2, "y0": 20, "dy": -2}
    df = io.read_rasters(spark, f"file://{tmp_path}/*.tif")
    assert df.count() == 3 * 2 * 70 * 33 and df.where("value is null").count() == 3
    assert {r.width for r in io.read_scenes(spark, f"file://{tmp_path}/*.tif").collect()} == {33}


def test_sources_and_sinks(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    io.write_pixels(pixels(spark, np.where(a == 5, np.nan, a + 1)), f"file://{tmp_path}/p", ["x"], 0.0)
    back = io.read_pixels(spark, f"file://{tmp_path}/p", ["x"])
    assert back.count() == 12 and back.where("x is null").count() == 1 and io.window_read(back, 1, 1, 2).count() == 4
    (tmp_path / "s.csv").write_text("row,col,label\n1,2,1\n2,3,0\n")
    assert [tuple(r) for r in io.read_samples(spark, f"file://{tmp_path}/s.csv").collect()] == [(1, 2, 1), (2, 3, 0)]
    (tmp_path / "h.json").write_text(json.dumps([{"epoch": e, "train_loss": 1.0, "val_loss": 1.0, "iou": v, "f1": 0.1, "oa": 0.2} for e, v in enumerate([0.5, 0.7, 0.6, 0.7], 1)]))
    history = io.read_history(spark, f"file://{tmp_path}/h.json")
    assert accuracy.best_epoch(history).first().epoch == 2 and [r.improved for r in accuracy.best_checkpoint(history).orderBy("epoch").collect()] == [True, True, False, False]
    assert report.training_curves(history).count() == 4
    shape = spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 2, 0 0), (1 1, 1 2, 2 1, 1 1))")], "region_id long, geometry string")
    io.write_geojson(shape, f"file://{tmp_path}/g", ["region_id"])
    feature = json.loads(spark.read.text(f"file://{tmp_path}/g").first()[0])
    assert len(feature["geometry"]["coordinates"]) == 2 and feature["properties"]["region_id"] == 1
    io.write_stats_json(hist.channel_stats(back, ["x"]), f"file://{tmp_path}/j")
    assert json.loads(spark.read.text(f"file://{tmp_path}/j").first()[0])["channel"] == "x"


def test_votes_where_each_source_matters(spark):
    one = pixels(spark, np.array([[1, 1, 0]]), "mask")
    two = pixels(spark, np.array([[0, 1, 1]]), "mask")
    votes = accuracy.union_masks({"a": one, "b": two, "c": two})
    got = raster(accuracy.ensemble_vote(votes, {"a": 1.0, "b": 1.0, "c": 1.0}), "mask", (1, 3))
    assert got.tolist() == [[0, 1, 1]]
    wide = one.withColumnRenamed("mask", "a").join(two.withColumnRenamed("mask", "b"), ["scene_id", "row", "col"])
    assert raster(wide.withColumn("m", accuracy.vote_columns({"a": 2.0, "b": 1.0})), "m", (1, 3)).tolist() == [[1, 1, 0]]
    missing = pixels(spark, np.array([[255, 255, 255]]), "mask")
    assert raster(accuracy.ensemble_vote(accuracy.union_masks({"a": one, "b": missing}), {"a": 1.0, "b": 2.0}), "mask", (1, 3)).sum() == 0


def test_models_on_separable_samples(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("s", i, 0, float(rng.normal(4 * (i % 2), 0.5)), float(rng.normal()), i % 2) for i in range(120)] + [("s", 999, 0, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "scene_id string, row int, col int, u double, v double, label int").cache()
    forest = ml.train_random_forest(df, ["u", "v"], trees=5, depth=4)
    made = ml.predict_map(forest, df, ["u", "v"])
    assert made.where("mask is null").count() == 1 and made.where("mask = label").count() >= 118
    assert ml.rank_importance(forest, ["u", "v"], spark).first().feature == "u"
    assert ml.permutation_importance(forest, df, ["u", "v"]).first().feature == "u"
    for train in (lambda s, f: ml.train_boosted_trees(s, f, rounds=3, depth=2), lambda s, f: ml.train_svm(s, f, width=32)):
        assert accuracy.confusion(train(df, ["u", "v"]).transform(A.valid_only(df, ["u", "v"])), "prediction", "label").selectExpr("tp + tn").first()[0] >= 110
    svm = ml.train_svm(df, ["u", "v"], width=32)
    svm.write().overwrite().save(f"file://{tmp_path}/svm")
    again = PipelineModel.load(f"file://{tmp_path}/svm")
    valid = A.valid_only(df, ["u", "v"])
    assert [r.prediction for r in again.transform(valid).orderBy("row").collect()] == [r.prediction for r in svm.transform(valid).orderBy("row").collect()]
    cv = ml.cross_validate_f1(df, ["u", "v"], lambda s, f: ml.train_random_forest(s, f, trees=3, depth=3), 2).first()
    assert cv.mean_f1 > 0.95
    folds = ml.stratified_folds(df, 5).groupBy("label", "fold").count().agg(F.max("count") - F.min("count")).first()[0]
    assert folds <= 1 and ml.hashed_folds(df).select("fold").distinct().count() == 5
    assert ml.sample_at(df, df.select("scene_id", "row", "col").limit(3)).count() == 3


def test_segmentation_loss_without_valid_pixels(spark):
    df = spark.createDataFrame([(0, 1.0, 255), (1, 800.0, 1), (1, -800.0, 0)], "batch int, logit double, ref int")
    got = {r.batch: r.loss for r in accuracy.segmentation_loss(df).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(0, abs=1e-9)


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    k = slices.keys_of(x)
    assert (np.diff(k) > 0).all() and np.array_equal(slices.values_of(k), x, equal_nan=True)


@pytest.mark.parametrize("large", [20, 10**5])
def test_percentiles_by_bit_slices(spark, large, monkeypatch):
    monkeypatch.setattr(slices, "LARGE", large)
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(-12, 3, 700), "close": 1 + rng.integers(0, 9, 500) * 2.0**-52, "ties": rng.integers(-3, 3, 300).astype(float), "one": np.full(90, 2.5), "wide": rng.normal(size=200) * 10.0 ** rng.integers(-200, 200, 200), "ends": np.array([-np.inf, -0.0, 0.0, np.inf] * 20), "small": rng.normal(size=7)}
    rows = [(g, None if i % 50 == 49 else float(v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("none", None)], "g string, x double").repartition(6)
    ps = [0, 3, 50, 90, 100]
    got = {(r.g, r.p): (r.value, r.n) for r in slices.percentiles(df, "x", ps, ["g"]).collect()}
    assert len(got) == len(groups) * len(ps)
    for g in groups:
        x = np.sort([v for k, v in rows if k == g and v is not None])
        for p in ps:
            at = p / 100 * (len(x) - 1)
            lo, hi = x[math.floor(at)], x[math.ceil(at)]
            want = lo if lo == hi else lo + (at - math.floor(at)) * (hi - lo)
            assert got[g, p][1] == len(x) and (got[g, p][0] == pytest.approx(want, rel=1e-12) or np.isnan(want)), (g, p)
    whole = np.array([v for _, v in rows if v is not None and np.isfinite(v)])
    assert slices.percentiles(df.where("abs(x) < double('inf')"), "x", [37.5]).first().value == pytest.approx(np.percentile(whole, 37.5), rel=1e-12)


def test_bit_slices_exchange_counts_not_values(spark, monkeypatch):
    monkeypatch.setattr(slices, "LARGE", 20)
    plans, plain = [], slices.snapshot
    monkeypatch.setattr(slices, "snapshot", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    df = spark.range(5000).selectExpr("'g' AS g", "sin(id) AS x")
    assert slices.percentiles(df, "x", [90], ["g"]).first().value == pytest.approx(float(np.percentile(np.sin(np.arange(5000)), 90)))
    passes = [p for name, p in plans if name == "slices"]
    exchanged = [line for p in passes for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len(passes) >= 2 and exchanged and not any("hashpartitioning(x" in line or ", x#" in line for line in exchanged)


def test_ranks_and_percentiles_of_a_group_over_many_ranges(spark):
    from rasterjobs.operators import ranked

    rng = np.random.default_rng(5)
    rows = [("big" if i % 10 else None, int(rng.integers(0, 50)), i) for i in range(400)]
    df = spark.createDataFrame([*rows, ("none", None, 400)], "g string, x int, i int")
    got = {(r.g, r.p): (r.value, r.n) for r in slices.percentiles(df, "x", [0, 37.5, 50, 100], ["g"]).collect()}
    for g in ("big", None):
        x = [r[1] for r in rows if r[0] == g]
        for p in (0, 37.5, 50, 100):
            assert got[g, p] == (pytest.approx(np.percentile(x, p)), len(x))
    assert len(got) == 8
    found = {r.i: r.k for r in ranked.row_numbers(df, ["g"], ["x", "i"], "k").collect()}
    for g in ("big", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        assert [found[r[2]] for r in order] == list(range(1, len(order) + 1))
    empty = slices.percentile_row(df.where("i < 0"), "x", {"a": 5}).first()
    assert empty.a is None


def test_folds_are_ranked_once_and_by_one_exchange_after_the_ranges(spark, monkeypatch):
    from rasterjobs.operators import ranked

    monkeypatch.setattr(ranked, "ONE_RANGE", 100)
    df = spark.range(1000).selectExpr("'s' AS scene_id", "cast(id AS int) AS row", "0 AS col", "cast(id % 4 = 0 AS int) AS label", "4e0 * (id % 4) + sin(id) AS u", "cos(id) AS v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rows were many
    try:
        plan = ml.stratified_folds(df, 3)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and sum("Exchange hashpartitioning" in line and "__range" in line for line in plan.splitlines()) == 1
        seen = []

        def train(rows, features):
            seen.append((rows._jdf.queryExecution().executedPlan().toString(), {r.row for r in rows.select("row").collect()}))
            return ml.train_random_forest(rows, features, trees=2, depth=2)

        assert ml.cross_validate_f1(df, ["u", "v"], train, 3).first().mean_f1 > 0.95
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(seen) == 3 and not any("Exchange" in p or "Window" in p for p, _ in seen)  # training only reads
    held = [set(range(1000)) - rows for _, rows in seen]
    assert set().union(*held) == set(range(1000)) and sum(map(len, held)) == 1000
    for label in (True, False):
        sizes = [sum((i % 4 == 0) == label for i in h) for h in held]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("tile", [4, 16])
def test_summed_areas_match_brute_force(spark, tile):
    rng = random.Random(tile)
    arrays = {"a": np.random.default_rng(1).integers(-9, 99, (19, 30)), "b": np.random.default_rng(2).integers(-9, 99, (6, 5)), "c": np.random.default_rng(3).integers(-9, 99, (33, 9))}
    df, keep = None, "not (scene_id = 'c' and (row between 8 and 20 or col < 4))"  # whole tiles are missing
    for name, a in arrays.items():
        one = pixels(spark, a, "x", name)
        df = one if df is None else df.unionByName(one)
    arrays["c"][8:21, :] = 0
    arrays["c"][:, :4] = 0
    tables = summed.SummedArea(df.where(keep).withColumn("none", F.lit(None).cast("int")), {"x": F.col("x"), "one": F.lit(1), "none": F.col("none")}, tile)
    boxes = []
    for i in range(150):
        r, c = rng.randrange(-4, 36), rng.randrange(-4, 33)
        boxes.append((i, "abc"[i % 3], r, c, r + rng.randrange(-1, 40), c + rng.randrange(-1, 40)))
    cut = lambda a, r0, c0, r1, c1: a[max(r0, 0) : max(r1, 0), max(c0, 0) : max(c1, 0)]
    kinds = "i int, scene_id string, r0 int, c0 int, r1 int, c1 int"
    got = {(r.i, r.scene_id): (r.x, r.none) for r in tables.sums(spark.createDataFrame(boxes, kinds), "i").collect()}
    assert got == {(i, s): (int(cut(arrays[s], *b).sum()), 0) for i, s, *b in boxes}
    every = {(r.i, r.scene_id): r.one for r in tables.sums(spark.createDataFrame(boxes, kinds).drop("scene_id"), "i").collect()}
    assert len(every) == 450 and all(every[i, s] == cut(arrays[s] * 0 + 1, *b).size for i, s, *b in boxes if s != "c")


def test_random_patches_keep_their_flood_quota(spark):
    mask = np.zeros((60, 50), int)
    mask[20:26, 30:40] = 1
    mask[:, :8] = 255
    df = pixels(spark, mask, "mask")
    tables = patches.summed_masks(df, tile=16)
    out = {r.patch_id: r for r in patches.random_flood_patches(tables, 60, 50, 8, 40, quota=0.5, min_flood=0.3, max_nodata=0.25).collect()}
    draws = [(r.patch_id, r.r0, r.c0) for r in patches.random_patches(spark, 60, 50, 8, 64 * 40).orderBy("patch_id").collect()]
    cut = lambda r, c: mask[r : r + 8, c : c + 8]
    good = [(i, (cut(r, c) == 1).mean()) for i, r, c in draws if (cut(r, c) == 255).mean() <= 0.25]
    wet = [i for i, share in good if share >= 0.3][:20]
    assert set(out) == set(wet) | set([i for i, _ in good if i not in wet][:20]) and len(out) == 40
    assert all(out[i].flood_ratio == pytest.approx(share) for i, share in good if i in out)
    some = patches.patch_extract(df, spark.createDataFrame([(i, r, c, 8) for i, r, c in draws[:50]], "patch_id int, r0 int, c0 int, size int"), 8)
    want = {r.patch_id: (r.valid_ratio, r.flood_ratio) for r in patches.patch_stats(some).collect()}
    got = {r.patch_id: (r.valid_ratio, r.flood_ratio) for r in patches.patch_ratios(tables, patches.random_patches(spark, 60, 50, 8, 50)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert patches.random_flood_patches(tables, 60, 50, 8, 5, quota=1.0, min_flood=0.99, most=40).count() == 0  # fewer, if there are none


def shapley_by_hand(nodes, weight, x, regress):
    """Shapley values of one tree by all subsets of features; unknown features follow the training weight."""
    from itertools import combinations

    cover = {i: n["impurityStats"][0] if regress else sum(n["impurityStats"]) for i, n in nodes.items()}

    def expected(known, i=0):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["prediction"] if regress else n["impurityStats"][1] / cover[i]
        a, b = n["leftChild"], n["rightChild"]
        f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return expected(known, a if x[f] <= at else b)
        return (cover[a] * expected(known, a) + cover[b] * expected(known, b)) / cover[i]

    m, value = len(x), {}
    for k in range(m + 1):
        for subset in combinations(range(m), k):
            value[subset] = expected(set(subset))
    out = [weight * value[()]]
    for f in range(m):
        rest = [g for g in range(m) if g != f]
        total = 0.0
        for k in range(m):
            for subset in combinations(rest, k):
                total += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value[tuple(sorted((*subset, f)))] - value[subset])
        out.append(weight * total)
    return np.array(out)


def test_contributions_equal_all_subsets_of_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contributions, "AT_ONCE", 5000)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    y = (x[:, 0] + x[:, 1] * x[:, 2] - np.abs(x[:, 3]) + 0.3 * x[:, 4] > 0).astype(int)
    names = [f"f{i}" for i in range(8)]
    rows = [("s", i, 0, int(y[i]), *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "scene_id string, row int, col int, label int, " + ", ".join(f"{n} double" for n in names))
    few = df.where("row < 6").unionByName(df.where("row = 7").withColumn("f3", F.lit(None).cast("double")))
    for regress, model in ((False, ml.train_random_forest(df, names, trees=4, depth=6)), (True, ml.train_boosted_trees(df, names, rounds=4, rate=0.3, depth=4))):
        got = {r.row: r for r in contributions.contributions(model, few.withColumn("base", F.lit("gone")), names).collect()}
        assert len(got) == 7 and got[7].base is None and got[7].phi_f0 is None
        last = model.stages[-1]
        last.save(f"file://{tmp_path}/{regress}")
        trees = {}
        for r in spark.read.parquet(f"file://{tmp_path}/{regress}/data").select("treeID", "nodeData.*").collect():
            trees.setdefault(r.treeID, {})[r.id] = r.asDict(recursive=True)
        weights = last.treeWeights if regress else [0.25] * 4
        for i in range(6):
            want = sum(shapley_by_hand(nodes, weights[k], x[i], regress) for k, nodes in trees.items())
            assert np.allclose([got[i].base, *(got[i][f"phi_{n}"] for n in names)], want, atol=1e-12)
        whole = contributions.contributions(model, df, names)
        made = {r.row: r.base + sum(r[f"phi_{n}"] for n in names) for r in whole.collect()}
        said = {r.row: float(r.rawPrediction[1]) if regress else float(r.probability[1]) for r in model.transform(df).collect()}
        assert all(made[i] == pytest.approx(said[i], abs=1e-9) for i in said)
        ranked = contributions.mean_contributions(whole, names).collect()
        assert {r.feature for r in ranked[:3]} <= {"f0", "f1", "f2", "f3", "f4"} and [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)


def test_morton_keys_and_ranges_of_windows(spark):
    rng = random.Random(3)
    cells = [(rng.randrange(2**k), rng.randrange(2**k)) for k in (1, 4, 9, 20, 31) for _ in range(20)]
    got = spark.createDataFrame(cells, "row long, col long").select("row", "col", morton.morton(F.col("row"), F.col("col")).alias("z")).collect()
    assert all(r.z == morton.number(r.row, r.col) and r.z >= 0 for r in got)
    z = np.array([[morton.number(r, c) for c in range(70)] for r in range(70)])
    for _ in range(60):
        r, c, h, w, most = rng.randrange(60), rng.randrange(60), rng.randrange(1, 64), rng.randrange(1, 64), rng.choice([1, 3, 24, 10**6])
        found = morton.window_ranges(r, r + h, c, c + w, most)
        inside = np.zeros(z.shape, bool)
        for a, b in found:
            inside |= (z >= a) & (z <= b)
        assert inside[r : r + h, c : c + w].all() and len(found) <= most and all(p[1] < q[0] for p, q in zip(found, found[1:], strict=False))
        if most == 10**6 and min(h, w) < 32:
            assert inside.sum() == min(h, 70 - r) * min(w, 70 - c)  # exact where quadrants split to cells
    assert morton.window_ranges(5, 5, 0, 9) == [] and morton.window_ranges(-4, 1, -3, 1) == [(0, 0)]


def test_a_window_reads_row_groups_by_its_area(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    side, path = 1024, f"file://{tmp_path}/z"
    df = spark.range(side * side).selectExpr("'s' AS scene_id", f"cast(id div {side} AS int) AS row", f"cast(id % {side} AS int) AS col", "rand(1) AS x")
    io.write_pixels(df, path, ["x"], group_bytes=1 << 18)
    groups = [(g.column(k), g.num_rows) for f in glob.glob(f"{tmp_path}/z/scene_id=s/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(i) for i in range(m.num_row_groups)] for k in range(g.num_columns) if g.column(k).path_in_schema == "zkey"]
    assert len(groups) > 20
    r, c, n = 300, 700, 64  # 1/256 of the cells; a strip of rows has 1/16
    wanted = morton.window_ranges(r, r + n, c, c + n)
    met = sum(rows for k, rows in groups if any(a <= k.statistics.max and b >= k.statistics.min for a, b in wanted))
    window = io.read_window(spark, path, ["x"], r, c, n, n)
    assert window.count() == n * n and window.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()[:] == (r, r + n - 1, c, c + n - 1)
    window.collect()
    plan = window._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    # what the scan hands on after pruning row groups and pages: far less than the strip of rows of the window
    assert n * n <= read <= met < side * side / 16 and "zkey" in plan.toString()


def test_best_checkpoint_over_many_ranges(spark):
    from rasterjobs.operators.accuracy import best_checkpoint

    scores = [None if i % 7 == 3 else float(i * 37 % 101) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(scores)), "epoch int, iou double")
    best = None
    for r in best_checkpoint(df).orderBy("epoch").collect():
        assert r.improved == (r.iou is not None and (best is None or r.iou > best))
        best = r.iou if best is None else best if r.iou is None else max(best, r.iou)
        assert r.best == best


def test_the_shared_folder_is_empty_when_a_session_has_ended(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from rasterjobs.operators import regions
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
df = spark.range(400).selectExpr("'s' AS scene_id", "cast(id div 20 AS int) AS row", "cast(id % 20 AS int) AS col", "cast(id % 3 > 0 AS int) AS mask")
import os
assert regions.connected_regions(df, tile=4).count() > 0 and [x[:11] for x in os.listdir("{tmp_path}") if x[0] == "r"] == ["rasterjobs-"]
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=regions.__file__.rsplit("/", 3)[0], timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [f for f in tmp_path.rglob("*") if f.is_file()] and not list(tmp_path.glob("rasterjobs-*"))  # Spark's own folder for checkpoints is empty
