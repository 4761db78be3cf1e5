"""Moving windows on dense pixel grids: chains of filters on halo tiles, each chain in one exchange of pixels.

Sums run along rows, then columns, as differences of prefix sums of values less their tile's mean, so little cancels;
extrema take two passes (running from each block's both ends), whatever the window. A missing value is NULL or NaN.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from rasterjobs.operators.tiles import Tile, grid_sizes, over_tiles

__all__ = ["box_mean", "closing", "dilate", "erode", "gaussian_smooth", "grid_sizes", "lee_filter", "local_stats", "open_close", "opening"]


def window_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over (2k + 1) x (2k + 1) cells; the k outermost cells of the result have no meaning."""
    for axis in (0, 1):
        total = np.insert(np.cumsum(a, axis=axis), 0, 0, axis=axis)
        n = a.shape[axis]
        place = np.arange(n)
        a = total.take(np.minimum(place + k + 1, n), axis=axis) - total.take(np.maximum(place - k, 0), axis=axis)
    return a


def window_extremes(a: np.ndarray, k: int, least: bool) -> np.ndarray:
    """The least (or greatest) of (2k + 1) x (2k + 1) cells; the k outermost cells of the result have no meaning."""
    f, w = np.minimum if least else np.maximum, 2 * k + 1
    for _ in range(2):  # along rows, then on the transposed array
        n = a.shape[1]
        more = -n % w
        blocks = np.pad(a, ((0, 0), (0, more)), mode="edge").reshape(len(a), -1, w)
        ahead = f.accumulate(blocks, axis=2).reshape(len(a), -1)
        back = f.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(a), -1)
        place = np.arange(n)
        a = f(back[:, np.maximum(place - k, 0)], ahead[:, np.minimum(place + k, n - 1)]).T
    return a


def window_convolution(a: np.ndarray, w: list[float]) -> np.ndarray:
    """Rows, then columns weighted by ``w``; the outermost cells of the result have no meaning."""
    k = len(w) // 2
    for _ in range(2):
        wide = np.pad(a, ((0, 0), (k, k)), mode="edge")
        a = sum(v * wide[:, i : i + a.shape[1]] for i, v in enumerate(w)).T
    return a


def moments(x: np.ndarray, size: int, valid_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance cut at 0) of size x size cells; missing ones count as 0 and in the divisor, unless ``valid_only``."""
    k, known = size // 2, ~np.isnan(x)
    middle = float(x[known].mean()) if known.any() else 0.0
    if valid_only:
        away, n = np.where(known, x - middle, 0.0), np.rint(window_sums(known.astype(np.float64), k))
        with np.errstate(invalid="ignore", divide="ignore"):
            n = np.where(n > 0, n, np.nan)
    else:
        away, n = np.where(known, x, 0.0) - middle, float(size * size)
    m = window_sums(away, k) / n
    return m + middle, np.maximum(window_sums(away * away, k) / n - m * m, 0.0)


def lee(x: np.ndarray, size: int, enl: float) -> np.ndarray:
    m, variance = moments(x, size)
    return m + variance / (variance + m * m / enl + 1e-10) * (x - m)


def box_mean(df: DataFrame, x: str, size: int = 7, out: str = "mean", valid_only: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Moving mean; missing cells count as 0 and in the divisor, unless ``valid_only``. Borders are mirrored."""
    return over_tiles(df, [x], {out: "double"}, size // 2, lambda t: {out: moments(t.mirrored(t.cells(x)), size, valid_only)[0]}, sizes)


def local_stats(df: DataFrame, x: str, size: int = 7, valid_only: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``local_mean`` and ``local_std``; the variance is cut at 0."""

    def work(t: Tile) -> dict[str, np.ndarray]:
        m, variance = moments(t.mirrored(t.cells(x)), size, valid_only)
        return {"local_mean": m, "local_std": np.sqrt(variance)}

    return over_tiles(df, [x], {"local_mean": "double", "local_std": "double"}, size // 2, work, sizes)


def lee_filter(df: DataFrame, x: str, size: int = 7, enl: float = 2.0, out: str = "filtered", sizes: DataFrame | None = None) -> DataFrame:
    """Speckle filter: the cell is drawn to its local mean by the share of variance that speckle explains; missing stays missing."""
    return lee_filters(df, {out: x}, size, enl, sizes)


def lee_filters(df: DataFrame, columns: dict[str, str], size: int = 7, enl: float = 2.0, sizes: DataFrame | None = None) -> DataFrame:
    """:func:`lee_filter` of several ``columns`` (result: source) on the same tiles."""
    reads = list(dict.fromkeys(columns.values()))
    return over_tiles(df, reads, dict.fromkeys(columns, "double"), size // 2, lambda t: {c: lee(t.mirrored(t.cells(x)), size, enl) for c, x in columns.items()}, sizes)


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def gaussian_smooth(df: DataFrame, x: str, sigma: float = 3.0, out: str = "smooth", sizes: DataFrame | None = None) -> DataFrame:
    """Separable Gaussian with mirrored borders; missing where the window has a missing cell."""
    w = gaussian_weights(sigma)
    return over_tiles(df, [x], {out: "double"}, len(w) // 2, lambda t: {out: window_convolution(t.mirrored(t.cells(x)), w)}, sizes)


def _morphology(df: DataFrame, mask: str, steps: list[tuple[int, bool]], sizes: DataFrame | None) -> DataFrame:
    """``steps`` of (window, erode); cells that the table doesn't have are 0 at every step."""

    def work(t: Tile) -> dict[str, np.ndarray]:
        a = t.cells(mask) == 1
        for size, erodes in steps:
            a = window_extremes(a, size // 2, erodes) & t.there
        return {mask: a}

    return over_tiles(df, [mask], {mask: "int"}, sum(size // 2 for size, _ in steps), work, sizes)


def erode(df: DataFrame, size: int, mask: str = "mask", sizes: DataFrame | None = None) -> DataFrame:
    """All cells of the size x size window must be 1; cells outside the grid are 0."""
    return _morphology(df, mask, [(size, True)], sizes)


def dilate(df: DataFrame, size: int, mask: str = "mask", sizes: DataFrame | None = None) -> DataFrame:
    return _morphology(df, mask, [(size, False)], sizes)


def opening(df: DataFrame, size: int = 3, mask: str = "mask", sizes: DataFrame | None = None) -> DataFrame:
    return _morphology(df, mask, [(size, True), (size, False)], sizes)


def closing(df: DataFrame, size: int = 5, mask: str = "mask", sizes: DataFrame | None = None) -> DataFrame:
    return _morphology(df, mask, [(size, False), (size, True)], sizes)


def open_close(df: DataFrame, open_size: int = 3, close_size: int = 5, mask: str = "mask", sizes: DataFrame | None = None) -> DataFrame:
    """Opening, then closing, on one set of tiles."""
    return _morphology(df, mask, [(open_size, True), (open_size, False), (close_size, False), (close_size, True)], sizes)
