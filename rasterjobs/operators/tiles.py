"""Halo tiles: one exchange deals every pixel to its tile and to the tiles whose border reaches it.

A tile of TILE x TILE cells comes with a border of ``halo`` cells, as wide as all windows of a chain together, so a chain of
filters needs no other exchange. Shipped rows grow by (1 + 2 halo / TILE)^2: 1.05 for a halo of 3, 1.20 for 12. A task
holds one tile at a time: its rows, and per column in work an array of (TILE + 2 halo)^2 doubles, 0.6 MB for 256 and 12.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterjobs.runtime import ship

TILE = 256


def grid_sizes(df: DataFrame) -> DataFrame:
    """``(scene_id, height, width)`` of dense grids: one row per scene."""
    return df.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def fold(p: np.ndarray, n: int) -> np.ndarray:
    """Places beyond 0 .. n - 1 mirrored back (d c b a | a b c d | d c b a), as often as it takes."""
    p = p % (2 * n)
    return np.where(p < n, p, 2 * n - 1 - p)


class Tile:
    """A tile's cells with its border. NaN is a missing value; ``there`` marks cells that the table has."""

    def __init__(self, top: int, left: int, side: int, height: int, width: int, at: np.ndarray, columns: dict[str, np.ndarray]):
        self.shape, self.at = (side, side), at
        self._rows, self._cols = (np.clip(fold(np.arange(a, a + side), n) - a, 0, side - 1) for a, n in ((top, height), (left, width)))
        self._columns = columns
        there = np.zeros(side * side, bool)
        there[at] = True
        self.there = there.reshape(self.shape)

    def cells(self, name: str) -> np.ndarray:
        a = np.full(self.shape[0] * self.shape[1], np.nan)
        a[self.at] = self._columns[name]
        return a.reshape(self.shape)

    def mirrored(self, a: np.ndarray) -> np.ndarray:
        """``a`` with cells beyond the scene's edges mirrored."""
        return a[self._rows][:, self._cols]


def dealt(df: DataFrame, halo: int, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """A row per pixel and tile that needs it: ``__r``, ``__c`` (the tile), ``__own`` (the pixel lies in it), ``__height``, ``__width``.

    ``sizes`` has one row per scene beside its millions of pixels. Rows without a place in the grid are left out.
    """
    size = sizes.select("scene_id", F.col("height").alias("__height"), F.col("width").alias("__width"))
    wide = df.where("row >= 0 and col >= 0").join(F.broadcast(size), "scene_id")

    def tiles(axis: str, n: str):
        last = F.floor((F.col(n) - 1) / tile)
        low, high = F.greatest(F.floor((F.col(axis) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(axis) + halo) / tile), last)
        return F.sequence(low.cast("int"), high.cast("int"))

    both = F.flatten(F.transform(tiles("row", "__height"), lambda r: F.transform(tiles("col", "__width"), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    spread = wide.withColumn("__t", F.explode(both)).withColumns({"__r": F.col("__t.r"), "__c": F.col("__t.c")}).drop("__t")
    return spread.withColumn("__own", (F.col("__r") == F.floor(F.col("row") / tile)) & (F.col("__c") == F.floor(F.col("col") / tile)))


def over_tiles(df: DataFrame, reads: list[str], writes: dict[str, str], halo: int, work: Callable[[Tile], dict[str, np.ndarray]], sizes: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """``df`` with the columns ``writes`` (name: type) that ``work`` makes of each tile, in one exchange of pixels.

    ``work`` sees ``reads`` with a border of ``halo`` cells and returns arrays of the tile's shape, whose border is not
    used; NaN becomes NULL. Other columns pass through, except that neighbours get none of them. A written column that ``df`` has gives way.
    ``sizes`` are found from ``df`` if not given, by one aggregate with a row per scene.
    """
    ship(df.sparkSession)
    sizes = grid_sizes(df) if sizes is None else sizes
    names = [c for c in df.columns if c not in writes]
    passing = [c for c in names if c not in ("scene_id", "row", "col")]
    rows = dealt(df.select("scene_id", "row", "col", *[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(passing)], *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(reads)]), halo, sizes, tile)
    rows = rows.withColumns({f"__p{i}": F.when(F.col("__own"), F.col(f"__p{i}")) for i in range(len(passing))})
    side = tile + 2 * halo
    kept = ["scene_id", "row", "col", *[f"__p{i}" for i in range(len(passing))]]
    kinds = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in kept] + [T.StructField(f"__w{i}", T.DoubleType()) for i in range(len(writes))])

    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("__r", "__c", "__height", "__width")}
        top, left = first["__r"] * tile - halo, first["__c"] * tile - halo
        place = (table.column("row").to_numpy().astype(np.int64) - top) * side + table.column("col").to_numpy().astype(np.int64) - left
        columns = {c: table.column(f"__x{i}").to_numpy() for i, c in enumerate(reads)}
        own = table.column("__own").to_numpy(zero_copy_only=False)
        out = table.filter(pa.array(own)).select(kept)
        if out.num_rows:
            made = work(Tile(top, left, side, first["__height"], first["__width"], place, columns))
        for i, name in enumerate(writes):
            x = made[name].reshape(-1)[place[own]].astype(np.float64) if out.num_rows else np.zeros(0)
            out = out.append_column(f"__w{i}", pa.array(x, pa.float64(), mask=np.isnan(x)))
        return out

    made = rows.groupBy("scene_id", "__r", "__c").applyInArrow(run, kinds)
    back = {c: F.col(f"__p{i}") for i, c in enumerate(passing)} | {c: F.col(c) for c in ("scene_id", "row", "col")} | {c: F.col(f"__w{i}").cast(kind) for i, (c, kind) in enumerate(writes.items())}
    order = [*df.columns, *[c for c in writes if c not in df.columns]]
    return made.select(*[back[c].alias(c) for c in order])
