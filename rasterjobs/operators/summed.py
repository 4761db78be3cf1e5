"""Summed-area tables of pixel grids: the sum over any box is four lookups, whatever its size.

A tile keeps the two-dimensional prefix sums of its own cells. What lies above and to the left of it is carried along tile columns
and tile rows as vectors as long as a tile's side, so building exchanges each pixel once and 1/128 of that again, and a group
is a tile or a scene's side. Sums are 64-bit integers, exact in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterjobs.operators.tiles import TILE, dealt, grid_sizes
from rasterjobs.runtime import drop, ship, snapshot


def _vectors(blobs: pd.Series, n: int) -> list[np.ndarray]:
    return [np.zeros(n, np.int64) if b is None else np.frombuffer(b, np.int64) for b in blobs]


class SummedArea:
    """Integer ``columns`` (name: value, null counts as 0) of all scenes of ``df``, summed from each scene's first cell on."""

    def __init__(self, df: DataFrame, columns: dict[str, Column], tile: int = TILE):
        ship(df.sparkSession)
        self.names, self.tile = list(columns), tile
        key = ["scene_id", "r", "c"]
        self.sizes = snapshot(grid_sizes(df.where("row >= 0 and col >= 0")), "sizes")
        rows = dealt(df.select("scene_id", "row", "col", *[F.coalesce(v.cast("long"), F.lit(0)).alias(f"v{i}") for i, v in enumerate(columns.values())]), 0, self.sizes, tile)
        m, scene = len(columns), df.schema["scene_id"]
        scene_kind = to_arrow_type(scene.dataType)
        places = [scene, T.StructField("r", T.LongType()), T.StructField("c", T.LongType())]
        blob = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]

        def sums(table: pa.Table) -> pa.Table:
            first = {c: table.column(c)[0].as_py() for c in ("scene_id", "__r", "__c")}
            r, c = (table.column(x).to_numpy().astype(np.int64) - first[t] * tile for x, t in (("row", "__r"), ("col", "__c")))
            a = np.zeros((m, tile, tile), np.int64)
            for i in range(m):
                np.add.at(a[i], (r, c), table.column(f"v{i}").to_numpy())
            a = a.cumsum(axis=1).cumsum(axis=2)
            parts = [np.ascontiguousarray(x).tobytes() for x in (a, a[:, -1, :], a[:, :, -1])]
            return pa.table([pa.array([first["scene_id"]], scene_kind), pa.array([first["__r"]], pa.int64()), pa.array([first["__c"]], pa.int64()), *[pa.array([b], pa.binary()) for b in parts]], [*key, "prefix", "bottom", "right"])

        tiles = snapshot(rows.groupBy("scene_id", "__r", "__c").applyInArrow(sums, T.StructType([*places, *blob("prefix", "bottom", "right")])), "tiles")
        edges = tiles.drop("prefix").join(F.broadcast(self.sizes), "scene_id")  # a row per scene beside its tiles

        def carried(vectors: dict[int, np.ndarray], n: int, width: int) -> list[np.ndarray]:
            """Of n places in a row, what those before each sum to."""
            out, total = [], np.zeros(width, np.int64)
            for k in range(n):
                out.append(total)
                total = total + vectors.get(k, 0)
            return out

        def down(pdf: pd.DataFrame) -> pd.DataFrame:
            n = -(-int(pdf["height"].iloc[0]) // tile)
            at = pdf["r"].to_list()
            above = carried(dict(zip(at, _vectors(pdf["bottom"], m * tile), strict=True)), n, m * tile)
            right = dict(zip(at, pdf["right"], strict=True))
            return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "r": range(n), "c": pdf["c"].iloc[0], "above": [v.tobytes() for v in above], "right": [right.get(k) for k in range(n)], "width": pdf["width"].iloc[0]})

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            n = -(-int(pdf["width"].iloc[0]) // tile)
            at = pdf["c"].to_list()
            above = dict(zip(at, _vectors(pdf["above"], m * tile), strict=True))
            left = carried(dict(zip(at, _vectors(pdf["right"], m * tile), strict=True)), n, m * tile)
            corner = carried({k: v.reshape(m, tile)[:, -1] for k, v in above.items()}, n, m)
            up = [above.get(k, np.zeros(m * tile, np.int64)).reshape(m, tile) + corner[k][:, None] for k in range(n)]
            return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "r": pdf["r"].iloc[0], "c": range(n), "above": [v.tobytes() for v in up], "left": [v.tobytes() for v in left]})

        number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
        columns_ = edges.select(*key, "bottom", "right", "height", "width").groupBy("scene_id", "c").applyInPandas(down, T.StructType([*places, *blob("above", "right"), *number("width")]))
        frame = columns_.groupBy("scene_id", "r").applyInPandas(across, T.StructType([*places, *blob("above", "left")]))
        self.tiles = snapshot(frame.join(tiles.select(*key, "prefix"), key, "left"), "summed")
        drop(tiles)

    def drop(self) -> None:
        drop(self.tiles, self.sizes)

    def sums(self, boxes: DataFrame, box: str = "box_id") -> DataFrame:
        """``(box, scene_id, columns...)``: sums over rows r0 .. r1 - 1 and columns c0 .. c1 - 1 of each of ``boxes`` (box, r0, c0, r1, c1).

        Boxes with a scene_id are of that scene, others of every scene, and what lies outside the grid is empty. Each
        corner meets its tile by equality.
        """
        tile, names, m = self.tile, self.names, len(self.names)
        size = F.broadcast(self.sizes.withColumnsRenamed({"height": "__h", "width": "__w"}))  # a row per scene
        placed = boxes.join(size, "scene_id") if "scene_id" in boxes.columns else boxes.crossJoin(size)
        at = lambda x, most: F.least(F.greatest(F.col(x).cast("long"), F.lit(0)), F.col(most).cast("long")) - 1
        corner = lambda sign, r, c: F.struct(F.lit(sign).alias("sign"), at(r, "__h").alias("row"), at(c, "__w").alias("col"))
        four = F.array(corner(1, "r1", "c1"), corner(-1, "r0", "c1"), corner(-1, "r1", "c0"), corner(1, "r0", "c0"))
        asked = placed.where("r1 > r0 and c1 > c0").select(F.col(box).alias("box"), "scene_id", F.explode(four).alias("x")).select("box", "scene_id", "x.*").where("row >= 0 and col >= 0")
        asked = asked.withColumns({"r": F.floor(F.col("row") / tile), "c": F.floor(F.col("col") / tile)})
        kinds = T.StructType([asked.schema["box"], asked.schema["scene_id"], *[T.StructField(f"v{i}", T.LongType()) for i in range(m)]])

        def look(tiles: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = asked[["box", "scene_id"]].copy()
            if not len(tiles) or not len(asked):
                return out.iloc[:0].assign(**{f"v{i}": pd.Series(dtype="int64") for i in range(m)})
            above, left = (np.frombuffer(tiles[x].iloc[0], np.int64).reshape(m, tile) for x in ("above", "left"))
            prefix = tiles["prefix"].iloc[0]
            r, c = (asked[x].to_numpy(np.int64) % tile for x in ("row", "col"))
            sign = asked["sign"].to_numpy(np.int64)
            for i in range(m):
                own = np.frombuffer(prefix, np.int64).reshape(m, tile, tile)[i, r, c] if prefix is not None else 0
                out[f"v{i}"] = sign * (own + above[i, c] + left[i, r])
            return out

        key = ["scene_id", "r", "c"]
        found = self.tiles.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(look, kinds)
        got = found.groupBy("box", "scene_id").agg(*[F.sum(f"v{i}").alias(f"__v{i}") for i in range(m)])
        whole = placed.select(F.col(box).alias("box"), "scene_id").join(got, ["box", "scene_id"], "left")
        return whole.select(F.col("box").alias(box), "scene_id", *[F.coalesce(f"__v{i}", F.lit(0)).cast("long").alias(name) for i, name in enumerate(names)])
