"""Outlines of regions: chains of cell sides inside tiles, put in order across tiles by pointer jumping.

A side of a cell that faces no cell is a directed edge with the region on its left. Which edge follows depends on the two
cells ahead alone, so a tile with a border of one cell knows the successor of each of its edges; its edges form closed rings
and open chains, which end where a neighbouring tile's chain begins. Open chains become rings by list ranking: every round
doubles how far each of them sees, so rounds are the logarithm of a ring's chains. A group is a tile, or the chains of a
ring, never its corners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterjobs.operators.tiles import TILE, dealt, grid_sizes
from rasterjobs.runtime import drop, ship, snapshot

#: Corners and cells are numbered row * STRIDE + col; rows must be below 2^30.
STRIDE = 1 << 31
#: Top, left, bottom, right: walked west, south, east, north. (Cell ahead on the left, cell ahead on the right, corner at the end), as (row, col) steps.
_LEFT, _RIGHT, _END = ((0, -1), (1, 0), (0, 1), (-1, 0)), ((-1, -1), (1, -1), (1, 1), (-1, 1)), ((0, 0), (1, 0), (1, 1), (0, 1))
_FACES = ((-1, 0), (0, -1), (1, 0), (0, 1))


def edges_of(there: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, col, side, and the row, col, side that follow) of all edges of ``own`` cells; ``there`` marks cells, with a border of one around all own ones."""
    rows, cols = np.nonzero(own)
    out = []
    for side in range(4):
        look = lambda r, c, step: there[r + step[0], c + step[1]]
        open_ = ~look(rows, cols, _FACES[side])
        r, c = rows[open_], cols[open_]
        left, right = look(r, c, _LEFT[side]), look(r, c, _RIGHT[side])
        step = np.where(left[:, None], np.where(right[:, None], _RIGHT[side], _LEFT[side]), 0)  # where cells meet in a corner only, the edge stays with its cell
        turn = np.where(left, np.where(right, 3, 0), 1)
        out.append((r, c, np.full(len(r), side), r + step[:, 0], c + step[:, 1], (side + turn) % 4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chains(at: np.ndarray, then: np.ndarray) -> list[tuple[list[int], bool]]:
    """(places of the edges in order, closed) of all chains of edges numbered ``at``, each followed by number ``then``."""
    order = np.argsort(at)
    there = order[np.minimum(np.searchsorted(at, then, sorter=order), len(at) - 1)]
    follows = np.where(at[there] == then, there, -1)
    first = np.ones(len(at), bool)
    first[follows[follows >= 0]] = False
    follow, seen, out = follows.tolist(), bytearray(len(at)), []
    for closed, starts in ((False, np.flatnonzero(first).tolist()), (True, order.tolist())):
        for k in starts:
            chain = []
            while k >= 0 and not seen[k]:
                seen[k] = 1
                chain.append(k)
                k = follow[k]
            if chain:
                out.append((chain, closed))
    return out


def _pieces(regions: DataFrame, world: tuple[float, float, float, float], tile: int) -> DataFrame:
    """Chains by tile: ``piece`` and ``next`` (numbers of first edges; null if closed), ``low`` (smallest corner), its text ``first``, ``turn`` (part of the signed area), texts of corners before (``head``) and from (``tail``) the smallest."""
    x0, dx, y0, dy = world
    rows = dealt(regions.select("scene_id", "row", "col", F.col("region_id").cast("long").alias("region_id")), 1, grid_sizes(regions), tile)
    kinds = T.StructType([regions.schema["scene_id"], *[T.StructField(c, T.LongType()) for c in ("region_id", "piece", "next", "low", "turn")], *[T.StructField(c, T.StringType()) for c in ("first", "head", "tail")]])
    scene_kind, side = to_arrow_type(regions.schema["scene_id"].dataType), tile + 2

    def run(table: pa.Table) -> pa.Table:
        top, left = table.column("__r")[0].as_py() * tile - 1, table.column("__c")[0].as_py() * tile - 1
        r, c = table.column("row").to_numpy().astype(np.int64) - top, table.column("col").to_numpy().astype(np.int64) - left
        there, own, region = np.zeros((side, side), bool), np.zeros((side, side), bool), np.zeros((side, side), np.int64)
        there[r, c], own[r, c], region[r, c] = True, table.column("__own").to_numpy(zero_copy_only=False), table.column("region_id").to_numpy()
        out: list[tuple] = []
        if own.any():
            r, c, s, r2, c2, s2 = edges_of(there, own)
            number = lambda r, c, s: ((r + top) * STRIDE + c + left) * 4 + s
            at, then, end = number(r, c, s), number(r2, c2, s2), np.array(_END)[s]
            corner, row, col = s != s2, r + end[:, 0] + top, c + end[:, 1] + left
            low, turn = np.where(corner, row * STRIDE + col, np.iinfo(np.int64).max), np.where(s == 1, -(c + left), np.where(s == 3, c + left + 1, 0))
            for chain, closed in chains(at, then):
                k = np.array(chain)
                bends = k[corner[k]]
                texts = [f"{x0 + b * dx:.10g} {y0 + a * dy:.10g}" for a, b in zip(row[bends].tolist(), col[bends].tolist(), strict=True)]
                m = int(low[bends].argmin()) if len(bends) else 0
                out.append((int(region[r[k[0]], c[k[0]]]), int(at[k[0]]), None if closed else int(then[k[-1]]), int(low[bends[m]]) if texts else None, int(turn[k].sum()), texts[m] if texts else None, ", ".join(texts[:m]) or None, ", ".join(texts[m:]) or None))
        scene = pa.array([table.column("scene_id")[0].as_py()] * len(out), scene_kind)
        cols = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([scene, *[pa.array(x, pa.int64() if i < 5 else pa.string()) for i, x in enumerate(cols)]], kinds.names)

    return rows.groupBy("scene_id", "__r", "__c").applyInArrow(run, kinds)


def _ranked(open_: DataFrame) -> DataFrame:
    """``(scene_id, piece, ring, steps)`` of open chains: the smallest corner of their ring, and how many chains come from this one on until the ring's first, which holds that corner."""
    jump = lambda df: df.select("scene_id", F.col("piece").alias("jump"), *[F.col(c).alias(f"__{c}") for c in df.columns if c not in ("scene_id", "piece")])
    far = F.lit((1 << 63) - 1)
    now = snapshot(open_.select("scene_id", "piece", F.col("next").alias("jump"), F.coalesce("low", far).alias("ring"), F.lit(True).alias("new")), "rings")
    while now.where("new").limit(1).count():  # a window of twice as many chains from round to round
        then = now.join(jump(now), ["scene_id", "jump"]).select("scene_id", "piece", F.col("__jump").alias("jump"), F.least("ring", "__ring").alias("ring"), (F.col("__ring") < F.col("ring")).alias("new"))
        before, now = now, snapshot(then, "rings")
        drop(before)
    rings = now.select("scene_id", "piece", "ring")
    own = open_.select("scene_id", "piece", "next", "low").join(rings, ["scene_id", "piece"])
    heads = own.where("low = ring").select("scene_id", F.col("piece").alias("next"), F.lit(True).alias("__head"))
    ahead = snapshot(own.join(heads, ["scene_id", "next"], "left").select("scene_id", "piece", "ring", F.when(F.col("__head").isNull(), F.col("next")).alias("jump"), F.lit(1).cast("long").alias("steps")), "steps")
    while ahead.where("jump is not null").limit(1).count():
        further = ahead.join(jump(ahead.select("scene_id", "piece", "jump", "steps")), ["scene_id", "jump"], "left")
        before, ahead = ahead, snapshot(further.select("scene_id", "piece", "ring", F.col("__jump").alias("jump"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")), "steps")
        drop(before)
    drop(now)
    return ahead.select("scene_id", "piece", "ring", "steps")


def rings(regions: DataFrame, world: tuple[float, float, float, float] = (0.0, 1.0, 0.0, -1.0), tile: int = TILE) -> DataFrame:
    """``(scene_id, region_id, ring, hole, corners)``: each ring's smallest corner (row * 2^31 + col), whether it is a hole, its corners as text, from the smallest on and back to it."""
    ship(regions.sparkSession)
    pieces = snapshot(_pieces(regions, world, tile), "pieces")
    open_ = pieces.where("next is not null")
    closed = pieces.where("next is null").select("*", F.col("low").alias("ring"), F.lit(1).cast("long").alias("steps"))
    whole = closed.unionByName(open_.join(_ranked(open_), ["scene_id", "piece"])) if open_.limit(1).count() else closed
    # the first chain begins the ring at its smallest corner and ends it with what comes before
    first = F.coalesce(F.col("low") == F.col("ring"), F.lit(False))
    part = lambda order, text, turn: F.struct(order.cast("long").alias("place"), text.alias("text"), turn.alias("turn"))
    both = F.concat_ws(", ", "head", "tail")
    parts = F.when(first, F.array(part(-F.col("steps"), F.col("tail"), F.col("turn")), part(F.lit(1), F.concat_ws(", ", "head", "first"), F.lit(0).cast("long")))).otherwise(F.array(part(-F.col("steps"), F.when(both != "", both), F.col("turn"))))
    rows = whole.select("scene_id", "region_id", "ring", F.explode(parts).alias("p")).select("scene_id", "region_id", "ring", "p.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text")))), lambda x: x["text"]), ", ")
    return rows.groupBy("scene_id", "region_id", "ring").agg((F.sum("turn") < 0).alias("hole"), text.alias("corners"))


def polygonize(regions: DataFrame, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = -1.0, tile: int = TILE) -> DataFrame:
    """``(scene_id, region_id, geometry)``: each region's outline and then its holes as WKT in world coordinates.

    A ring begins at its smallest corner (by row, then column) and has corners only where it turns; holes stand by their
    smallest corner. Where cells of a region meet in a corner only, its ring stays with the cell.
    """
    ring = F.struct("hole", "ring", F.concat(F.lit("("), F.col("corners"), F.lit(")")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(ring)), lambda x: x["text"]), ", ")
    out = rings(regions, (x0, dx, y0, dy), tile).groupBy("scene_id", "region_id").agg(text.alias("text"))
    return out.select("scene_id", "region_id", F.concat(F.lit("POLYGON ("), F.col("text"), F.lit(")")).alias("geometry"))
