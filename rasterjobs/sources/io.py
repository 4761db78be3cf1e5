"""Sources and sinks of pixel tables, samples, histories, statistics and outlines. Sentinels become NULL on the way in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.runtime import ship, snapshot
from rasterjobs.schema import HISTORY, KEY, SAMPLES, pixels
from rasterjobs.sources import morton, tiff
from rasterjobs.sources.files import ranges, write_bytes


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel: float) -> DataFrame:
    return df.withColumns({c: F.when((F.col(c) != sentinel) & ~F.isnan(F.col(c).cast("double")), F.col(c)) for c in columns})


def read_pixels(spark: SparkSession, path: str, bands: list[str], sentinel: float | None = 0.0) -> DataFrame:
    """Pixel rows from Parquet; the sentinel and NaN become NULL."""
    df = spark.read.schema(pixels(*bands)).parquet(path)
    return df if sentinel is None else sentinel_to_null(df, bands, sentinel)


def write_pixels(df: DataFrame, path: str, bands: list[str], sentinel: float | None = None, mode: str = "error", group_bytes: int = 16 << 20) -> None:
    """Parquet by scene, rows in Morton order of their cells (see :mod:`morton`) with the key as ``zkey``; NULL becomes the sentinel.

    Row groups have about ``group_bytes`` bytes, so that :func:`read_window` prunes on both axes. Cells must have row and column from 0 on.
    """
    if sentinel is not None:
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in bands})
    df = df.withColumn(morton.ZKEY, morton.morton(F.col("row"), F.col("col")))
    order = ["scene_id", morton.ZKEY]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", group_bytes).partitionBy("scene_id").parquet(path)


def read_window(spark: SparkSession, path: str, bands: list[str], r: int, c: int, height: int, width: int, sentinel: float | None = 0.0) -> DataFrame:
    """Pixels of rows r .. r + height - 1 and columns c .. c + width - 1 of files that :func:`write_pixels` wrote.

    The window's ranges of keys, and its rows and columns, reach the scan: row groups and pages outside are not read.
    """
    schema = pixels(*bands).add(morton.ZKEY, "long")
    df = spark.read.schema(schema).parquet(path).where(morton.inside(r, r + height, c, c + width))
    df = df.where(f"row >= {int(r)} and row < {int(r + height)} and col >= {int(c)} and col < {int(c + width)}").drop(morton.ZKEY)
    return df if sentinel is None else sentinel_to_null(df, bands, sentinel)


def window_read(df: DataFrame, r: int, c: int, p: int) -> DataFrame:
    """A window of any pixel table; of files, see :func:`read_window`."""
    return df.where((F.col("row") >= r) & (F.col("row") < r + p) & (F.col("col") >= c) & (F.col("col") < c + p))


def _listed(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path")  # without content: any size


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            n = len(tiff.layout(ranges(path)[0]).places)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32())], ["path", "block"])


def _decoded(batches: Iterator[pa.RecordBatch], sentinel: float | None) -> Iterator[pa.RecordBatch]:
    at, read, p = None, None, None
    for batch in batches:
        for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if path != at:
                at, (read, _) = path, ranges(path)
                p = tiff.layout(read)
            band, r, c, part = p.block(read, block)
            _, height, width = part.shape
            row, col = np.repeat(np.arange(r, r + height, dtype=np.int32), width), np.tile(np.arange(c, c + width, dtype=np.int32), height)
            for i, x in enumerate(part):
                flat = x.reshape(-1).astype(np.float64)
                gone = np.isnan(flat) | (flat == sentinel if sentinel is not None else False)
                cols = [pa.array([path] * len(flat)), pa.array(np.full(len(flat), band + i + 1, np.int32)), pa.array(row), pa.array(col), pa.array(flat, mask=gone)]
                yield pa.RecordBatch.from_arrays(cols, ["scene_id", "band", "row", "col", "value"])


def read_rasters(spark: SparkSession, glob: str, sentinel: float | None = 0.0) -> DataFrame:
    """``(scene_id, band, row, col, value)`` of many TIFF files; scene_id is the path. Strips and tiles are read by range, dealt over all tasks."""
    ship(spark)
    blocks = _listed(spark, glob).mapInArrow(_blocks, "path string, block int")
    dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    return dealt.mapInArrow(lambda it: _decoded(it, sentinel), "scene_id string, band int, row int, col int, value double")


def read_scenes(spark: SparkSession, glob: str) -> DataFrame:
    """``(scene_id, bands, height, width, x0, dx, y0, dy)``, a row per file, from the files' tags only."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                p = tiff.layout(ranges(path)[0])
                row = {"scene_id": path, "bands": p.bands, "height": p.height, "width": p.width, **p.world}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("scene_id", pa.string()), ("bands", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("x0", pa.float64()), ("dx", pa.float64()), ("y0", pa.float64()), ("dy", pa.float64())]))

    return _listed(spark, glob).mapInArrow(run, "scene_id string, bands int, height int, width int, x0 double, dx double, y0 double, dy double")


def write_rasters(df: DataFrame, path: str, bands: list[str], tile: int = 256, sentinel: float = 0.0) -> DataFrame:
    """One TIFF of 32-bit floats for each tile of tile x tile cells, corner at its place in the scene; ``(path, tile_r, tile_c)`` of the files.

    Cells are numbered from the tile's corner, which the tie point gives as x = column and y = -row. NULL becomes the sentinel.
    """
    ship(df.sparkSession)

    def run(pdf):
        r0, c0, scene = int(pdf["tile_r"].iloc[0]), int(pdf["tile_c"].iloc[0]), str(pdf["scene_id"].iloc[0])
        r, c = pdf["row"].to_numpy() - r0 * tile, pdf["col"].to_numpy() - c0 * tile
        x = np.full((len(bands), r.max() + 1, c.max() + 1), sentinel, np.float32)
        for i, b in enumerate(bands):
            x[i, r, c] = pdf[b].fillna(sentinel).to_numpy(np.float32)
        name = f"{path}/{scene}-{r0}-{c0}.tif"  # the same bytes if a task runs twice
        write_bytes(name, tiff.write(x, c0 * tile, 1, -r0 * tile, -1))
        return pd.DataFrame({"path": [name], "tile_r": [r0], "tile_c": [c0]})

    tiled = df.select("scene_id", "row", "col", F.floor(F.col("row") / tile).alias("tile_r"), F.floor(F.col("col") / tile).alias("tile_c"), *[F.col(b).cast("double").alias(b) for b in bands])
    return snapshot(tiled.groupBy("scene_id", "tile_r", "tile_c").applyInPandas(run, "path string, tile_r long, tile_c long"), "rasters")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("header", True).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("multiLine", True).json(path)


def write_stats_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """A JSON line for each row; statistics have a few rows, so they go to one file."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode(mode).text(path)


def feature_json(df: DataFrame, properties: list[str]) -> DataFrame:
    """``value``: a GeoJSON feature for each WKT polygon of column ``geometry``."""
    rings = F.regexp_extract_all("geometry", F.lit(r"\(([-0-9.e+, ]+)\)"), F.lit(1))
    point = lambda p: F.transform(F.split(F.trim(p), " "), lambda v: v.cast("double"))
    coordinates = F.transform(rings, lambda r: F.transform(F.split(r, ","), point))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], mode: str = "error") -> None:
    """Line-delimited GeoJSON features."""
    feature_json(df, properties).write.mode(mode).text(path)
