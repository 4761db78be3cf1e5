"""Queries that write what the library writes and read it back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterjobs.functions import algebra as A
from rasterjobs.operators import hist
from rasterjobs.plans import report
from rasterjobs.plans.grid import FEAT, PX, grid, table
from rasterjobs.plans.registry import R, query, rounded
from rasterjobs.runtime import new_path
from rasterjobs.schema import BANDS, FEATURES
from rasterjobs.sources import io


@query(f"WITH {PX} SELECT r, c, {', '.join(f'CASE WHEN {b} <> 0 THEN {b} END AS {b}' for b in BANDS)} FROM px")
def pixel_files(s, d):
    path = new_path(s, "pixels")
    io.write_pixels(grid(s, d).select("scene_id", "row", "col", *BANDS), path, BANDS, 0.0)
    return rounded(io.read_pixels(s, path, BANDS).select("row", "col", *BANDS))


@query(f"WITH {PX} SELECT r, c, during_hh FROM px WHERE r >= 3 AND r < 11 AND c >= 20 AND c < 28")
def pixel_window(s, d):
    """A window of pixel files: ranges of Morton keys, rows and columns reach the scan."""
    path = new_path(s, "pixels")
    io.write_pixels(grid(s, d).select("scene_id", "row", "col", "during_hh"), path, ["during_hh"])
    return rounded(io.read_window(s, path, ["during_hh"], 3, 20, 8, 8, None).select("row", "col", "during_hh"))


@query(f"WITH {PX} SELECT r, c, CAST(1 AS INTEGER) AS band, CASE WHEN during_hh <> 0 THEN during_hh END AS value FROM px UNION ALL SELECT r, c, 2, CASE WHEN during_hv <> 0 THEN during_hv END FROM px")
def raster_files(s, d):
    path = new_path(s, "tif")
    io.write_rasters(grid(s, d), path, ["during_hh", "during_hv"], 64)
    cells, scenes = io.read_rasters(s, f"{path}/*.tif"), io.read_scenes(s, f"{path}/*.tif")
    placed = cells.join(scenes, "scene_id")
    return placed.select((F.col("row") - F.col("y0")).cast("int").alias("r"), (F.col("col") + F.col("x0")).cast("int").alias("c"), "band", "value")


@query(f"WITH {PX} SELECT r, c, CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label FROM px WHERE v % 5 = 1")
def sample_files(s, d):
    path = new_path(s, "samples")
    grid(s, d).where("v % 5 = 1").selectExpr("row", "col", "CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label").write.option("header", True).csv(path)
    return rounded(io.read_samples(s, path))


_HISTORY = "SELECT CAST(event_id AS INTEGER) AS epoch, {v} / 500e0 AS train_loss, ({v} + 3) / 500e0 AS val_loss, ({v} % 97) / 97e0 AS iou, ({v} % 89) / 89e0 AS f1, ({v} % 83) / 83e0 AS oa FROM events"
_COLUMNS = ["train_loss", "val_loss", "iou", "f1", "oa"]
_HISTORY_SQL = f"WITH hy AS ({_HISTORY.format(v='CAST(floor(value) AS BIGINT)')}) SELECT epoch, {', '.join(map(R, _COLUMNS))} FROM hy"


def _history(s, d):
    v = F.floor("value")
    parts = {"train_loss": v / 500.0, "val_loss": (v + 3) / 500.0, "iou": (v % 97) / 97.0, "f1": (v % 89) / 89.0, "oa": (v % 83) / 83.0}
    return table(s, d, "events").select(F.col("event_id").cast("int").alias("epoch"), *[x.alias(c) for c, x in parts.items()])


@query(_HISTORY_SQL)
def history_files(s, d):
    """Histories are arrays of objects, one array a file."""
    path = new_path(s, "history")
    runs = _history(s, d).groupBy(F.expr("epoch div 10000").alias("run")).agg(F.sort_array(F.collect_list(F.struct("epoch", *_COLUMNS))).alias("h"))  # 10,000 epochs
    runs.select(F.to_json("h").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return rounded(io.read_history(s, path))


@query(_HISTORY_SQL)
def training_curves(s, d):
    return rounded(report.training_curves(_history(s, d)))


@query(f"WITH {FEAT}, u AS (UNPIVOT feat ON {', '.join(FEATURES)} INTO NAME channel VALUE x) SELECT channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')} FROM u GROUP BY channel")
def stats_files(s, d):
    path = new_path(s, "stats")
    io.write_stats_json(hist.channel_stats(A.basic_features(A.calibrated(grid(s, d))), FEATURES), path)
    return rounded(s.read.schema("channel string, mean double, std double").json(path))
