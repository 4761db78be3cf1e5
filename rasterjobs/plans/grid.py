"""The synthetic pixel grid on the star schema's tables, in Spark and as SQL text side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.schema import CAL_CONST, NOISE_BIAS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital numbers, blocks, a reference mask and a ground height for each event, 100 cells a row."""
    g = table(spark, sf_dir, "events").selectExpr("event_id AS id", "'s0' AS scene_id", "cast(event_id div 100 AS int) AS row", "cast(event_id % 100 AS int) AS col", "cast(floor(value) AS bigint) AS v")
    b = g.withColumn("blk", F.expr("((row div 13) * 7 + (col div 11) * 5) % 4"))
    dn = {
        "before_hh": "CASE WHEN id % 97 = 0 THEN 0 ELSE 300 + (id * 37) % 41 + v END",
        "before_hv": "CASE WHEN id % 97 = 0 THEN 0 ELSE 180 + (id * 53) % 31 + v div 2 END",
        "during_hh": "CASE WHEN id % 89 = 0 THEN 0 WHEN blk = 0 THEN 120 + v % 60 ELSE 310 + (id * 29) % 37 + v END",
        "during_hv": "CASE WHEN id % 89 = 0 THEN 0 WHEN blk = 0 THEN 112 + v % 40 ELSE 185 + (id * 31) % 29 + v div 2 END",
    }
    b = b.withColumns({k: F.expr(f"cast({x} AS double)") for k, x in dn.items()})
    return b.withColumns({"ref": F.expr("CASE WHEN id % 101 = 0 THEN 255 WHEN blk = 0 THEN 1 ELSE 0 END"), "z": F.expr("50e0 + row * 7e-2 + col * 11e-2 + (id % 13) * 3e-1")})


PX = """
g AS (SELECT event_id AS id, CAST(event_id // 100 AS INTEGER) AS r, CAST(event_id % 100 AS INTEGER) AS c, CAST(floor(value) AS BIGINT) AS v FROM events),
b AS (SELECT *, ((r // 13) * 7 + (c // 11) * 5) % 4 AS blk FROM g),
px AS (SELECT id, r, c, blk, v,
  CAST(CASE WHEN id % 97 = 0 THEN 0 ELSE 300 + (id * 37) % 41 + v END AS DOUBLE) AS before_hh,
  CAST(CASE WHEN id % 97 = 0 THEN 0 ELSE 180 + (id * 53) % 31 + v // 2 END AS DOUBLE) AS before_hv,
  CAST(CASE WHEN id % 89 = 0 THEN 0 WHEN blk = 0 THEN 120 + v % 60 ELSE 310 + (id * 29) % 37 + v END AS DOUBLE) AS during_hh,
  CAST(CASE WHEN id % 89 = 0 THEN 0 WHEN blk = 0 THEN 112 + v % 40 ELSE 185 + (id * 31) % 29 + v // 2 END AS DOUBLE) AS during_hv,
  CASE WHEN id % 101 = 0 THEN 255 WHEN blk = 0 THEN 1 ELSE 0 END AS ref,
  50e0 + r * 7e-2 + c * 11e-2 + (id % 13) * 3e-1 AS z FROM b)"""


def _linear(band: str, bias: float) -> str:
    return f"CASE WHEN {band} <> 0 AND {band} * {band} - {bias}e0 > 0 THEN ({band} * {band} - {bias}e0) / pow(10e0, {CAL_CONST}e0 / 10) END AS {band}"


LIN = PX + ",\nlin AS (SELECT id, r, c, blk, ref, z, " + ", ".join(_linear(f"{d}_{p.lower()}", b) for (d, p), b in NOISE_BIAS.items()) + " FROM px)"

FEAT = LIN + """,
d4 AS (SELECT *, 10 * log10(before_hh) AS before_hh_db, 10 * log10(before_hv) AS before_hv_db, 10 * log10(during_hh) AS during_hh_db, 10 * log10(during_hv) AS during_hv_db FROM lin),
feat AS (SELECT *, before_hh / before_hv AS before_cr, during_hh / during_hv AS during_cr,
  (before_hh - before_hv) / (before_hh + before_hv) AS before_rfdi, (during_hh - during_hv) / (during_hh + during_hv) AS during_rfdi,
  during_hh_db - before_hh_db AS delta_hh, during_hv_db - before_hv_db AS delta_hv, during_hh / during_hv - before_hh / before_hv AS delta_cr FROM d4)"""

#: Automatic threshold of during_hh in dB, and the mask below it.
OTSU = FEAT + """,
mm AS (SELECT min(during_hh_db) AS lo, max(during_hh_db) AS hi FROM feat),
hb AS (SELECT least(CAST(floor((during_hh_db - lo) / (hi - lo) * 256) AS INTEGER), 255) AS bin, count(*) AS n FROM feat, mm WHERE during_hh_db IS NOT NULL GROUP BY 1),
hc AS (SELECT bin, n, lo + (bin + 0.5e0) * (hi - lo) / 256 AS ctr FROM hb, mm),
hw AS (SELECT *, sum(n) OVER (ORDER BY bin) AS w1, sum(n * ctr) OVER (ORDER BY bin) AS m1, sum(n) OVER () AS wt, sum(n * ctr) OVER () AS mt FROM hc),
cut AS (SELECT bin, ctr AS t FROM hw WHERE w1 < wt ORDER BY CAST(w1 AS DOUBLE) * (wt - w1) * pow(m1 / w1 - (mt - m1) / (wt - w1), 2) DESC, bin LIMIT 1),
m AS (SELECT id, r, c, blk, ref, z, during_hh_db AS db, CASE WHEN during_hh_db IS NULL THEN 255 WHEN during_hh_db < t THEN 1 ELSE 0 END AS mask FROM feat, cut)"""

#: Four-connected regions of mask = 1: each pixel's smallest id.
REGIONS = OTSU + """,
fl AS (SELECT id, r, c, z FROM m WHERE mask = 1),
nb AS (SELECT a.id AS x, b.id AS y FROM fl a JOIN fl b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)),
ed AS (SELECT x, y FROM nb UNION ALL SELECT y, x FROM nb),
cc(id, lab) USING KEY (id) AS (
  SELECT id, id FROM fl
  UNION
  SELECT ed.x, min(o.lab) FROM ed JOIN recurring.cc o ON o.id = ed.y JOIN recurring.cc w ON w.id = ed.x WHERE o.lab < w.lab GROUP BY ed.x)"""
