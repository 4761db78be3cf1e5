"""Registered queries of the raster operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.functions import algebra as A
from rasterjobs.operators import accuracy as acc
from rasterjobs.operators import depth, focal, hist, ml, outlines, patches, regions, resample, summed, texture
from rasterjobs.plans import report, workloads
from rasterjobs.plans.grid import FEAT, LIN, OTSU, PX, REGIONS, grid, table
from rasterjobs.plans.registry import ORACLES, R, query, rounded
from rasterjobs.runtime import new_path, snapshot
from rasterjobs.schema import BANDS, FEATURES
from rasterjobs.sources import io

def _features(s, d):
    return A.basic_features(A.calibrated(grid(s, d)))


def _masked(s, d):
    return workloads.flood_by_threshold(grid(s, d)).select("scene_id", "id", "row", "col", "blk", "ref", "z", "db", "mask")


@query(f"WITH {OTSU} SELECT CAST(count(*) FILTER (mask = 1) AS BIGINT) AS flood_pixels, count(*) AS total_pixels, {R('count(*) FILTER (mask = 1) * 324e0 / 10000', 'flood_area_ha')}, {R('count(*) FILTER (mask = 1) * 100e0 / count(*)', 'flood_pct')} FROM m")
def otsu_flood_area(s, d):
    return rounded(workloads.otsu_flood_area(grid(s, d)))


@query(f"WITH {FEAT} SELECT id, {', '.join(R(b, None, 10) for b in BANDS)}, {', '.join(R(b + '_db') for b in BANDS)} FROM feat")
def calibrate_db(s, d):
    df = A.calibrated(grid(s, d))
    return df.select("id", *[(F.round(b, 10) + 0.0).alias(b) for b in BANDS], *[(F.round(A.to_db(b), 6) + 0.0).alias(f"{b}_db") for b in BANDS])


_RATIOS = ["before_cr", "during_cr", "before_rfdi", "during_rfdi", "delta_hh", "delta_hv", "delta_cr"]


@query(f"WITH {FEAT} SELECT id, {', '.join(map(R, _RATIOS))}, {R('delta_hh + delta_hv', 'combined')} FROM feat")
def ratio_features(s, d):
    df = _features(s, d)
    return rounded(df.select("id", *_RATIOS, A.combined_change().alias("combined")))


@query(f"WITH {FEAT} SELECT r, c, {', '.join(map(R, FEATURES))} FROM feat WHERE {' AND '.join(f'{x} IS NOT NULL' for x in FEATURES)}")
def feature_stack(s, d):
    return rounded(A.valid_only(A.feature_stack(_features(s, d)), FEATURES).drop("scene_id"))


@query(f"WITH {FEAT}, u AS (UNPIVOT feat ON {', '.join(FEATURES)} INTO NAME channel VALUE x) SELECT channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')} FROM u GROUP BY channel")
def channel_stats(s, d):
    return rounded(hist.channel_stats(_features(s, d), FEATURES))


@query(f"WITH {FEAT}, st AS (SELECT avg(during_hh_db) AS mu, stddev_pop(during_hh_db) AS sd FROM feat) SELECT id, {R('(coalesce(during_hh_db, 0) - mu) / (sd + 1e-6)', 'z')} FROM feat, st")
def zscore(s, d):
    df = _features(s, d)
    stats = hist.channel_stats(df, ["during_hh_db"])
    return rounded(df.crossJoin(F.broadcast(stats)).select("id", A.zscore("during_hh_db", "mean", "std").alias("z")))  # one row


@query(f"WITH {FEAT} SELECT " + ", ".join(R(f"{f}({x})", f"{x}_{n}") for x in ("delta_hh", "delta_hv") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM feat")
def change_summary(s, d):
    return rounded(hist.change_summary(_features(s, d), ["delta_hh", "delta_hv"]))


@query(f"WITH {FEAT} SELECT p, {R('v', 'value')} FROM (SELECT unnest([2e0, 5e0, 50e0, 95e0, 98e0]) AS p, unnest(quantile_cont(during_hh_db, [0.02, 0.05, 0.5, 0.95, 0.98])) AS v FROM feat)")
def band_percentiles(s, d):
    return rounded(hist.band_percentiles(_features(s, d), "during_hh_db", [2, 5, 50, 95, 98]))


@query(f"WITH {FEAT} SELECT {R('quantile_cont(abs(delta_hh), 0.98)', 'lim')} FROM feat")
def symmetric_limit(s, d):
    return rounded(hist.symmetric_limit(_features(s, d), "delta_hh").withColumnRenamed("limit", "lim"))


@query(f"WITH {FEAT}, p AS (SELECT quantile_cont(during_hh_db, 0.02) AS lo, quantile_cont(during_hh_db, 0.98) AS hi FROM feat) SELECT id, {R('CASE WHEN during_hh_db IS NOT NULL THEN least(1e0, greatest(0e0, (during_hh_db - lo) / (hi - lo + 1e-8))) END', 'stretched')} FROM feat, p")
def stretch(s, d):
    return rounded(hist.percentile_stretch(_features(s, d), "during_hh_db").select("id", "stretched"))


@query(f"WITH {OTSU} SELECT bin, {R('t', 'threshold')} FROM cut")
def otsu_threshold(s, d):
    return rounded(hist.otsu_threshold(_features(s, d), "during_hh_db"))


_HIST = """, lim AS (SELECT min({x}) AS lo, max({x}) AS hi, count({x}) AS nt FROM feat),
hn AS (SELECT least(CAST(floor(({x} - lo) / (hi - lo) * 120) AS INTEGER), 119) AS k, count(*) AS n FROM feat, lim WHERE {x} IS NOT NULL GROUP BY 1)
SELECT {extra}CAST(i AS INTEGER) AS bin, {left}, coalesce(n, 0) AS n, {value}{more} FROM range(120) t(i) CROSS JOIN lim LEFT JOIN hn ON k = i"""


@query(f"WITH {FEAT}" + _HIST.format(x="delta_hh", extra="", more="", left=R("lo + i * ((hi - lo) / 120)", '"left"'), value=R("coalesce(n, 0) / (nt * ((hi - lo) / 120))", "value")))
def histogram(s, d):
    return rounded(hist.histogram(_features(s, d), "delta_hh"))


@query(f"WITH {OTSU}" + _HIST.format(x="during_hh_db", extra="'during_hh_db' AS band, ", more=", " + R("(SELECT t FROM cut)", "threshold"), left=R("lo + i * ((hi - lo) / 120)", '"left"'), value=R("coalesce(n, 0) / (nt * ((hi - lo) / 120))", "value")))
def distribution_table(s, d):
    return rounded(hist.distribution_table(_features(s, d), ["during_hh_db"]))


@query(f"WITH {FEAT}, k AS (SELECT id, delta_hh, row_number() OVER (ORDER BY r, c) - 1 AS n FROM feat WHERE delta_hh IS NOT NULL) SELECT id, {R('delta_hh')} FROM k WHERE n % 7 = 0")
def subsample(s, d):
    return rounded(hist.subsample_every(_features(s, d), 7, "delta_hh").select("id", "delta_hh"))


@query(f"WITH {OTSU} SELECT id, mask FROM m")
def below_threshold(s, d):
    return _masked(s, d).select("id", "mask")


@query(f"WITH {PX} SELECT id, {R('1 / (1 + exp(-((v % 9) - 4e0)))', 'prob')}, CASE WHEN 1 / (1 + exp(-((v % 9) - 4e0))) >= 0.5 THEN 1 ELSE 0 END AS mask FROM px")
def sigmoid_mask(s, d):
    p = A.sigmoid((F.col("v") % 9 - 4).cast("double"))
    return rounded(grid(s, d).select("id", p.alias("prob"), A.threshold_mask(p).alias("mask")))


_COLOURS = "[CASE WHEN k = 0 THEN 0 ELSE k * 17 END, CASE WHEN k = 0 THEN 0 ELSE 255 - k * 17 END, CASE WHEN k = 0 THEN 0 ELSE 128 END]"


@query(f"WITH {PX}, cl AS (SELECT id, CASE WHEN v % 17 = 3 THEN 0 WHEN v / 10e0 >= 6.5 THEN 14 ELSE CAST(floor(v / 10e0 * 2) AS INTEGER) + 1 END AS k FROM px), cr AS (SELECT id, {_COLOURS} AS rgb FROM cl) SELECT id, CAST(rgb[1] AS INTEGER) AS red, CAST(rgb[2] AS INTEGER) AS green, CAST(rgb[3] AS INTEGER) AS blue FROM cr")
def class_colours(s, d):
    df = depth.depth_classes(grid(s, d).withColumn("depth", F.when(F.col("v") % 17 != 3, F.col("v") / 10.0)))
    colour = F.concat(F.lit("#"), *[F.lpad(F.hex(x), 2, "0") for x in (F.col("id") * 17, 255 - F.col("id") * 17, F.lit(128))])
    table_ = s.range(1, 15).select(F.col("id").cast("int").alias("depth_class"), A.hex_rgb(colour).alias("rgb"))
    rgb = F.coalesce("rgb", F.array(*[F.lit(0)] * 3))
    return df.join(F.broadcast(table_), "depth_class", "left").select("id", *[rgb[i].alias(c) for i, c in enumerate(("red", "green", "blue"))])  # 14 rows


@query(f"WITH {OTSU} SELECT id, CASE WHEN mask = 1 THEN 112 ELSE 0 END AS green, CASE WHEN mask = 1 THEN 180 ELSE 0 END AS alpha, {R('500000e0 + (c + 0.5e0) * 18', 'x')}, {R('2400000e0 + (r + 0.5e0) * -18', 'y')} FROM m")
def overlay_world(s, d):
    df = _masked(s, d).withColumn("rgba", A.overlay_rgba("mask"))
    x, y = A.pixel_to_world("row", "col", F.lit(500000.0), F.lit(18.0), F.lit(2400000.0), F.lit(-18.0), centre=True)
    return rounded(df.select("id", F.col("rgba")[1].alias("green"), F.col("rgba")[3].alias("alpha"), x.alias("x"), y.alias("y")))


@query(f"WITH {PX} SELECT id, CASE WHEN v % 17 = 3 THEN 0 WHEN v / 10e0 >= 6.5 THEN 14 ELSE CAST(floor(v / 10e0 * 2) AS INTEGER) + 1 END AS depth_class FROM px")
def depth_classes(s, d):
    df = grid(s, d).withColumn("depth", F.when(F.col("v") % 17 != 3, F.col("v") / 10.0))
    return depth.depth_classes(df).select("id", "depth_class")


_PATCH = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings)"


@query(f"WITH {_PATCH} SELECT vec_id AS patch_id, CAST(7 - pos % 8 AS INTEGER) AS pr, CAST(pos // 8 AS INTEGER) AS pc, {R('CAST(x AS DOUBLE)', 'x')} FROM e")
def patch_rot90(s, d):
    df = table(s, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("pos", "x"))
    df = df.select("patch_id", F.expr("pos div 8").cast("int").alias("pr"), (F.col("pos") % 8).cast("int").alias("pc"), F.col("x").cast("double"))
    return rounded(A.augment_geom(df, "rot90", 8))


_TURNS = {"hflip": ("pos // 8", "7 - pos % 8"), "vflip": ("7 - pos // 8", "pos % 8"), "rot180": ("7 - pos // 8", "7 - pos % 8"), "rot270": ("pos % 8", "7 - pos // 8")}


def _patch_pixels(s, d) -> DataFrame:
    df = table(s, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("pos", "x"))
    return df.select("patch_id", F.expr("pos div 8").cast("int").alias("pr"), (F.col("pos") % 8).cast("int").alias("pc"), F.col("x").cast("double").alias("x"))


@query(f"WITH {_PATCH} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, vec_id AS patch_id, CAST({r} AS INTEGER) AS pr, CAST({c} AS INTEGER) AS pc, {R('CAST(x AS DOUBLE)', 'x')} FROM e" for k, (r, c) in _TURNS.items()))
def patch_turns(s, d):
    out = None
    for kind in _TURNS:
        one = A.augment_geom(_patch_pixels(s, d), kind, 8).select(F.lit(kind).alias("kind"), "patch_id", "pr", "pc", "x")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"WITH {_PATCH} SELECT vec_id AS patch_id, count(*) AS n, TRUE AS fine FROM e GROUP BY 1")
def speckle_bounds(s, d):
    """A patch is unchanged, or most of its values are, each by a factor near 1; about half of the patches are."""
    df = _patch_pixels(s, d).withColumn("y", F.col("x"))
    both = A.augment_speckle(df, ["y"], 5).withColumn("k", F.when(F.col("x") != 0, F.col("y") / F.col("x")).otherwise(1.0))
    per = both.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") != F.col("x")).cast("int")).alias("moved"), F.max(F.abs(F.col("k") - 1)).alias("far"))
    share = per.agg(F.avg((F.col("moved") > 0).cast("int")).alias("share"))
    fine = ((F.col("moved") == 0) | (F.col("moved") > 0.9)) & (F.col("far") < 0.08 * 7) & F.col("share").between(0.35, 0.65)
    return per.crossJoin(F.broadcast(share)).select("patch_id", "n", fine.alias("fine"))  # one row


@query(f"WITH {_PATCH} SELECT vec_id AS patch_id, count(*) AS n, TRUE AS fine FROM e GROUP BY 1")
def jitter_bounds(s, d):
    """One shift below 1 for all values of a patch; about half of the patches are shifted."""
    both = A.augment_jitter(_patch_pixels(s, d).withColumn("y", F.col("x")), ["y"], 5).withColumn("k", F.col("y") - F.col("x"))
    per = both.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    share = per.agg(F.avg((F.col("low") != 0).cast("int")).alias("share"))
    fine = (F.col("high") - F.col("low") < 1e-9) & (F.abs("high") < 1) & F.col("share").between(0.35, 0.65)
    return per.crossJoin(F.broadcast(share)).select("patch_id", "n", fine.alias("fine"))  # one row


@query(f"WITH {LIN} SELECT r, c, {R('before_hh', 'before', 10)}, {R('during_hh', 'during', 10)} FROM lin WHERE before_hh IS NOT NULL AND during_hh IS NOT NULL")
def stack_bands(s, d):
    df = A.calibrated(grid(s, d))
    one = df.where("before_hh is not null").select("scene_id", "row", "col", F.col("before_hh").alias("value"))
    two = df.where("during_hh is not null").select("scene_id", "row", "col", F.col("during_hh").alias("value"))
    return rounded(resample.stack_bands({"before": one, "during": two}).drop("scene_id"), 10)


_TAPS = """{p}a AS (SELECT i, (i + 0.5e0) * ({s}e0 / {t}e0) - 0.5e0 AS pos FROM range({t}) x(i)),
{p}t AS (SELECT i, CAST(greatest(0, least({s} - 1, floor(pos) + k)) AS INTEGER) AS j, CASE WHEN k = 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM {p}a, range(2) y(k))"""
_RES = f"""WITH o AS (SELECT CAST(o_orderkey // 250 AS INTEGER) AS r, CAST(o_orderkey % 250 AS INTEGER) AS c, CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS x FROM orders WHERE o_orderkey < 5000),
{_TAPS.format(p="c", s=250, t=301)}, {_TAPS.format(p="r", s=20, t=33)},
h AS (SELECT r, ct.i AS c, sum(w * x) AS v, sum(CASE WHEN x IS NOT NULL THEN w ELSE 0 END) AS a FROM o JOIN ct ON ct.j = o.c WHERE w > 0 GROUP BY 1, 2),
v AS (SELECT rt.i AS r, c, sum(w * v) AS v, sum(w * a) AS a FROM h JOIN rt ON rt.j = h.r WHERE w > 0 GROUP BY 1, 2)
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('CASE WHEN a > 0 THEN v / a END', 'x', 4)} FROM v"""


def _orders(s, d, rows: int) -> DataFrame:
    o = table(s, d, "orders").selectExpr("'s0' AS scene_id", "cast(o_orderkey div 250 AS int) AS row", "cast(o_orderkey % 250 AS int) AS col", "CASE WHEN o_orderkey % 31 <> 0 THEN cast(o_totalprice AS double) END AS x")
    return o.where(F.col("row") < rows)


def _whole_resample() -> str:
    """The grid has as many rows as the orders fill; the SQL reads that number from the table."""
    sql = _RES.replace(" WHERE o_orderkey < 5000", "")
    n = "(SELECT (count(*) + 249) // 250 FROM orders)"
    return sql.replace("range(33)", f"range({n} * 33 // 20)").replace("(20e0 / 33e0)", f"(CAST({n} AS DOUBLE) / ({n} * 33 // 20))").replace("least(20 - 1,", f"least({n} - 1,")


@query(_whole_resample())
def resample_bilinear(s, d):
    rows = (table(s, d, "orders").count() + 249) // 250
    return rounded(resample.resample_to(_orders(s, d, rows), "x", (rows, 250), (rows * 33 // 20, 301)).drop("scene_id"), 4)


@query(f"""WITH {PX}, t AS (SELECT id, c * 0.8e0 + 0.9e0 - 0.5e0 AS fc, r * 0.7e0 + 1.3e0 - 0.5e0 AS fr FROM px),
q AS (SELECT id, CAST(floor(fr) AS INTEGER) + i AS sr, CAST(floor(fc) AS INTEGER) + j AS sc, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM t, range(2) a(i), range(2) b(j)),
k AS (SELECT q.id, sum(w * px.z) / sum(w) AS z FROM q JOIN px ON px.r = sr AND px.c = sc WHERE w > 0 GROUP BY 1)
SELECT px.id, {R('coalesce(k.z, 0e0)', 'z')} FROM px LEFT JOIN k USING (id)""")
def warp_affine(s, d):
    g = grid(s, d)
    return rounded(resample.warp(g, "z", g.select("scene_id", "row", "col", "id"), F.col("col") * 0.8 + 0.9, F.col("row") * 0.7 + 1.3, (0.0, 1.0, 0.0, 1.0)).select("id", "z"))


def _utm_sql(x: str, y: str) -> tuple[str, str]:
    """Longitude (zone 44) and latitude in degrees, as SQL on columns."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = f"({y} / {k0 * radius!r}e0)", f"(({x} - 500000e0) / {k0 * radius!r}e0)"
    xi1 = f"({xi}" + "".join(f" - {b!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(beta, 1)) + ")"
    eta1 = f"({eta}" + "".join(f" - {b!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(beta, 1)) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    return f"degrees(atan2(sinh({eta1}), cos({xi1}))) + 81", f"degrees({chi}" + "".join(f" + {d!r}::DOUBLE * sin({2 * j} * {chi})" for j, d in enumerate(delta, 1)) + ")"


_LON, _LAT = _utm_sql("(499500e0 + (c + 0.5e0) * 18)", "(2400000e0 + (r + 0.5e0) * -18)")


@query(f"""WITH {PX}, ll AS (SELECT id, {_LON} AS lon, {_LAT} AS lat FROM px), t AS (SELECT id, (lon - 80.994e0) / 2e-4 - 0.5e0 AS fc, (lat - 21.698e0) / -1.7e-4 - 0.5e0 AS fr FROM ll),
q AS (SELECT id, CAST(floor(fr) AS INTEGER) + i AS sr, CAST(floor(fc) AS INTEGER) + j AS sc, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM t, range(2) a(i), range(2) b(j)),
k AS (SELECT q.id, sum(w * px.z) / sum(w) AS z FROM q JOIN px ON px.r = sr AND px.c = sc WHERE w > 0 GROUP BY 1)
SELECT px.id, {R('coalesce(k.z, 0e0)', 'z', 5)} FROM px LEFT JOIN k USING (id)""")
def reproject_utm(s, d):
    g = grid(s, d)
    scene = {"x0": 499500.0, "dx": 18.0, "y0": 2400000.0, "dy": -18.0}
    return rounded(resample.reproject_to(g, g.select("scene_id", "row", "col", "id"), scene, (80.994, 2e-4, 21.698, -1.7e-4)).select("id", "z"), 5)


@query(f"WITH {FEAT} SELECT id, CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label, {', '.join(map(R, FEATURES))} FROM feat")
def sample_points(s, d):
    df = _features(s, d)
    samples = df.selectExpr("scene_id", "row", "col", "CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label")
    return rounded(ml.sample_at(df.select("scene_id", "row", "col", "id", *FEATURES), samples).select("id", "label", *FEATURES))


_ORIGINS = """sz AS (SELECT max(r) + 1 AS h, 100 AS w FROM px), rr AS (SELECT DISTINCT least(k * 12, greatest(h - 16, 0)) AS r0 FROM sz, range(100000) t(k) WHERE k * 12 < greatest(h - 16, 0) + 12),
oo AS (SELECT DISTINCT least(k * 12, 84) AS c0 FROM range(8) t(k)), pa AS (SELECT r0 * 100 + c0 AS patch_id, r0, c0 FROM rr, oo)"""


def _patches(s, d) -> DataFrame:
    g = grid(s, d)
    height = g.agg(F.max("row")).first()[0] + 1
    return patches.patch_extract(g, patches.sliding_patches(s, height, 100, 16, 4), 16)


@query(f"WITH {PX}, {_ORIGINS} SELECT CAST(patch_id AS BIGINT) AS patch_id, count(*) AS n, CAST(sum((r - r0) * (c - c0) * (id % 7)) AS BIGINT) AS h FROM px JOIN pa ON r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY 1")
def patch_extract(s, d):
    return _patches(s, d).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pr") * F.col("pc") * (F.col("id") % 7)).alias("h"))


@query(f"WITH {PX}, {_ORIGINS} SELECT CAST(patch_id AS BIGINT) AS patch_id, CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0 FROM pa")
def sliding_patches(s, d):
    height = grid(s, d).agg(F.max("row")).first()[0] + 1
    return patches.sliding_patches(s, height, 100, 16, 4).select("patch_id", "r0", "c0")


@query(f"WITH {PX} SELECT id AS patch_id, TRUE AS inside FROM px")
def random_origins(s, d):
    """As many origins as pixels, all of whose patches lie in the grid."""
    size = grid(s, d).agg(F.max("row").alias("h"), F.count(F.lit(1)).alias("n")).first()
    found = patches.random_patches(s, size["h"] + 1, 100, 8, size["n"], 42)
    return found.select("patch_id", (F.col("r0").between(0, max(size["h"] - 8, 0)) & F.col("c0").between(0, 91)).alias("inside"))


@query(f"WITH {PX}, {_ORIGINS} SELECT CAST(patch_id AS BIGINT) AS patch_id, {R('avg(CASE WHEN ref <> 255 THEN 1e0 ELSE 0 END)', 'valid_ratio')}, {R('avg(CASE WHEN ref = 1 THEN 1e0 ELSE 0 END)', 'flood_ratio')} FROM px JOIN pa ON r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY 1 HAVING avg(CASE WHEN ref = 1 THEN 1e0 ELSE 0 END) >= 0.2")
def patch_filter(s, d):
    g = grid(s, d)
    height = g.agg(F.max("row")).first()[0] + 1
    return rounded(patches.filter_patches(patches.summed_masks(g, "ref"), patches.sliding_patches(s, height, 100, 16, 4), 0.5, 0.2))


@query(f"""WITH {PX}, bx AS (SELECT id, r - 3 AS r0, c - id % 11 AS c0, r + id % 7 AS r1, c + 1 + id % 5 AS c1 FROM px)
SELECT bx.id, count(px.id) AS cells, CAST(coalesce(sum(px.v), 0) AS BIGINT) AS v, CAST(coalesce(sum(CASE WHEN px.blk = 0 THEN -px.v END), 0) AS BIGINT) AS wet
FROM bx LEFT JOIN px ON px.r >= r0 AND px.r < r1 AND px.c >= c0 AND px.c < c1 GROUP BY 1""")
def box_totals(s, d):
    """A box around every pixel, some beyond the grid's edge, some empty."""
    g = grid(s, d)
    tables = summed.SummedArea(g, {"cells": F.lit(1), "v": F.col("v"), "wet": F.when(F.col("blk") == 0, -F.col("v"))}, 32)
    boxes = g.selectExpr("id", "row - 3 AS r0", "col - id % 11 AS c0", "row + id % 7 AS r1", "col + 1 + id % 5 AS c1")
    return tables.sums(boxes, "id").drop("scene_id")


@query(f"WITH {PX}, {_ORIGINS} SELECT id, {R('avg(z)', 'prob', 4)} FROM px JOIN pa ON r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY id")
def score_identity(s, d):
    made = patches.score_patches(_patches(s, d), ["z"], lambda x: x[0], 16, logits=False)
    out = patches.overlap_average(made).select((F.col("row").cast("long") * 100 + F.col("col")).alias("id"), "prob")
    return out.select("id", (F.round("prob", 4) + 0.0).alias("prob"))


@query(ORACLES["score_identity"])
def score_batches(s, d):
    """Four patches a call; the mean of both channels is the first, as they are equal."""
    pixels = _patches(s, d).withColumn("again", F.col("z"))
    made = patches.score_patches(pixels, ["z", "again"], lambda x: x.mean(axis=1), 16, logits=False, batch=4)
    out = patches.overlap_average(made).select((F.col("row").cast("long") * 100 + F.col("col")).alias("id"), "prob")
    return out.select("id", (F.round("prob", 4) + 0.0).alias("prob"))


@query(f"WITH {OTSU} SELECT 'keep' AS kind, id FROM m WHERE mask = 1 UNION ALL SELECT 'drop', id FROM m WHERE mask <> 1")
def mask_semi_anti(s, d):
    g, m = grid(s, d), _masked(s, d)
    return resample.mask_by(g, m, "keep").select(F.lit("keep").alias("kind"), "id").unionByName(resample.mask_by(g, m, "drop").select(F.lit("drop").alias("kind"), "id"))


@query(f"WITH {OTSU} SELECT id, {R('CASE WHEN mask = 1 THEN z ELSE -1e0 END', 'z')} FROM m")
def mask_zero(s, d):
    g = grid(s, d).select("scene_id", "row", "col", "id", "z")
    return rounded(resample.mask_by(g, _masked(s, d), "zero", ["z"], -1.0).select("id", "z"))


@query(f"WITH {OTSU} SELECT CAST(count(*) FILTER (mask = 1) AS BIGINT) AS flood_pixels, count(*) AS total_pixels, {R('count(*) FILTER (mask = 1) * 324e0 / 10000', 'flood_area_ha')}, {R('count(*) FILTER (mask = 1) * 100e0 / count(*) FILTER (mask <> 255)', 'flood_pct')} FROM m")
def mask_area(s, d):
    return rounded(acc.mask_area(_masked(s, d), of_valid=True))


_CONF = "k AS (SELECT {by} count(*) FILTER ({p} = 1 AND {r} = 1) AS tp, count(*) FILTER ({p} = 1 AND {r} = 0) AS fp, count(*) FILTER ({p} <> 1 AND {r} = 1) AS fn, count(*) FILTER ({p} <> 1 AND {r} = 0) AS tn FROM {t} {g})"
_OA, _IOU = "(tp + tn) / (tp + fp + fn + tn + 1e-6)", "tp / (tp + fp + fn + 1e-6)"
_PR, _RE = "(tp / (tp + fp + 1e-6))", "(tp / (tp + fn + 1e-6))"
_F1 = f"2 * {_PR} * {_RE} / ({_PR} + {_RE} + 1e-6)"
_PE = "(((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)))"
_KAPPA = f"({_OA} - {_PE}) / (1 - {_PE} + 1e-6)"
_SCORES = f"{R(_OA, 'overall_accuracy', 4)}, {R(_IOU, 'iou', 4)}, {R(_F1, 'f1', 4)}, {R(_PR, 'precision', 4)}, {R(_RE, 'recall', 4)}, {R(_KAPPA, 'kappa', 4)}"


@query(f"WITH {OTSU}, {_CONF.format(by='', p='mask', r='ref', t='m', g='')} SELECT tp, fp, fn, tn, {_SCORES} FROM k")
def accuracy(s, d):
    return acc.accuracy_report(_masked(s, d), "mask", "ref")


@query(f"WITH {_CONF.format(by='', p='quality', r='toxic', t='labels', g='')} SELECT tp, fp, fn, tn, {_SCORES} FROM k")
def label_confusion(s, d):
    return acc.accuracy_report(table(s, d, "labels"), "quality", "toxic")


@query(f"WITH {OTSU}, {_CONF.format(by='r % 8 AS batch,', p='mask', r='ref', t='m', g='GROUP BY 1')} SELECT {R(f'avg({_IOU})', 'iou')}, {R(f'avg({_F1})', 'f1')}, {R(f'avg({_OA})', 'oa')} FROM k")
def batch_metrics(s, d):
    return rounded(acc.batch_metrics(_masked(s, d).withColumn("batch", F.col("row") % 8), pred="mask"))


@query(f"""WITH {PX}, x AS (SELECT r % 8 AS batch, (v % 13 - 6) / 2e0 AS x, ref AS t FROM px WHERE ref <> 255),
y AS (SELECT batch, (1 - t) * x + (1 + 1.5e0 * t) * (ln(1 + exp(-abs(x))) + greatest(-x, 0e0)) AS bce, 1 / (1 + exp(-x)) AS p, t FROM x)
SELECT batch, {R('0.5 * avg(bce) + 0.5 * (1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1))', 'loss')} FROM y GROUP BY 1""")
def seg_loss(s, d):
    df = grid(s, d).withColumns({"batch": F.col("row") % 8, "logit": (F.col("v") % 13 - 6) / 2.0})
    return rounded(acc.segmentation_loss(df, pos_weight=2.5))


@query(f"SELECT l_orderkey AS r, l_linenumber AS c, {R('avg(CAST(l_discount AS DOUBLE) * 10)', 'prob')} FROM lineitem GROUP BY 1, 2")
def overlap_average(s, d):
    df = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_discount").cast("double") * 10).alias("prob"))
    return rounded(patches.overlap_average(df, key=("row", "col")))


@query(f"WITH {OTSU} SELECT m.id, CASE WHEN ((CASE WHEN mask = 1 THEN 2e0 ELSE 0 END) + (CASE WHEN px.before_hh < 330 THEN 1e0 ELSE 0 END) + (CASE WHEN m.ref = 1 THEN 1.5e0 ELSE 0 END)) / 4.5e0 >= 0.5 THEN 1 ELSE 0 END AS mask FROM m JOIN px USING (id)")
def ensemble_vote(s, d):
    g, m = grid(s, d), _masked(s, d)
    key = ["scene_id", "row", "col"]
    votes = acc.union_masks({"dl": m.select(*key, "mask"), "otsu": g.select(*key, (F.col("before_hh") < 330).cast("int").alias("mask")), "ref": g.select(*key, F.col("ref").alias("mask"))})
    out = acc.ensemble_vote(votes, {"dl": 2.0, "otsu": 1.0, "ref": 1.5})
    return out.select((F.col("row").cast("long") * 100 + F.col("col")).alias("id"), "mask")


@query(f"WITH {OTSU} SELECT 'both' AS kind, r, c FROM m WHERE mask = 1 AND ref = 1 UNION ALL SELECT 'extra', r, c FROM m WHERE mask = 1 AND ref <> 1 UNION ALL SELECT 'missed', r, c FROM m WHERE mask <> 1 AND ref = 1")
def mask_setops(s, d):
    m = _masked(s, d)
    ref = m.withColumn("mask", F.col("ref"))
    parts = {"both": acc.mask_intersect(m, ref), "extra": acc.mask_difference(m, ref), "missed": acc.mask_difference(ref, m)}
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), F.col("row").alias("r"), F.col("col").alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


BOX = """, sz AS (SELECT max(r) + 1 AS h FROM px),
pk AS (SELECT r, c, {x} AS x FROM {t}),
ph AS (SELECT a.r, k.c, sum(a.x) AS x, sum(a.x * a.x) AS q FROM range(100) k(c), range(-3, 4) o(o), pk a WHERE a.c = CASE WHEN k.c + o < 0 THEN -1 - (k.c + o) WHEN k.c + o > 99 THEN 199 - (k.c + o) ELSE k.c + o END GROUP BY 1, 2),
pv AS (SELECT k.r, a.c, sum(a.x) / 49 AS m, sum(a.q) / 49 AS m2 FROM (SELECT unnest(range((SELECT h FROM sz))) AS r) k, sz, range(-3, 4) o(o), ph a WHERE a.r = CASE WHEN k.r + o < 0 THEN -1 - (k.r + o) WHEN k.r + o > h - 1 THEN 2 * h - 1 - (k.r + o) ELSE k.r + o END GROUP BY 1, 2)"""


@query(f"WITH {FEAT}{BOX.format(x='coalesce(during_hh_db, 0)', t='feat')} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('m', 'mean')} FROM pv")
def box_mean(s, d):
    return rounded(focal.box_mean(_features(s, d).select("scene_id", "row", "col", "during_hh_db"), "during_hh_db").select("row", "col", "mean"))


@query(f"WITH {FEAT}{BOX.format(x='coalesce(during_hh_db, 0)', t='feat')} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('m', 'local_mean')}, {R('sqrt(greatest(m2 - m * m, 0e0))', 'local_std')} FROM pv")
def local_stats(s, d):
    return rounded(focal.local_stats(_features(s, d).select("scene_id", "row", "col", "during_hh_db"), "during_hh_db").select("row", "col", "local_mean", "local_std"))


@query(f"WITH {FEAT}{BOX.format(x='coalesce(during_hh * 1000, 0)', t='feat')}, w AS (SELECT pv.*, f.during_hh * 1000 AS x, greatest(m2 - m * m, 0e0) AS va FROM pv JOIN feat f ON f.r = pv.r AND f.c = pv.c) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('CASE WHEN x IS NOT NULL THEN m + va / (va + m * m / 2 + 1e-10) * (x - m) END', 'filtered')} FROM w")
def lee_filter(s, d):
    df = A.calibrated(grid(s, d)).select("scene_id", "row", "col", (F.col("during_hh") * 1000).alias("x"))
    return rounded(focal.lee_filter(df, "x").select("row", "col", "filtered"))


_GAUSS = """, gw AS (SELECT o, exp(-0.5e0 * (o / 3e0) * (o / 3e0)) / (SELECT sum(exp(-0.5e0 * (p / 3e0) * (p / 3e0))) FROM range(-12, 13) y(p)) AS w FROM range(-12, 13) x(o)),
gz AS (SELECT max(r) + 1 AS h FROM px),
gf AS (SELECT k, o, w, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j, n FROM (SELECT k, o, w, h AS n, ((k + o) % (2 * h) + 2 * h) % (2 * h) AS m FROM (SELECT unnest(range((SELECT h FROM gz))) AS k), gw, gz)),
gc AS (SELECT k, o, w, CASE WHEN m < 100 THEN m ELSE 199 - m END AS j FROM (SELECT k, o, w, ((k + o) % 200 + 200) % 200 AS m FROM range(100) x(k), gw)),
gh AS (SELECT px.r, gc.k AS c, sum(w * z) AS z FROM px JOIN gc ON gc.j = px.c GROUP BY 1, 2),
gs AS (SELECT gf.k AS r, gh.c, sum(w * z) AS s FROM gh JOIN gf ON gf.j = gh.r GROUP BY 1, 2)"""


@query(f"WITH {PX}{_GAUSS} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('s', 'smooth')} FROM gs")
def gaussian(s, d):
    return rounded(focal.gaussian_smooth(grid(s, d).select("scene_id", "row", "col", "z"), "z").select("row", "col", "smooth"))


def _morph(source: str, steps: list[tuple[str, int]]) -> tuple[str, str]:
    """SQL for two-dimensional minima (``e``) and maxima (``d``) of k x k cells, in turn; cells outside are 0 for minima."""
    out, now = "", source
    for i, (kind, k) in enumerate(steps):
        h = k // 2
        agg = f"CASE WHEN count(*) = {k * k} AND min(b.v) = 1 THEN 1 ELSE 0 END" if kind == "e" else "max(b.v)"
        out += f", mo{i} AS (SELECT a.r, a.c, {agg} AS v FROM {now} a JOIN {now} b ON b.r BETWEEN a.r - {h} AND a.r + {h} AND b.c BETWEEN a.c - {h} AND a.c + {h} GROUP BY 1, 2)"
        now = f"mo{i}"
    return out, now


_IN = ", mi AS (SELECT r, c, CASE WHEN mask = 1 THEN 1 ELSE 0 END AS v FROM m)"
_OPEN, _CLOSE, _BOTH = _morph("mi", [("e", 3), ("d", 3)]), _morph("mi", [("d", 5), ("e", 5)]), _morph("mi", [("e", 3), ("d", 3), ("d", 5), ("e", 5)])


@query(f"WITH {OTSU}{_IN}{_OPEN[0]} SELECT r, c, v AS mask FROM {_OPEN[1]}")
def opening(s, d):
    return rounded(focal.opening(_masked(s, d).select("scene_id", "row", "col", "mask")).drop("scene_id"))


@query(f"WITH {OTSU}{_IN}{_CLOSE[0]} SELECT r, c, v AS mask FROM {_CLOSE[1]}")
def closing(s, d):
    return rounded(focal.closing(_masked(s, d).select("scene_id", "row", "col", "mask")).drop("scene_id"))


_HISTORY = "hy AS (SELECT event_id AS epoch, floor(value) / 600e0 AS iou FROM events)"


def _history(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("epoch"), (F.floor("value") / 600.0).alias("iou"))


@query(f"WITH {_HISTORY}, p AS (SELECT *, max(iou) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM hy) SELECT epoch, {R('iou')}, coalesce(iou > b, iou IS NOT NULL) AS improved, {R('greatest(iou, b)', 'best')} FROM p")
def best_checkpoint(s, d):
    return rounded(acc.best_checkpoint(_history(s, d)))


@query(f"WITH {_HISTORY} SELECT epoch, {R('iou')} FROM hy ORDER BY iou DESC NULLS LAST, epoch LIMIT 1")
def best_epoch(s, d):
    return rounded(acc.best_epoch(_history(s, d)))


@query(f"WITH {PX} SELECT id, CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label, CAST((row_number() OVER (PARTITION BY blk = 0 ORDER BY (id * 7919) % 10007, id) - 1) % 5 AS INTEGER) AS fold FROM px")
def folds(s, d):
    df = grid(s, d).selectExpr("id", "row", "col", "CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label")
    return ml.stratified_folds(df, 5, order=[F.expr("(id * 7919) % 10007"), F.col("id")]).select("id", "label", "fold")


@query(f"WITH {PX}, n AS (SELECT CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM px GROUP BY 1) SELECT label, n, {R('(sum(n) OVER ()) / ((count(*) OVER ()) * n)', 'weight')} FROM n")
def label_weights(s, d):
    return rounded(ml.label_balance(grid(s, d).selectExpr("CASE WHEN blk = 0 THEN 1 ELSE 0 END AS label")))


_LR = "4e-5 / 1e4"


@query(f"WITH n AS (SELECT count(*) AS n FROM events), x AS (SELECT event_id AS step, CAST(event_id AS DOUBLE) AS k, 0.1e0 * n - 1 AS top, n FROM events, n) SELECT step, round(CASE WHEN k <= top THEN 1e-3 + (4e-5 - 1e-3) / 2 * (1 + cos(pi() * (k / top))) ELSE {_LR} + (1e-3 - {_LR}) / 2 * (1 + cos(pi() * ((k - top) / (n - 1 - top)))) END, 10) + 0e0 AS lr FROM x")
def lr_curve(s, d):
    return rounded(ml.onecycle_lr(s, table(s, d, "events").count()), 10)


@query(f"WITH RECURSIVE {REGIONS} SELECT id, lab AS region FROM cc")
def regions_by_runs(s, d):
    found = regions.connected_regions(_masked(s, d))
    return found.select("id", F.expr(f"(region_id div {regions.STRIDE}) * 100 + region_id % {regions.STRIDE}").alias("region"))


@query(f"WITH RECURSIVE {REGIONS}, q AS (SELECT lab, count(*) AS n_px FROM cc GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n_px DESC, lab) AS INTEGER) AS place, n_px FROM q ORDER BY n_px DESC, lab LIMIT 10")
def largest_regions(s, d):
    from pyspark.sql import Window

    top = regions.largest_regions(regions.connected_regions(_masked(s, d)), 10)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n_px"), "region_id")  # ten rows
    return top.select(F.row_number().over(order).alias("place"), "n_px")


@query(f"WITH RECURSIVE {REGIONS}, q AS (SELECT lab FROM cc GROUP BY 1 HAVING count(*) >= 25) SELECT m.id, CASE WHEN q.lab IS NOT NULL THEN 1 ELSE 0 END AS mask FROM m LEFT JOIN cc ON cc.id = m.id LEFT JOIN q ON q.lab = cc.lab")
def sieve(s, d):
    return regions.sieve(_masked(s, d)).select("id", "mask")


_POST = f"""{PX}, mi AS (SELECT r, c, CASE WHEN (CASE WHEN blk = 0 THEN 0.6e0 ELSE 0.3e0 END) + (v % 7) / 20e0 >= 0.5 THEN 1 ELSE 0 END AS v FROM px){_BOTH[0]},
fl AS (SELECT r * 100 + c AS id, r, c FROM {_BOTH[1]} WHERE v = 1),
nb AS (SELECT a.id AS x, b.id AS y FROM fl a JOIN fl b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)),
ed AS (SELECT x, y FROM nb UNION ALL SELECT y, x FROM nb),
cc(id, lab) USING KEY (id) AS (SELECT id, id FROM fl UNION SELECT ed.x, min(o.lab) FROM ed JOIN recurring.cc o ON o.id = ed.y JOIN recurring.cc w ON w.id = ed.x WHERE o.lab < w.lab GROUP BY ed.x),
q AS (SELECT lab FROM cc GROUP BY 1 HAVING count(*) >= 25)"""


@query(f"WITH RECURSIVE {_POST} SELECT px.id, CASE WHEN q.lab IS NOT NULL THEN 1 ELSE 0 END AS mask FROM px LEFT JOIN cc ON cc.id = px.id LEFT JOIN q ON q.lab = cc.lab")
def postprocess(s, d):
    df = grid(s, d).withColumn("prob", F.when(F.col("blk") == 0, 0.6).otherwise(0.3) + (F.col("v") % 7) / 20.0)
    return regions.postprocess(df).select("id", "mask")


@query(f"""WITH RECURSIVE {REGIONS}, s4 AS (SELECT cc.lab, fl.id, (SELECT count(*) FROM fl o WHERE abs(o.r - fl.r) + abs(o.c - fl.c) = 1) AS k FROM cc JOIN fl USING (id))
SELECT lab AS region, count(*) AS n_px, {R('count(*) * 324e0', 'area_m2')}, {R('sum(4 - k) * 18e0', 'perimeter_m')} FROM s4 GROUP BY 1""")
def polygon_stats(s, d):
    out = regions.polygon_stats(regions.connected_regions(_masked(s, d)))
    return rounded(out.select(F.expr(f"(region_id div {regions.STRIDE}) * 100 + region_id % {regions.STRIDE}").alias("region"), "n_px", "area_m2", "perimeter_m"))


#: Rings of a four-connected region: two less its Euler number, which is cells less touching pairs and blocks of four.
RINGS = f"""{REGIONS}, lc AS (SELECT cc.id, cc.lab, fl.r, fl.c FROM cc JOIN fl USING (id)),
near AS (SELECT a.lab, a.id, (SELECT count(*) FROM fl o WHERE abs(o.r - a.r) + abs(o.c - a.c) = 1) AS k,
  (SELECT count(*) FROM fl o WHERE (o.r = a.r AND o.c = a.c + 1) OR (o.c = a.c AND o.r = a.r + 1)) AS e,
  CASE WHEN (SELECT count(*) FROM fl o WHERE o.r BETWEEN a.r AND a.r + 1 AND o.c BETWEEN a.c AND a.c + 1) = 4 THEN 1 ELSE 0 END AS q FROM lc a),
rings AS (SELECT lab AS region, CAST(2 - (count(*) - sum(e) + sum(q)) AS INTEGER) AS n_rings, count(*) AS n, sum(4 - k) AS edges FROM near GROUP BY 1)"""


def _outlines(s, d) -> DataFrame:
    out = outlines.polygonize(regions.connected_regions(_masked(s, d).select("scene_id", "row", "col", "mask")), 500000.0, 18.0, 2400000.0, -18.0)
    return out.withColumn("region", F.expr(f"(region_id div {regions.STRIDE}) * 100 + region_id % {regions.STRIDE}"))


@query(f"WITH RECURSIVE {RINGS} SELECT region, n_rings, {R('n * 324e0', 'area')}, {R('edges * 18e0', 'length')} FROM rings")
def polygon_rings(s, d):
    return rounded(regions.ring_table(_outlines(s, d)).select("region", "n_rings", "area", "length"))


@query(f"WITH RECURSIVE {RINGS} SELECT region, n_rings FROM rings")
def geojson_files(s, d):
    path = new_path(s, "geojson")
    io.write_geojson(_outlines(s, d), path, ["region"])
    back = s.read.schema("properties struct<region: long>, geometry struct<type: string, coordinates: array<array<array<double>>>>").json(path)
    return back.where("geometry.type = 'Polygon'").select("properties.region", F.size("geometry.coordinates").alias("n_rings"))


@query(f"WITH RECURSIVE {REGIONS}, q AS (SELECT lab, count(*) AS n_px FROM cc GROUP BY 1) SELECT id, n_px FROM cc JOIN q USING (lab)")
def region_values(s, d):
    found = snapshot(regions.connected_regions(_masked(s, d)), "regions")
    return regions.region_join(found, snapshot(regions.region_sizes(found), "sizes")).select("id", "n_px")


#: Sides of cells that face no cell, each with its successor: left turns before straight on before right turns. The smallest corner spreads along a ring, then the walk begins there.
_WALK = f"""{REGIONS},
sd AS (SELECT cc.lab, (fl.r * 100 + fl.c) * 4 + s AS k, s, fl.c, fl.r + a AS sr, fl.c + b AS sc, fl.r + p AS er, fl.c + q AS ec
  FROM cc JOIN fl USING (id), (VALUES (0, -1, 0, 0, 1, 0, 0), (1, 0, -1, 0, 0, 1, 0), (2, 1, 0, 1, 0, 1, 1), (3, 0, 1, 1, 1, 0, 1)) t(s, y, x, a, b, p, q)
  WHERE NOT EXISTS (SELECT 1 FROM fl o WHERE o.r = fl.r + y AND o.c = fl.c + x)),
nx AS (SELECT e.k, any_value(e.lab) AS lab, any_value(e.er) AS er, any_value(e.ec) AS ec, any_value(CASE e.s WHEN 1 THEN -e.c WHEN 3 THEN e.c + 1 ELSE 0 END) AS turn,
    arg_min(f.k, CASE (f.s - e.s + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nk, arg_min(f.s, CASE (f.s - e.s + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) <> any_value(e.s) AS bend
  FROM sd e JOIN sd f ON f.sr = e.er AND f.sc = e.ec AND f.lab = e.lab GROUP BY e.k),
lo(k, low) USING KEY (k) AS (
  SELECT k, CASE WHEN bend THEN er * 101 + ec ELSE 999999999 END FROM nx
  UNION
  SELECT nx.k, o.low FROM nx JOIN recurring.lo o ON o.k = nx.nk JOIN recurring.lo m ON m.k = nx.k WHERE o.low < m.low),
wk(first, k, step) AS (SELECT nx.k, nx.k, 0 FROM nx JOIN lo ON lo.k = nx.k WHERE bend AND er * 101 + ec = low UNION ALL SELECT wk.first, nx.nk, step + 1 FROM wk JOIN nx USING (k) WHERE nx.nk <> wk.first),
rg AS (SELECT first, any_value(lab) AS lab, sum(turn) < 0 AS hole, arg_min(er * 101 + ec, step) AS low, string_agg(CASE WHEN bend THEN (500000 + ec * 18) || ' ' || (2400000 - er * 18) END, ', ' ORDER BY step) AS body, arg_min((500000 + ec * 18) || ' ' || (2400000 - er * 18), step) AS home FROM wk JOIN nx USING (k) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_WALK} SELECT CAST(lab // 100 AS BIGINT) * 2147483648 + lab % 100 AS region_id, 'POLYGON (' || string_agg('(' || body || ', ' || home || ')', ', ' ORDER BY hole, low) || ')' AS geometry FROM rg GROUP BY lab")
def polygons(s, d):
    return outlines.polygonize(regions.connected_regions(_masked(s, d)), 500000.0, 18.0, 2400000.0, -18.0).select("region_id", "geometry")


@query(f"WITH RECURSIVE {REGIONS} SELECT lab AS region, count(*) AS n_px, {R('quantile_cont(z, 0.9)', 'wse')} FROM cc JOIN fl USING (id) GROUP BY 1 HAVING count(*) >= 5")
def zonal_p90(s, d):
    out = depth.zonal_percentile(regions.connected_regions(_masked(s, d)), "z")
    return rounded(out.select(F.expr(f"(region_id div {regions.STRIDE}) * 100 + region_id % {regions.STRIDE}").alias("region"), "n_px", "wse"))


_DEPTH = f"{REGIONS}{_GAUSS}, dz AS (SELECT cc.id, cc.lab, gs.s FROM cc JOIN fl USING (id) JOIN gs ON gs.r = fl.r AND gs.c = fl.c), dw AS (SELECT lab, quantile_cont(s, 0.9) AS wse FROM dz GROUP BY 1 HAVING count(*) >= 5), dd AS (SELECT dz.id, coalesce(greatest(wse - s, 0e0), 0e0) AS depth FROM dz LEFT JOIN dw USING (lab))"


@query(f"WITH RECURSIVE {_DEPTH} SELECT m.id, {R('dd.depth', 'depth')} FROM m LEFT JOIN dd USING (id)")
def flood_depth(s, d):
    return rounded(depth.flood_depth(_masked(s, d)).select("id", "depth"))


@query(f"WITH RECURSIVE {_DEPTH} SELECT {R('min(depth)', 'min_depth')}, {R('avg(depth)', 'mean_depth')}, {R('quantile_cont(depth, 0.5)', 'median_depth')}, {R('max(depth)', 'max_depth')} FROM dd")
def depth_summary(s, d):
    return rounded(depth.depth_summary(depth.flood_depth(_masked(s, d))))


@query(f"""WITH {PX}, k AS (SELECT CASE WHEN v / 10e0 >= 6.5 THEN 14 ELSE CAST(floor(v / 10e0 * 2) AS INTEGER) + 1 END AS cl FROM px WHERE v % 17 <> 3),
n AS (SELECT cl, count(*) AS n FROM k GROUP BY 1), t AS (SELECT count(*) AS t FROM k)
SELECT CAST(i AS INTEGER) AS class, coalesce(n, 0) AS pixels, {R('coalesce(n, 0) * 324e0 / 10000', 'area_ha')}, {R('coalesce(n, 0) * 100e0 / t', 'pct')} FROM range(1, 15) x(i) CROSS JOIN t LEFT JOIN n ON cl = i""")
def depth_stats(s, d):
    df = grid(s, d).withColumn("depth", F.when(F.col("v") % 17 != 3, F.col("v") / 10.0))
    return rounded(depth.depth_class_stats(depth.depth_classes(df)).drop("label"))


@query(f"""WITH {PX}, q AS (SELECT r, c, r // 32 AS tr, c // 32 AS tc, CASE WHEN id % 89 <> 0 THEN CAST((blk * 9 + v) % 16 AS BIGINT) END AS q FROM px),
sd AS (SELECT tr, tc FROM q GROUP BY 1, 2 HAVING (max(r) - min(r) + 1) * (max(c) - min(c) + 1) >= 4),
p AS (SELECT a.tr, a.tc, a.q AS i, b.q AS j FROM q a JOIN q b ON a.r = b.r AND b.c = a.c + 1 AND a.tc = b.tc WHERE a.q IS NOT NULL AND b.q IS NOT NULL),
u AS (SELECT tr, tc, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT tr, tc, j, i FROM p) GROUP BY 1, 2, 3, 4),
t AS (SELECT tr, tc, CAST(sum(n) AS DOUBLE) AS nn, sum(n * (i - j) * (i - j)) AS d2, CAST(sum(n * i) AS DOUBLE) AS si, CAST(sum(n * i * i) AS DOUBLE) AS sii, CAST(sum(n * i * j) AS DOUBLE) AS sij, CAST(sum(n * n) AS DOUBLE) AS sq, sum(n / (1e0 + (i - j) * (i - j))) AS hom FROM u GROUP BY 1, 2)
SELECT CAST(tr AS INTEGER) AS tile_r, CAST(tc AS INTEGER) AS tile_c, {R('d2 / nn', 'contrast')}, {R('CASE WHEN sii / nn - (si / nn) * (si / nn) < 1e-12 THEN 1e0 ELSE (sij / nn - (si / nn) * (si / nn)) / (sii / nn - (si / nn) * (si / nn)) END', 'correlation')}, {R('sqrt(sq) / nn', 'energy')}, {R('hom / nn', 'homogeneity')} FROM t JOIN sd USING (tr, tc)""")
def glcm(s, d):
    df = grid(s, d).withColumn("q", F.when(F.col("id") % 89 != 0, (F.col("blk") * 9 + F.col("v")) % 16))
    return rounded(texture.glcm_texture(df, "q", 32).drop("scene_id"))


_GLCM = f"""WITH {FEAT}, p2 AS (SELECT quantile_cont(during_hh_db, 0.02) AS lo, quantile_cont(during_hh_db, 0.98) AS hi FROM feat),
q AS (SELECT r, c, r // 32 AS tr, c // 32 AS tc, CASE WHEN during_hh_db IS NOT NULL THEN CAST(floor(greatest(0e0, least(1e0, (during_hh_db - lo) / (hi - lo))) * 63) AS BIGINT) END AS q FROM feat, p2),"""


@query(_GLCM + ORACLES["glcm"].partition("AS q FROM px),")[2])
def glcm_levels(s, d):
    df = texture.quantise(_features(s, d).select("scene_id", "row", "col", "during_hh_db"), "during_hh_db", 64)
    return rounded(texture.glcm_texture(df, "q", 32).drop("scene_id"))


@query(f"WITH {PX} SELECT CAST(r // 32 AS INTEGER) AS tile_r, CAST(c // 32 AS INTEGER) AS tile_c, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM px GROUP BY 1, 2")
def tile_grid(s, d):
    return patches.tile_grid(grid(s, d), 32).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(f"WITH {PX}, sz AS (SELECT max(r) AS h FROM px) SELECT CAST(a.r AS INTEGER) AS r, CAST(k.c AS INTEGER) AS c, CASE WHEN px.before_hh <> 0 THEN v END AS v FROM (SELECT unnest(range((SELECT h + 1 FROM sz))) AS r) a CROSS JOIN range(100) k(c) LEFT JOIN px ON px.r = a.r AND px.c = k.c")
def densify(s, d):
    g = grid(s, d)
    sizes = focal.grid_sizes(g)
    return rounded(resample.densify(g.where("before_hh <> 0").select("scene_id", "row", "col", "v"), sizes).select("row", "col", "v"))


@query(f"WITH {OTSU} SELECT id, {R('db')} FROM m WHERE r >= 2 AND r < 8 AND c >= 10 AND c < 16")
def window_read(s, d):
    from rasterjobs.sources.io import window_read as read

    return rounded(read(_masked(s, d), 2, 10, 6).select("id", "db"))


_REPORT = f"WITH {OTSU}, {_CONF.format(by='', p='mask', r='ref', t='m', g='')}, a AS (SELECT count(*) FILTER (mask = 1) AS n, count(*) AS t FROM m)"


@query(f"{_REPORT} SELECT 'otsu' AS model, CAST(n AS BIGINT) AS flood_pixels, round(n * 324e0 / 10000, 2) AS flood_area_ha, round(n * 100e0 / t, 3) AS flood_pct, 18e0 AS pixel_spacing_m, t AS total_pixels, {R(_IOU, 'iou_flood', 4)}, {R(_KAPPA, 'kappa', 4)}, {R(_OA, 'overall_accuracy', 4)}, {R(_F1, 'f1_flood', 4)}, {R(_PR, 'precision_flood', 4)}, {R(_RE, 'recall_flood', 4)}, tp, fp, fn, tn FROM k, a")
def flood_report(s, d):
    names = ["flood_pixels", "flood_area_ha", "flood_pct", "pixel_spacing_m", "total_pixels", "iou_flood", "kappa", "overall_accuracy", "f1_flood", "precision_flood", "recall_flood", "tp", "fp", "fn", "tn"]
    return report.flood_report(_masked(s, d), "otsu", "mask", "ref").select("model", *[f"flood_stats.{c}" for c in names])


@query(f"""{_REPORT}, x AS (SELECT ['Model: otsu', 'Flood pixels: ' || format('{{:,}}', CAST(n AS BIGINT)), 'Flood area (ha): ' || format('{{:,.2f}}', n * 324e0 / 10000), 'Flood share (%): ' || printf('%.3f', n * 100e0 / t),
'Overall accuracy: ' || printf('%.4f', {_OA}), 'IoU: ' || printf('%.4f', {_IOU}), 'F1: ' || printf('%.4f', {_F1}), 'Precision: ' || printf('%.4f', {_PR}), 'Recall: ' || printf('%.4f', {_RE}), 'Kappa: ' || printf('%.4f', {_KAPPA})] AS l FROM k, a)
SELECT CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM x""")
def text_report(s, d):
    return report.text_report(report.flood_report(_masked(s, d), "otsu", "mask", "ref"))
