"""Queries of the first workload's end and of the classifiers.

Calibrated backscatter tells the blocks of water apart without error, so a classifier that works gives exactly
the blocks; the SQL says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.functions import algebra as A
from rasterjobs.operators import contributions, ml
from rasterjobs.operators.accuracy import accuracy_scores, confusion
from rasterjobs.plans import workloads
from rasterjobs.plans.grid import FEAT, LIN, grid
from rasterjobs.plans.registry import R, query, rounded
from rasterjobs.runtime import snapshot
from rasterjobs.schema import BANDS, FEATURES

_VALID = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_BLOCKS = f"WITH {FEAT} SELECT id, CASE WHEN {_VALID} THEN CASE WHEN blk = 0 THEN 1 ELSE 0 END END AS mask FROM feat"


def _samples(s, d) -> DataFrame:
    df = A.basic_features(A.calibrated(grid(s, d))).select("scene_id", "row", "col", "id", "blk", *FEATURES)
    return snapshot(df.withColumn("label", (F.col("blk") == 0).cast("int")), "features")  # training reads it several times


def _map(s, d, train) -> DataFrame:
    df = _samples(s, d)
    return ml.predict_map(train(df), df.select("scene_id", "row", "col", "id", *FEATURES), FEATURES).select("id", "mask")


@query(_BLOCKS)
def rf_map(s, d):
    return _map(s, d, lambda x: ml.train_random_forest(x, FEATURES, trees=10, depth=5))


@query(_BLOCKS)
def boosted_map(s, d):
    return _map(s, d, lambda x: ml.train_boosted_trees(x, FEATURES, rounds=4, rate=0.5, depth=3))


@query(_BLOCKS)
def svm_map(s, d):
    return _map(s, d, lambda x: ml.train_svm(x, FEATURES, width=64))


@query(f"""WITH {FEAT}, f AS (SELECT blk, (row_number() OVER (PARTITION BY blk = 0 ORDER BY id) - 1) % 3 AS fold FROM feat WHERE {_VALID}),
k AS (SELECT fold, CAST(count(*) FILTER (blk = 0) AS DOUBLE) AS tp FROM f GROUP BY 1), p AS (SELECT tp / (tp + 1e-6) AS p FROM k), s AS (SELECT 2 * p * p / (p + p + 1e-6) AS f1 FROM p)
SELECT {R('avg(f1)', 'mean_f1', 4)}, {R('stddev_pop(f1)', 'std_f1', 4)} FROM s""")
def cross_validation(s, d):
    df = _samples(s, d)
    return rounded(ml.cross_validate_f1(A.valid_only(df, FEATURES), FEATURES, lambda x, f: ml.train_random_forest(x, f, trees=5, depth=4), 3), 4)


@query(f"WITH {FEAT} SELECT 8 AS n, 1e0 AS total, TRUE AS ranked, count(*) FILTER ({_VALID}) AS samples FROM feat")
def importance(s, d):
    df = _samples(s, d)
    found = ml.rank_importance(ml.train_random_forest(df, FEATURES, trees=5, depth=4), FEATURES, s)
    values = F.collect_list("importance").alias("v")  # eight rows
    out = found.agg(F.count(F.lit(1)).cast("int").alias("n"), F.round(F.sum("importance"), 6).alias("total"), values)
    samples = A.valid_only(df, FEATURES).agg(F.count(F.lit(1)).alias("samples"))
    falling = F.expr("v = reverse(array_sort(v)) and array_min(v) >= 0")
    return out.crossJoin(F.broadcast(samples)).select("n", "total", falling.alias("ranked"), "samples")  # one row each


#: A tenth of all labels is turned, so no model can be right on them; the blocks are the best rule there is.
_TURNED = "(blk = 0) <> (id * 7919 % 100 < 10)"


@query(f"""WITH {FEAT}, t AS (SELECT blk = 0 AS pred, {_TURNED} AS label FROM feat WHERE {_VALID} AND id % 3 = 0),
k AS (SELECT count(*) AS n, CAST(count(*) FILTER (pred AND label) AS DOUBLE) AS tp, count(*) FILTER (pred) AS p, count(*) FILTER (label) AS r FROM t)
SELECT unnest(['boosted trees', 'random forest', 'svm']) AS model, n AS held_out, {R('2 * tp / (p + r)', 'best_f1', 3)}, TRUE AS near FROM k""")
def held_out_scores(s, d):
    """Models learn from two thirds of the rows with turned labels; F1 on the others, which they haven't seen, is near the best rule's."""
    df = _samples(s, d).where(_VALID).withColumn("label", F.expr(f"cast({_TURNED} AS int)"))
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0").withColumn("rule", (F.col("blk") == 0).cast("int"))
    models = {"boosted trees": ml.train_boosted_trees(train, FEATURES, rounds=5, rate=0.3, depth=3), "random forest": ml.train_random_forest(train, FEATURES, trees=10, min_leaf=20, depth=5), "svm": ml.train_svm(train, FEATURES, width=64)}
    best = accuracy_scores(confusion(test, "rule", "label"), None).select(F.col("f1").alias("best"))
    held = test.agg(F.count(F.lit(1)).alias("held_out"))
    out = None
    for name, model in models.items():
        scored = model.transform(test).withColumn("pred", F.col("prediction").cast("int"))
        one = accuracy_scores(confusion(scored, "pred", "label"), None).select(F.lit(name).alias("model"), "f1")
        out = one if out is None else out.unionByName(one)
    whole = out.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(held))  # one row each
    return rounded(whole.select("model", "held_out", F.col("best").alias("best_f1"), (F.abs(F.col("f1") - F.col("best")) < 0.03).alias("near")), 3)


@query(_BLOCKS)
def contribution_map(s, d):
    """The sum of base and contributions decides as the forest does."""
    df = _samples(s, d)
    made = contributions.contributions(ml.train_random_forest(df, FEATURES, trees=10, depth=5), df.select("id", *FEATURES), FEATURES)
    share = sum((F.col(f"phi_{f}") for f in FEATURES), F.col("base"))
    return made.select("id", (share > 0.5).cast("int").alias("mask"))


@query(f"WITH {FEAT} SELECT r, c, {', '.join(map(R, FEATURES))} FROM feat ORDER BY r, c LIMIT 500")
def head_rows(s, d):
    return rounded(ml.head_sample(A.feature_stack(A.basic_features(A.calibrated(grid(s, d)))), 500).drop("scene_id"))


def _lee(band: str) -> str:
    """CTE ``l_<band>``: the speckle filter with window 7 and two looks, on mirrored edges."""
    n = f"{band}"
    return f""", k_{n} AS (SELECT r, c, coalesce({band}, 0) AS x FROM lin),
h_{n} AS (SELECT a.r, k.c, sum(a.x) AS x, sum(a.x * a.x) AS q FROM range(100) k(c), range(-3, 4) o(o), k_{n} a WHERE a.c = CASE WHEN k.c + o < 0 THEN -1 - (k.c + o) WHEN k.c + o > 99 THEN 199 - (k.c + o) ELSE k.c + o END GROUP BY 1, 2),
v_{n} AS (SELECT k.r, a.c, sum(a.x) / 49 AS m, sum(a.q) / 49 AS m2 FROM (SELECT unnest(range((SELECT h FROM sz))) AS r) k, sz, range(-3, 4) o(o), h_{n} a WHERE a.r = CASE WHEN k.r + o < 0 THEN -1 - (k.r + o) WHEN k.r + o > h - 1 THEN 2 * h - 1 - (k.r + o) ELSE k.r + o END GROUP BY 1, 2),
l_{n} AS (SELECT f.id, CASE WHEN {band} IS NOT NULL THEN m + greatest(m2 - m * m, 0e0) / (greatest(m2 - m * m, 0e0) + m * m / 2 + 1e-10) * ({band} - m) END AS {band} FROM v_{n} v JOIN lin f ON f.r = v.r AND f.c = v.c)"""


_STATS = f"WITH {LIN}, sz AS (SELECT max(r) + 1 AS h FROM px)" + "".join(map(_lee, BANDS)) + f""",
g4 AS (SELECT * FROM l_before_hh JOIN l_before_hv USING (id) JOIN l_during_hh USING (id) JOIN l_during_hv USING (id)),
db AS (SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN 10 * log10({b}) END AS {b}_db' for b in BANDS)} FROM g4),
fe AS (SELECT during_hh_db, during_hv_db, before_hh_db, before_hv_db, during_hh_db - before_hh_db AS delta_hh, during_hv_db - before_hv_db AS delta_hv, during_hh / during_hv AS during_cr, (during_hh - during_hv) / (during_hh + during_hv) AS during_rfdi FROM db),
u AS (UNPIVOT fe ON {', '.join(FEATURES)} INTO NAME channel VALUE x)
SELECT channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')} FROM u GROUP BY channel"""


@query(_STATS)
def preprocess_stats(s, d):
    """Calibrate, despeckle, features: the statistics of the eight channels."""
    return rounded(workloads.preprocess(grid(s, d))[1])
