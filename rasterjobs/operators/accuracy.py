"""Areas, confusion counts, scores, votes and training metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.ranked import in_ranges

_EPS = 1e-6


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def mask_area(df: DataFrame, mask: str = "mask", pixel_m: float = 18.0, of_valid: bool = False, by: list[str] | None = None) -> DataFrame:
    """``(flood_pixels, total_pixels, flood_area_ha, flood_pct)``; percent of all pixels, or of valid ones."""
    m = F.col(mask)
    out = df.groupBy(*(by or [])).agg(_sum(m == 1).alias("flood_pixels"), F.count(F.lit(1)).alias("total_pixels"), _sum(m.isin(0, 1)).alias("__valid"))
    whole = F.col("__valid") if of_valid else F.col("total_pixels")
    return out.withColumns({"flood_area_ha": F.col("flood_pixels") * (pixel_m * pixel_m) / 10000, "flood_pct": F.try_divide(F.col("flood_pixels") * 100.0, whole)}).drop("__valid")


def confusion(df: DataFrame, pred: str = "pred", ref: str = "ref", by: list[str] | None = None) -> DataFrame:
    """``(by..., tp, fp, fn, tn)`` over rows whose reference is 0 or 1 (255 and NULL are ignored); a missing prediction is 0."""
    p, r = F.coalesce(F.col(pred), F.lit(0)) == 1, F.col(ref)
    return df.groupBy(*(by or [])).agg(_sum(p & (r == 1)).alias("tp"), _sum(p & (r == 0)).alias("fp"), _sum(~p & (r == 1)).alias("fn"), _sum(~p & (r == 0)).alias("tn"))


def accuracy_scores(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Adds overall accuracy, IoU, F1, precision, recall and kappa, guarded by 1e-6; kappa is NULL without valid pixels."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = tp / (tp + fp + _EPS), tp / (tp + fn + _EPS)
    oa = (tp + tn) / (n + _EPS)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    made = {"overall_accuracy": oa, "iou": tp / (tp + fp + fn + _EPS), "f1": 2 * precision * recall / (precision + recall + _EPS), "precision": precision, "recall": recall, "kappa": (oa - chance) / (1 - chance + _EPS)}
    return counts.withColumns({k: v if digits is None else F.round(v, digits) for k, v in made.items()})


def accuracy_report(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    return accuracy_scores(confusion(df, pred, ref))


def batch_metrics(df: DataFrame, batch: str = "batch", pred: str = "pred", ref: str = "ref") -> DataFrame:
    """One row: IoU, F1 and accuracy of each batch, averaged over batches."""
    each = accuracy_scores(confusion(df, pred, ref, [batch]), None)
    return each.agg(*[F.avg(c).alias(n) for c, n in (("iou", "iou"), ("f1", "f1"), ("overall_accuracy", "oa"))])


def segmentation_loss(df: DataFrame, batch: str = "batch", logit: str = "logit", ref: str = "ref", pos_weight: float = 1.0) -> DataFrame:
    """``(batch, loss)``: half the mean weighted cross-entropy of logits plus half of one minus Dice (smoothing 1); 0 without valid pixels."""
    x, t = F.col(logit).cast("double"), F.col(ref).cast("double")
    valid = F.col(ref).isin(0, 1)
    # log(1 + exp(-x)) without overflow
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    bce = (1 - t) * x + (1 + (pos_weight - 1) * t) * soft
    p = 1 / (1 + F.exp(-x))
    sums = df.groupBy(batch).agg(F.avg(F.when(valid, bce)).alias("bce"), F.sum(F.when(valid, p * t)).alias("pt"), F.sum(F.when(valid, p)).alias("p"), F.sum(F.when(valid, t)).alias("t"))
    dice = (2 * F.col("pt") + 1) / (F.col("p") + F.col("t") + 1)
    return sums.select(batch, F.coalesce(0.5 * F.col("bce") + 0.5 * (1 - dice), F.lit(0.0)).alias("loss"))


def union_masks(maps: dict[str, DataFrame]) -> DataFrame:
    """Long vote table: the maps' rows with their name as ``source``."""
    out = None
    for name, df in maps.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def ensemble_vote(votes: DataFrame, weights: dict[str, float], cut: float = 0.5) -> DataFrame:
    """``(scene_id, row, col, mask)``: weighted majority of a long vote table. A missing vote is no flood; its weight still counts."""
    w = F.create_map(*[F.lit(v) for name, x in weights.items() for v in (name, float(x))])[F.col("source")]
    share = F.try_divide(F.sum(F.when(F.col("mask") == 1, w).otherwise(0.0)), F.sum(w))
    return votes.groupBy("scene_id", "row", "col").agg((share >= cut).cast("int").alias("mask"))


def vote_columns(masks: dict[str, float], cut: float = 0.5) -> Column:
    """The same over mask columns of one wide row: ``masks`` maps column to weight. No shuffle."""
    total = float(sum(masks.values()))
    got = sum((F.when(F.col(c) == 1, F.lit(float(w))).otherwise(0.0) for c, w in masks.items()), F.lit(0.0))
    return (got / total >= cut).cast("int")


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that are 1 in both."""
    key = ["scene_id", "row", "col"]
    return a.where("mask = 1").select(*key).intersect(b.where("mask = 1").select(*key))


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that are 1 in ``a`` and not in ``b``."""
    key = ["scene_id", "row", "col"]
    return a.where("mask = 1").select(*key).subtract(b.where("mask = 1").select(*key))


def best_checkpoint(history: DataFrame, score: str = "iou") -> DataFrame:
    """``history`` with the best score so far and whether the epoch improves on all before it.

    The best of earlier ranges of epochs, and of earlier epochs in the same range: histories of many runs' steps are large.
    """
    placed = in_ranges(history, ["epoch"])
    tops = placed.groupBy("__range").agg(F.max(score).alias("__top"))
    tops = tops.select("__range", F.max("__top").over(Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__top"))  # a row per range
    inside = F.max(score).over(Window.partitionBy("__range").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.join(F.broadcast(tops), "__range").withColumn("__best", F.greatest(inside, "__top"))
    rows = rows.withColumn("improved", F.coalesce(F.col(score) > F.col("__best"), F.col(score).isNotNull())).withColumn("best", F.greatest(F.col(score), F.col("__best")))
    return rows.select(*history.columns, "improved", "best")


def best_epoch(history: DataFrame, score: str = "iou") -> DataFrame:
    return history.orderBy(F.desc_nulls_last(score), "epoch").limit(1)
