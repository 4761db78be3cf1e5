"""Reports as one nested row or as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.operators.accuracy import accuracy_scores, confusion, mask_area

STATS = ["flood_pixels", "flood_area_ha", "flood_pct", "pixel_spacing_m", "total_pixels"]
SCORES = ["overall_accuracy", "iou", "f1", "precision", "recall", "kappa", "tp", "fp", "fn", "tn"]
_NAMES = {"iou": "iou_flood", "f1": "f1_flood", "precision": "precision_flood", "recall": "recall_flood"}


def flood_report(df: DataFrame, model: str, mask: str = "mask", ref: str | None = None, pixel_m: float = 18.0) -> DataFrame:
    """``(model, flood_stats)``: area statistics, and scores if there is a reference column."""
    out = mask_area(df, mask, pixel_m).withColumns({"pixel_spacing_m": F.lit(float(pixel_m)), "flood_area_ha": F.round("flood_area_ha", 2), "flood_pct": F.round("flood_pct", 3)})
    names = STATS
    if ref is not None:
        out = out.crossJoin(F.broadcast(accuracy_scores(confusion(df, mask, ref))))  # one row each
        names = STATS + SCORES
    return out.select(F.lit(model).alias("model"), F.struct(*[F.col(c).alias(_NAMES.get(c, c)) for c in names]).alias("flood_stats"))


def text_report(report: DataFrame) -> DataFrame:
    """``(line_no, line)``: a report with scores as formatted lines."""
    s = lambda c: F.col(f"flood_stats.{c}")
    lines = [F.concat(F.lit("Model: "), F.col("model")), F.concat(F.lit("Flood pixels: "), F.format_number(s("flood_pixels"), 0)), F.concat(F.lit("Flood area (ha): "), F.format_number(s("flood_area_ha"), 2)), F.concat(F.lit("Flood share (%): "), F.format_string("%.3f", s("flood_pct")))]
    names = {"overall_accuracy": "Overall accuracy", "iou_flood": "IoU", "f1_flood": "F1", "precision_flood": "Precision", "recall_flood": "Recall", "kappa": "Kappa"}
    lines += [F.concat(F.lit(f"{label}: "), F.format_string("%.4f", s(c))) for c, label in names.items()]
    return report.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def training_curves(history: DataFrame) -> DataFrame:
    return history.select("epoch", "train_loss", "val_loss", "iou", "f1", "oa").orderBy("epoch")
