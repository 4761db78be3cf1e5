"""Schemas and fixed values. Missing pixels are NULL inside the library; sentinels exist only at its edges."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["scene_id", "row", "col"]
BANDS = ["before_hh", "before_hv", "during_hh", "during_hv"]
#: Nodata by kind of raster.
NODATA = {"dn": 0.0, "mask": 255, "prob": -9999.0, "depth": -9999.0, "depth_class": 0}
#: Noise bias by date and polarisation, and the common calibration constant in dB.
NOISE_BIAS = {("before", "HH"): 13783.756, ("before", "HV"): 12172.063, ("during", "HH"): 14173.494, ("during", "HV"): 12088.514}
CAL_CONST = 68.664
#: Order of the eight feature channels.
FEATURES = ["during_hh_db", "during_hv_db", "before_hh_db", "before_hv_db", "delta_hh", "delta_hv", "during_cr", "during_rfdi"]


def pixels(*bands: str) -> T.StructType:
    key = [T.StructField("scene_id", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    return T.StructType([*key, *(T.StructField(b, T.DoubleType()) for b in bands)])


SAMPLES = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("label", T.IntegerType())])
HISTORY = T.StructType([T.StructField("epoch", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("train_loss", "val_loss", "iou", "f1", "oa"))])
