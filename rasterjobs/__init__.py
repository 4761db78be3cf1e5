"""Batch jobs on Spark for mapping change in multi-date radar rasters (pixels are rows)."""
