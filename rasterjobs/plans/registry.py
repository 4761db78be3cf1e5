"""Registered queries and their SQL, and what both sides share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero gone, pixel keys by short names."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, digits) + 0.0 if kind == "double" else c).alias({"row": "r", "col": "c"}.get(name, name)))
    return df.select(*out)


def R(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0 AS {name or x}"
