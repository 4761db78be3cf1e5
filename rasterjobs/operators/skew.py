"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys count as hot, and a small table of no more rows is broadcast whole; a key of fewer rows than LEAST_HOT is never hot.
HOT_KEYS, LEAST_HOT = 100_000, 1_000


def salted_join(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, spread: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and, in ``count``, how many ``rows`` the key has.

    A key with more than one HOT_KEYS-th of all rows is dealt over salts by a hash of the columns ``spread``, and its
    row of ``table`` is repeated for each of them; only hot keys are broadcast. With ``small``, for tables that
    seldom grow with the data, a ``table`` of at most HOT_KEYS rows is broadcast whole. It is read several times, so it should
    be a snapshot.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total, n = table.agg(F.sum(count), F.count(F.lit(1))).first()
    if small and n <= HOT_KEYS:
        return rows.join(F.broadcast(table), keys, how)
    limit = max(LEAST_HOT, (total or 0) // HOT_KEYS)
    salts = F.ceil(F.col(count) / limit).cast("int")
    hot = table.where(F.col(count) > limit).select(*keys, salts.alias("__salts"))
    if hot.isEmpty():
        return rows.join(table, keys, how)
    placed = rows.join(F.broadcast(hot), keys, "left")
    placed = placed.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    each = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return placed.join(each, [*keys, "__salt"], how).drop("__salt")
