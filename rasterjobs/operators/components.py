"""Connected components of an edge table by large-star / small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.runtime import drop, snapshot


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is the smallest node reachable.

    Null ends and self links are dropped; repeated edges count once; no edges give an empty table. Every
    round is two grouped minima, each pre-aggregated, joined back to the edges (AQE splits hot keys), and is
    written to the shared folder, so lineage stays short. Rounds grow with the logarithm of the graph.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = snapshot(e.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct(), "cc")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = snapshot(small.unionByName(low2.withColumnRenamed("m", "v")).where("u <> v").distinct(), "cc")
        drop(e)
        e, before = nxt, state
        state = _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
