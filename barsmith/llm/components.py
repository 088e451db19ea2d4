"""Connected components of a stored edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _sum(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) of every node with an edge; edges: long columns u, v. Reads a stored table.

    Each round halves paths, so rounds grow with the logarithm of the longest one.
    Minima are pre-aggregated and written before they are joined back, so that
    a hub's join can be split.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _sum(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        star = stored(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        low = stored(star.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        drop_stored(e, least, star, low)
        e, before, state = after, state, _sum(after)
        if state == before:
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._barsmith_path = e._barsmith_path
    return out
