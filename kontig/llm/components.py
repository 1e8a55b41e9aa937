"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations and joins over the edges, so a hub of any degree is split by
partial minima and skew joins; nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it reaches.

    Null ends are ignored, loops and repeated edges are harmless, no edges give no rows. A hub is never
    gathered: its edges meet as partial minima and in joins that adaptive execution splits.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    u, v = F.col(src), F.col(dst)
    e = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = scratch.write(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, scratch.write(small, "edges")
        scratch.drop(before)
        after = _state(e)
        if after == state:
            break
        state = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
