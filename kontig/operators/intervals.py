"""Operators on closed integer intervals [lo, hi] under a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Positions of a bin; what the bins before hold of a key goes to the next as one row, so that no window holds a whole key.
BIN = 65_536


#: Rows of a partition where a table has more than Spark's own number of partitions takes: a task's memory does not grow with the table.
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about ``rows`` rows, in partitions by ``by`` of about PART_ROWS; as it is where the session's number of shuffle partitions does."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _carried(df: DataFrame, key: str, value: Column, how) -> DataFrame:
    """``df`` (with ``_bin``) with ``_before``: the aggregate ``how`` of ``value`` over the bins before; null in the first."""
    before = W.partitionBy(key).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    each = df.groupBy(key, "_bin").agg(how(value).alias("_own"))
    return df.join(each.select(key, "_bin", how("_own").over(before).alias("_before")), [key, "_bin"])


def _numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the running number of its ``_new`` rows as ``name``."""
    upto = W.partitionBy(key, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = _carried(df, key, F.col("_new"), F.sum)
    return carried.withColumn(name, F.sum("_new").over(upto) + F.coalesce("_before", F.lit(0))).drop("_new", "_before", "_bin")


def islands(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi", touching: int = 0) -> DataFrame:
    """``df`` with ``island``, numbering runs of overlapping intervals (or at most ``touching`` apart) from 1."""
    carried = _carried(df.withColumn("_bin", F.floor(F.col(lo) / BIN)), key, F.col(hi), F.max)
    before = W.partitionBy(key, "_bin").orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.max(hi).over(before), F.col("_before"))  # the one that is not null
    marked = carried.withColumn("_new", F.when(F.col(lo) <= reach + touching, 0).otherwise(1)).drop("_before")
    return _numbered(marked, key, [lo, hi], "island")


def _merged(df: DataFrame, key: str, lo: str, hi: str, touching: int, aggregates: dict[str, tuple[Column, Callable[[str], Column]]], size: int = 0) -> DataFrame:
    """(key, island, lo, hi, *aggregates) of the islands, numbered from 1; ``aggregates`` are what a name is of rows, and how parts of it are put together.

    Runs within a bin are merged first, in one shuffle of the rows, of which ``size`` says how many there are if they may be many; only what is left of them, a row for each run, meets by key.
    """
    within = W.partitionBy(key, "_bin").orderBy(lo, hi)
    rows = dealt(df.withColumn("_bin", F.floor(F.col(lo) / BIN)), size, key, "_bin")
    new = F.when(F.col(lo) <= F.max(hi).over(within.rowsBetween(W.unboundedPreceding, -1)) + touching, 0).otherwise(1)
    local = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = local.groupBy(key, "_bin", "_run").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"), *[rule.alias(name) for name, (rule, _) in aggregates.items()])
    order = W.partitionBy(key).orderBy("_lo", "_hi")
    begins = F.when(F.col("_lo") <= F.max("_hi").over(order.rowsBetween(W.unboundedPreceding, -1)) + touching, 0).otherwise(1)
    numbered = runs.withColumn("_new", begins).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(key, "island").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), *[join(name).alias(name) for name, (_, join) in aggregates.items()])


def union(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, lo, hi): disjoint intervals that cover the same positions."""
    return _merged(df, key, lo, hi, 1, {}).drop("island")


def covered(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, covered): number of positions under at least one interval."""
    return union(df, key, lo, hi).groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("covered"))


def cluster_ends(df: DataFrame, key: str, row: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Of each cluster of overlapping intervals its size, the row that begins first and the one that ends last."""
    parts = {"n": (F.count("*"), F.sum), "_first": (F.min(F.struct(F.col(lo).alias("at"), F.col(row).alias("row"))), F.min), "_last": (F.max(F.struct(F.col(hi).alias("at"), F.col(row).alias("row"))), F.max)}
    return _merged(df, key, lo, hi, 0, parts, df.count()).select(key, "island", "n", F.col("_first.row").alias("first_row"), F.col("_last.row").alias("last_row"), "lo", "hi")


def gaps(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, gap_lo, gap_hi): the holes between the intervals of a key."""
    order = W.partitionBy(key).orderBy("lo")
    return union(df, key, lo, hi).withColumn("next", F.lead("lo").over(order)).where("next is not null").select(key, (F.col("hi") + 1).alias("gap_lo"), (F.col("next") - 1).alias("gap_hi"))


def runs(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, lo, hi, n): maximal runs of consecutive integers among distinct positions."""
    distinct = df.select(key, pos).where(F.col(pos).isNotNull()).distinct()
    return _merged(distinct, key, pos, pos, 1, {"n": (F.count("*"), F.sum)}).drop("island")


def range_join(points: DataFrame, ranges: DataFrame, key: str, pos: str, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs with lo <= pos <= hi under one key, as an equi-join on bins of ``width`` and a residual test."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width).cast("long"))
    bins = F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))
    r = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(bins))
    return p.join(r, [key, "_bin"]).where(F.col(pos).between(F.col(lo), F.col(hi))).drop("_bin")


def tiles(df: DataFrame, lo: str, hi: str, size: int) -> DataFrame:
    """Cut [lo, hi] into n = (hi - lo) / size + 1 nearly equal tiles of nominal width (hi - lo + 1) / n + 1."""
    n = F.floor((F.col(hi) - F.col(lo)) / size) + 1
    cut = df.withColumn("_n", n).withColumn("width", (F.floor((F.col(hi) - F.col(lo) + 1) / F.col("_n")) + 1).cast("long"))
    cut = cut.withColumn("tile", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    start = F.col(lo) + F.col("tile") * F.col("width")
    out = cut.withColumns({"tile_lo": start.cast("long"), "tile_hi": F.least(start + F.col("width") - 1, F.col(hi)).cast("long")})
    return out.withColumn("tile_mid", F.floor((F.col("tile_lo") + F.col("tile_hi")) / 2).cast("long")).where("tile_lo <= tile_hi").drop("_n")


def sessions(df: DataFrame, key: str, at: str, row: str, gap: int) -> DataFrame:
    """``df`` with ``session``: a row joins its predecessor's if it follows within ``gap``."""
    carried = _carried(df.withColumn("_bin", F.floor(F.col(at) / (BIN * gap))), key, F.col(at), F.max)
    last = F.coalesce(F.lag(at).over(W.partitionBy(key, "_bin").orderBy(at, row)), F.col("_before"))
    marked = carried.withColumn("_new", F.when(F.col(at) - last <= gap, 0).otherwise(1)).drop("_before")
    return _numbered(marked, key, [at, row], "session")
