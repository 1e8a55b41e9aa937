"""Sharding by jump consistent hashing: key and shard count decide, without a ring table.

A key jumps forward through shard numbers by a linear congruential generator until the next jump
would leave the range (Lamping and Veach, 2014). With one shard more, a key either stays or moves
to the new shard, in expectation 1/(n+1) of all keys.

Slots count the rows of a shard from 0 in key order. They come from counts of (shard, key range), so no
task ever holds a whole shard: rows are numbered inside their range and offset by the ranges
before. The ranges are cut at approximate quantiles of the key; a key that fills more than one is a range of its own, dealt
into parts.

Edge cases: a null key counts as key 0 for the shard and sorts first; repeated keys share a shard
and get slots of their own (rows alike in all columns are numbered in one task); an empty table gives an empty table; input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.llm.common import drop_clashes

#: Rows aimed at in one key range, and the most ranges that are cut.
RANGE_ROWS, MAX_RANGES = 5_000, 4_096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to shards - 1."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while open_.size:
        with np.errstate(over="ignore"):
            state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        unit = (state[open_] >> np.uint64(33)).astype(np.int64) + 1
        jump = ((shard[open_] + 1).astype(np.float64) * (float(1 << 31) / unit.astype(np.float64))).astype(np.int64)
        inside = jump < shards
        open_ = open_[inside]
        shard[open_] = jump[inside]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key as int."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def _range_of(key: Column, cuts: list[float]) -> Column:
    edges = np.array(cuts)

    @F.pandas_udf("int")
    def at(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(np.float64), "right").astype(np.int32))

    return F.when(key.isNull(), F.lit(-1)).otherwise(at(F.coalesce(key.cast("long"), F.lit(0))))


def _cuts(df: DataFrame, key: str) -> tuple[list[float], dict[int, int]]:
    """Where ranges of keys begin, and into how many parts the ranges are dealt that hold one frequent key (or null keys, range -1)."""
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    ranges = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    found = df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    often = {c: n for c, n in Counter(found).items() if n > 1}  # a key that is several cuts has about so many ranges' rows
    cuts = sorted({*found, *(c + 1 for c in often)})
    parts = {int(np.searchsorted(cuts, c, "right")): n + 1 for c, n in often.items()}
    if nulls > RANGE_ROWS:
        parts[-1] = min(MAX_RANGES, -(-nulls // RANGE_ROWS))
    return cuts, parts


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with shard int, slot long (gapless from 0 in each shard, by key, then ``order``) and
    grown_shard int, the shard if there were one more.

    Rows of a key that fills more than a range, and null keys, are dealt by a hash of their columns and numbered part by part, so ``order`` holds within a part only. Shuffles
    the columns of ``df`` once, by (shard, key range, part); select narrow columns before.
    """
    df = drop_clashes(df, "shard", "slot", "grown_shard", "_range", "_part")
    cuts, parts = _cuts(df, key)
    placed = df.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1), "_range": _range_of(F.col(key), cuts)})
    part = F.lit(0).cast("long")
    if parts:
        told = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
        part = F.pmod(hashed, F.coalesce(told[F.col("_range")], F.lit(1)))
    placed = placed.withColumn("_part", part)
    group = ["shard", "_range", "_part"]
    sizes = placed.groupBy(*group).count()
    before = W.partitionBy("shard").orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group).orderBy(key, *order)
    numbered = placed.withColumn("slot", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(offsets), group)  # at most shards x 4 MAX_RANGES rows
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("slot") + F.col("_offset")).alias("slot"), "grown_shard")
