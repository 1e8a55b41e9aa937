"""What of the reference an assembly covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontig.operators import intervals

BASES = "ACGTN"


def base_flags(aligned: DataFrame, subject: str, start: str, query_row: str, subject_row: str) -> DataFrame:
    """(subject, pos, flag) of every aligned reference base: 1 where some alignment matches, else the least substitution.

    A substitution of reference base i by query base j has the flag 2 + 5 i + j, in the order ACGTN, and a base missing from the
    query (``-``) 27 + i; inserted query bases (``-`` in the reference row) have no position.
    """
    pairs = F.arrays_zip(F.split(F.upper(query_row), "").alias("q"), F.split(F.upper(subject_row), "").alias("s"))
    # the position of a column is the start and the number of reference bases before it
    base = aligned.select(subject, F.col(start).alias("_start"), F.posexplode(F.filter(pairs, lambda p: p["s"] != "-")).alias("_i", "_p"))
    i, j = F.instr(F.lit(BASES), F.col("_p.s")) - 1, F.instr(F.lit(BASES), F.col("_p.q")) - 1
    flag = F.when(F.col("_p.q") == F.col("_p.s"), 1).when(F.col("_p.q") == "-", 27 + i).otherwise(2 + 5 * i + j)
    return base.groupBy(subject, (F.col("_start") + F.col("_i")).cast("long").alias("pos")).agg(F.min(flag).cast("int").alias("flag"))


def covered_ratio(segments: DataFrame, subjects: DataFrame, subject: str, length: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(subject, covered, length, ratio) and a row with a null subject for all of them; by the union of segments, not by bases."""
    each = subjects.select(subject, F.col(length).cast("long").alias("length")).join(intervals.covered(segments, subject, lo, hi), subject, "left")
    each = each.select(subject, F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), "length")
    total = each.rollup(subject).agg(F.sum("covered").alias("covered"), F.sum("length").alias("length"))
    return total.withColumn("ratio", F.try_divide("covered", "length"))
