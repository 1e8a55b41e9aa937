"""Coverage by position, bins and regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.operators.intervals import dealt
from kontig.params import COVERAGE_BIN, DISAGREE_RATIO

ALLELES = ("a", "c", "g", "t", "n")


#: Positions of a bin; the steps of a key are summed up bin by bin.
STEP_BIN = 4096


def _step_bin() -> Column:
    return F.floor(F.col("pos") / STEP_BIN)


def _running(steps: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, pos, next, *values): running sums of the steps of each key, and the position of the next step.

    A bin's sums go to the bins behind it, so that a window holds one bin of a key, not the key.
    """
    binned = steps if "_bin" in steps.columns else steps.withColumn("_bin", _step_bin())
    order = W.partitionBy(key).orderBy("_bin")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = binned.groupBy(key, "_bin").agg(*[F.sum(v).alias(f"_{v}") for v in values], F.min("pos").alias("_first"))
    carried = whole.select(key, "_bin", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values], F.lead("_first").over(order).alias("_after"))
    within = W.partitionBy(key, "_bin").orderBy("pos")
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    return binned.join(carried, [key, "_bin"]).select(key, "pos", F.coalesce(F.lead("pos").over(within), "_after").alias("next"), *[(F.sum(v).over(upto) + F.col(f"_{v}")).alias(v) for v in values])


def depth(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, pos, total) at every position where the depth changes."""
    return depth_stretches(intervals, key, lo, hi).drop("next")


def depth_stretches(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, pos, next, total): the depth from where it changes to where it changes ``next`` (null behind the last interval): difference array and running sum."""
    up = intervals.select(key, F.col(lo).alias("pos"), F.lit(1).alias("total"))
    down = intervals.select(key, (F.col(hi) + 1).alias("pos"), F.lit(-1).alias("total"))
    binned = dealt(up.union(down).withColumn("_bin", _step_bin()), 2 * intervals.count(), key, "_bin")
    steps = binned.groupBy(key, "_bin", "pos").agg(F.sum("total").alias("total")).where("total != 0")
    return _running(steps, key, ["total"])


def span_coverage(spans: DataFrame, key: str, lo: str, hi: str, base: str) -> DataFrame:
    """(key, pos, a, c, g, t, n, total) of the positions under spans that place one base each, one row each, made after the sums of ``span_steps``."""
    return stepped(span_steps(spans, key, lo, hi, base), key)


def stepped(steps: DataFrame, key: str) -> DataFrame:
    """A row (key, pos, *alleles, total) for each position of the stretches of ``span_steps``."""
    return steps.select(key, F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), *ALLELES, "total")


def span_steps(spans: DataFrame, key: str, lo: str, hi: str, base: str, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, pos, next, a, c, g, t, n, total): stretches [pos, next) of equal coverage under spans that place one base each, by a difference array for each
    allele. Null bases count in the total alone. The differences are read twice, once if ``write`` writes them and reads them back."""
    kind = F.when(F.upper(base).isin("A", "C", "G", "T"), F.lower(base)).when(F.col(base).isNotNull(), "n")
    named = spans.where(F.col(lo) <= F.col(hi)).select(key, lo, hi, *[F.when(kind == x, 1).otherwise(0).alias(x) for x in ALLELES], F.lit(1).alias("total"))
    values = [*ALLELES, "total"]
    up = named.select(key, F.col(lo).cast("long").alias("pos"), *values)
    down = named.select(key, (F.col(hi) + 1).cast("long").alias("pos"), *[(-F.col(v)).alias(v) for v in values])
    steps = write(up.union(down).groupBy(key, "pos").agg(*[F.sum(v).alias(v) for v in values]))
    return _running(steps, key, values).where("total > 0")


def allele_coverage(bases: DataFrame, key: str, pos: str, base: str) -> DataFrame:
    """(key, pos, a, c, g, t, n, total) from one row for each placed base."""
    parts = [F.count_if(F.upper(base) == x.upper()).alias(x) for x in ALLELES[:4]]
    other = F.count_if(~F.upper(base).isin("A", "C", "G", "T")).alias("n")
    return bases.groupBy(key, pos).agg(*parts, other, F.count("*").alias("total"))


def disagreement(coverage: DataFrame) -> DataFrame:
    """Flags disagree and zero: no coverage, or a largest share under 0.9 unless the runner-up is 1 and the largest 4."""
    ranked = F.sort_array(F.array(*[F.col(x).cast("long") for x in ALLELES]), asc=False)
    most, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    low = (10 * most < int(DISAGREE_RATIO * 10) * F.col("total")) & ~((second == 1) & (most >= 4))
    return coverage.withColumns({"zero": (F.col("total") == 0), "disagree": (F.col("total") == 0) | low})


def bin_means(coverage: DataFrame, key: str, pos: str, total: str, width: int = COVERAGE_BIN) -> DataFrame:
    return coverage.groupBy(key, F.floor((F.col(pos) - 1) / width).cast("long").alias("bin")).agg(F.avg(total).alias("mean"))


def bin_statistics(bins: DataFrame, key: str) -> DataFrame:
    """Unweighted mean and population deviation of the bins' means."""
    return bins.groupBy(key).agg(F.count("*").alias("bins"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"))


def abnormal_bins(bins: DataFrame, key: str) -> DataFrame:
    """Bins over 1.5 times and under half of the key's mean."""
    stats = bin_statistics(bins, key).select(key, F.col("mean").alias("m"))
    return bins.join(stats, key).groupBy(key).agg(F.count_if(F.col("mean") > 1.5 * F.col("m")).alias("high"), F.count_if(F.col("mean") < 0.5 * F.col("m")).alias("low"))


def roll_up(bins: DataFrame, key: str, order: str, skip_head: int, skip_tail: int, sums: list[str]) -> DataFrame:
    """Sums over the bins of a key without its first and last few."""
    w = W.partitionBy(key)
    numbered = bins.withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    kept = numbered.where((F.col("_i") > skip_head) & (F.col("_i") <= F.col("_n") - skip_tail))
    return kept.groupBy(key).agg(F.count("*").alias("bins"), *[F.sum(s).alias(s) for s in sums])
