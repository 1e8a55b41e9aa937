"""Length and accuracy metrics. Orderings over a whole table go through counts by length, so that no
task sorts all rows: only the table of distinct lengths meets in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.params import MATCH_KINDS, MIN_QUERY_LEN


def _by_length(df: DataFrame, length: str) -> DataFrame:
    """(len, n, rows before, bases up to and with this length), longest first."""
    sizes = df.groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("n"))
    order = W.orderBy(F.desc("len"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return sizes.withColumns({"bases": F.sum(F.col("len") * F.col("n")).over(upto), "before": F.sum("n").over(upto) - F.col("n")})


def length_metrics(df: DataFrame, length: str, min_len: int = MIN_QUERY_LEN) -> DataFrame:
    """One row: count, sum, max, mean, N50 and the lower median of lengths of at least ``min_len``."""
    sizes = _by_length(df.where(F.col(length) >= min_len), length)
    total = sizes.agg(F.sum("n").alias("cnt"), F.sum(F.col("len") * F.col("n")).alias("total"), F.max("len").alias("longest"))
    middle = F.floor(F.col("cnt") / 2)
    return (
        sizes.crossJoin(F.broadcast(total))  # one row
        .groupBy("cnt", "total", "longest")
        .agg(
            F.max(F.when(2 * F.col("bases") >= F.col("total"), F.col("len"))).alias("n50"),
            F.max(F.when((F.col("before") <= middle) & (middle < F.col("before") + F.col("n")), F.col("len"))).alias("median"),
        )
        .select("cnt", "total", "longest", F.round(F.col("total") / F.col("cnt"), 6).alias("mean"), "n50", "median")
    )


def ranked_by_length(df: DataFrame, key: str, length: str) -> DataFrame:
    """(rank, key, length), longest first, ties by key."""
    sizes = _by_length(df, length).select(F.col("len").alias(length), "before")
    inside = F.row_number().over(W.partitionBy(length).orderBy(key))
    rows = df.select(key, F.col(length).cast("long").alias(length)).join(sizes, length)
    return rows.select((F.col("before") + inside).cast("long").alias("rank"), key, length)


def accuracy_by_kind(df: DataFrame, kind: str, length: str, reference_len: float) -> DataFrame:
    """Count, sum and mean length and share of the reference for each of the four kinds, zeros included."""
    spark = df.sparkSession
    kinds = spark.createDataFrame(list(enumerate(MATCH_KINDS)), "kind int, name string")
    sums = df.groupBy(F.col(kind).cast("int").alias("kind")).agg(F.count("*").alias("n"), F.sum(length).alias("bases"))
    joined = kinds.join(sums, "kind", "left").na.fill(0, ["n", "bases"])
    mean = F.coalesce(F.round(F.try_divide(F.col("bases"), F.col("n")), 6), F.lit(0.0))
    return joined.select("kind", "name", "n", F.col("bases").cast("long").alias("bases"), mean.alias("mean"), F.round(F.col("bases") / F.lit(float(reference_len)), 6).alias("ratio"))


def ratio_by_group(df: DataFrame, group: str, part: Column, whole: Column) -> DataFrame:
    """sum(part) / sum(whole) for each group and, with a null group, in all."""
    return df.select(group, part.alias("p"), whole.alias("w")).rollup(group).agg(F.sum("p").cast("long").alias("part"), F.sum("w").cast("long").alias("whole")).withColumn("ratio", F.round(F.try_divide(F.col("part"), F.col("whole")), 6))
