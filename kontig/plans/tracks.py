"""Tracks for drawing queries: coverage, uncovered and disagreeing positions, mate ratios, unknown bases and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.operators import evidence, intervals, pileup
from kontig.params import COVERAGE_BIN

#: Coverage above this is drawn as this.
HIGHEST = 200


def _track(df: DataFrame, name: str, lo: Column, hi: Column, value: Column) -> DataFrame:
    return df.select("key", F.lit(name).alias("track"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), value.cast("double").alias("value"))


def coverage_track(coverage: DataFrame, lengths: DataFrame) -> DataFrame:
    """Mean coverage of every COVERAGE_BIN of each query (key, len), HIGHEST at most."""
    sums = coverage.groupBy("key", F.floor((F.col("pos") - 1) / COVERAGE_BIN).cast("long").alias("bin")).agg(F.sum("total").alias("total"))
    every = lengths.where("len > 0").select("key", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / COVERAGE_BIN).cast("long"))).alias("bin"))
    lo, hi = F.col("bin") * COVERAGE_BIN + 1, F.least((F.col("bin") + 1) * COVERAGE_BIN, F.col("len"))
    return _track(every.join(sums, ["key", "bin"], "left"), "coverage", lo, hi, F.least(F.coalesce("total", F.lit(0)) / (hi - lo + 1), F.lit(float(HIGHEST))))


def uncovered_track(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """The stretches of each query under no span (key, lo, hi), also before the first and behind the last one."""
    ends = lengths.where("len > 0").select("key", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")), F.struct((F.col("len") + 1).cast("long").alias("lo"), (F.col("len") + 1).cast("long").alias("hi")))).alias("e")).select("key", "e.*")
    inside = spans.join(lengths.select("key", "len"), "key").where("lo <= len and hi >= 1").select("key", F.greatest("lo", F.lit(1)).cast("long").alias("lo"), F.least("hi", "len").cast("long").alias("hi"))
    holes = intervals.gaps(inside.unionByName(ends), "key")
    return _track(holes, "uncovered", F.col("gap_lo"), F.col("gap_hi"), F.lit(0))


def disagreement_track(coverage: DataFrame) -> DataFrame:
    """Covered positions whose reads disagree, with their coverage."""
    return _track(pileup.disagreement(coverage).where("disagree and total > 0"), "disagreement", F.col("pos"), F.col("pos"), F.col("total"))


def ratio_tracks(mates: DataFrame, lengths: DataFrame) -> DataFrame:
    """The shares of discordant and of ambiguous reads in each tile of a query, by the reads' middles."""
    whole = lengths.where("len > 0").select(F.col("key").alias("rid"), "key", F.col("len").cast("long").alias("len"), F.lit(1).cast("long").alias("lo"), F.col("len").cast("long").alias("hi"))
    tiles = evidence.tiles_of(whole).select("rid", "key", "n", "lo", "hi")
    counts = evidence.mate_counts(evidence.in_windows(mates, tiles), ["key", "n", "lo", "hi"])
    drawn = [_track(tiles.drop("rid").join(counts.select("key", "n", c), ["key", "n"], "left"), name, F.col("lo"), F.col("hi"), F.coalesce(c, F.lit(0.0))) for name, c in (("discordant", "discor_ratio"), ("ambiguous", "multi_ratio"))]
    return drawn[0].unionByName(drawn[1])


def unknown_track(queries: DataFrame) -> DataFrame:
    """Runs of unknown bases in queries (key, seq)."""
    cut = queries.select("key", F.posexplode(F.regexp_extract_all("seq", F.lit("[Nn.]+|[^Nn.]+"), F.lit(0))).alias("i", "run"))
    placed = cut.withColumn("size", F.length("run")).withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return _track(placed.where(F.col("run").rlike("^[Nn.]")), "unknown", F.col("before") + 1, F.col("before") + F.col("size"), F.col("size"))


#: What a result is drawn as.
COLOURS = {"errors": 1, "sv": 2, "gap": 3, "warning": 4}


def result_track(results: DataFrame) -> DataFrame:
    """Result rows as stretches of their query, with a number for their colour."""
    colour = F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), F.col("result"))
    return _track(results, "result", F.col("q_start"), F.col("q_end"), colour)
