"""Writers of match files, metrics, results and corrected sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_kind(segments: DataFrame, kind: str, path: str) -> None:
    """Tab-separated files in one folder for each match kind."""
    segments.write.partitionBy(kind).csv(path, sep="\t", header=True)


def write_results(regions: DataFrame, path: str) -> DataFrame:
    """Regions in one folder for each result label; returns the counts of the labels."""
    out = regions.withColumn("subject", F.coalesce(F.col("subject").cast("string"), F.lit("-")))
    out.write.partitionBy("result").csv(path, sep="\t", header=True)
    return regions.groupBy("result").count()


def fasta_text(sequences: DataFrame, title: str, seq: str) -> DataFrame:
    """One string a record: header with the length, and the sequence on one line."""
    return sequences.select(F.concat(F.lit(">"), F.col(title), F.lit("\t"), F.length(seq).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(sequences: DataFrame, title: str, seq: str, path: str) -> None:
    fasta_text(sequences, title, seq).write.text(path)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """The catalog of a run as Parquet tables, which the next step reads."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_fasta_records(sequences: DataFrame, title: str, seq: str, path: str) -> None:
    """Sequences under their titles alone."""
    sequences.select(F.concat(F.lit(">"), F.col(title), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated rows under a header."""
    rows.write.csv(path, sep="\t", header=True)


def write_statistics(sizes: DataFrame, kinds: DataFrame, gc: DataFrame, covered: DataFrame, reference_len: int, path: str) -> None:
    """The report of lengths and kinds, in which a reader finds one line a number."""
    one = sizes.crossJoin(gc).crossJoin(covered)  # one row each
    share = F.try_divide("total", F.lit(float(reference_len)))
    percent = lambda x: F.concat(F.format_string("%.2f", 100 * F.coalesce(x, F.lit(0.0))), F.lit(" %"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").cast("string")
    said = [
        ("Queries number   ", number("cnt")), ("Total length     ", number("total")), ("Total ref. len   ", F.lit(str(reference_len))), ("Assem Len Ratio  ", percent(share)),
        ("Maximal length   ", number("longest")), ("N50 size         ", number("n50")), ("Mean size        ", F.format_string("%.2f", F.coalesce(F.col("mean"), F.lit(0.0)))), ("Median size      ", number("median")),
        ("Ref. cov ratio   ", percent(F.col("covered"))), ("Organism GC ratio", percent(F.col("gc"))),
    ]
    lines = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{name}: "), text).alias("value")) for i, (name, text) in enumerate(said)])).alias("x")).select("x.*")
    kind = F.concat(F.rpad(F.concat(F.initcap("name"), F.lit(" queries")), 17, " "), F.format_string(": lenRatio=%.2f %%, totalLen=%d, Num=%d, meanSize=%.2f", 100 * F.col("ratio"), F.col("bases"), F.col("n"), F.col("mean")))
    every = lines.unionByName(kinds.select((F.col("kind") + len(said)).alias("i"), kind.alias("value")))
    every.coalesce(1).sortWithinPartitions("i").select("value").write.text(path)  # a dozen lines
