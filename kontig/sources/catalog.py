"""The catalog of a run: queries, subjects and aligned items under dense ids, saved as Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Catalog:
    """queries (query_id, title, seq, len), subjects (subject_id, title, seq, len) and items with both ids."""

    queries: DataFrame
    subjects: DataFrame
    items: DataFrame


def numbered(sequences: DataFrame, name: str) -> DataFrame:
    """Sequences under ids from 1, the longest first, then by title; a repeated title is an error when it is read.

    The ids follow from counts by length, so that no task sorts all rows.
    """
    sized = sequences.groupBy("len").count()
    before = F.coalesce(F.sum("count").over(W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a length
    inside = F.row_number().over(W.partitionBy("len").orderBy("title"))
    ranked = sequences.join(sized.select("len", before.alias("_before")), "len").withColumn("_id", F.col("_before") + inside)
    twice = F.count("*").over(W.partitionBy("title")) > 1
    title = F.when(twice, F.raise_error(F.concat(F.lit("a title stands twice: "), F.col("title"))).cast("string")).otherwise(F.col("title"))
    return ranked.select(F.col("_id").cast("long").alias(name), title.alias("title"), "seq", F.col("len").cast("long").alias("len"))


def build(queries: DataFrame, subjects: DataFrame, report: DataFrame, circular: bool = True) -> Catalog:
    """Sequences (title, seq, len) and a report's segments (query, subject, hsp and coordinates) under ids. A report's query titles end at a tab, its
    subject titles at a blank, as those of the sequences do.

    Sequences are found by their titles, never by their place; an item whose title is unknown is dropped, as are pairs without items. Subjects count as circular
    unless told otherwise: items carry subject_len then.
    """
    q, s = numbered(queries, "query_id"), numbered(subjects, "subject_id")
    first = lambda c, *cuts: F.substring_index(F.substring_index(c, cuts[0], 1), cuts[-1], 1)
    report = report.withColumns({"query": first(F.col("query"), "\t"), "subject": first(F.col("subject"), "\t", " ")})
    named = report.where("hsp is not null").drop("query_len", "subject_len").join(q.select("query_id", F.col("title").alias("query"), F.col("len").alias("query_len")), "query")
    named = named.join(s.select("subject_id", F.col("title").alias("subject"), F.col("len").alias("subject_len")), "subject")
    gaps = F.coalesce("gaps", F.lit(0)).alias("gap_num")
    items = named.select("query_id", "subject_id", "query_len", *([F.col("subject_len")] if circular else []), "hsp", "q_start", "q_end", "s_start", "s_end", "strand", "match_len", "total_len", gaps)
    return Catalog(q, s, items)


def save(catalog: Catalog, path: str) -> None:
    for name, df in vars(catalog).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Catalog:
    """The catalog that ``save`` wrote."""
    return Catalog(*[spark.read.parquet(f"{path}/{name}") for name in ("queries", "subjects", "items")])
