"""The program's verbs as plans over files: merge, metrics, misass, and all of them in turn."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontig.functions.sequences import count_of
from kontig.operators import alignment, lengths, reference
from kontig.params import INDEL_SIZE, MATCH_KINDS, MIN_QUERY_LEN
from kontig.plans import assembly
from kontig.plans.stages import Stages
from kontig.sources import catalog, sinks, text_formats
from kontig.sources.text_formats import Config


@dataclass(frozen=True)
class Options:
    """Where results go and the thresholds that a user may set."""

    out: str
    report: str | None = None
    min_len: int = MIN_QUERY_LEN
    indel: int = INDEL_SIZE
    single_cell: bool = False
    insert: float | None = None
    sd: float | None = None


def merge(spark: SparkSession, config: Config, options: Options) -> None:
    """The reference files as one, and the queries with their titles cut, as FASTA."""
    sinks.write_fasta_records(text_formats.merge_references(spark, config.references), "title", "seq", f"{options.out}/reference")
    sinks.write_fasta_records(text_formats.read_fasta(spark, config.queries), "title", "seq", f"{options.out}/queries")


def _catalog(spark: SparkSession, config: Config, options: Options) -> catalog.Catalog:
    if options.report is None:
        raise ValueError("the report of aligned queries is missing")
    return catalog.build(text_formats.read_fasta(spark, config.queries), text_formats.merge_references(spark, config.references), text_formats.read_report(spark, options.report))


def metrics(spark: SparkSession, config: Config, options: Options) -> None:
    """Kinds, lengths and coverage of the queries: ``queryStatistics``, ``sortedQueries``, a folder of segments for each kind, and the catalog."""
    catalog.save(_catalog(spark, config, options), f"{options.out}/catalog")
    known, stages = catalog.load(spark, f"{options.out}/catalog"), Stages(spark)
    found = assembly.align_queries(known.queries, known.items, stages, options.min_len)
    kinds = stages.write(found.kinds, "kinds")
    sinks.write_snapshot({"kinds": kinds, "segments": found.segments}, f"{options.out}/catalog")
    total = known.subjects.agg(F.sum("len")).first()[0] or 0  # one number
    sizes = lengths.length_metrics(known.queries, "len", options.min_len)
    by_kind = lengths.accuracy_by_kind(kinds, "kind", "len", max(total, 1))
    gc = known.subjects.agg(F.try_divide(F.sum(count_of(F.col("seq"), "GCgc")), F.sum(count_of(F.col("seq"), "ACGTacgt"))).alias("gc"))
    spans = found.segments.select("subject_id", F.least("s_start", "s_end").alias("lo"), F.greatest("s_start", "s_end").alias("hi"))
    covered = reference.covered_ratio(spans, known.subjects, "subject_id", "len").where("subject_id is null").select(F.coalesce("ratio", F.lit(0.0)).alias("covered"))
    sinks.write_statistics(sizes, by_kind, gc, covered, total, f"{options.out}/queryStatistics")
    titles = known.queries.select("query_id", "title")
    ranked = lengths.ranked_by_length(known.queries.select("title", "len"), "title", "len")
    sinks.write_table(ranked.select(F.col("rank").alias("Rank"), F.col("title").alias("Query"), F.col("len").alias("Length")), f"{options.out}/sortedQueries")
    named = titles.join(kinds.select("query_id", "kind"), "query_id").join(found.segments.drop("query_len"), "query_id", "left").join(known.subjects.select("subject_id", F.col("title").alias("subject"), F.col("len").alias("s_len")), "subject_id", "left")
    name = F.element_at(F.array(*[F.lit(k) for k in MATCH_KINDS]), F.col("kind") + 1)
    rows = named.select("title", "ord", "s_start", "s_end", "q_start", "q_end", "strand", "match_len", "total_len", "gap_num", F.round(F.try_divide("match_len", "total_len"), 4).alias("identity"), "subject", F.col("s_len").alias("subject_len"), name.alias("match_kind"))
    sinks.write_by_kind(rows, "match_kind", f"{options.out}/queryMatchInfo")
    stages.drop()


def misass(spark: SparkSession, config: Config, options: Options) -> None:
    """Errors, variations and warnings of the queries by their reads, and the corrected assembly; reads what ``metrics`` saved."""
    known, stages = catalog.load(spark, f"{options.out}/catalog"), Stages(spark)
    segments, kinds = spark.read.parquet(f"{options.out}/catalog/segments"), spark.read.parquet(f"{options.out}/catalog/kinds")
    keyed = lambda df: df.withColumnRenamed("query_id", "key").withColumnRenamed("subject_id", "subject")
    queries, subjects = keyed(known.queries), keyed(known.subjects)
    suspects = stages.write(assembly.candidates(kinds).select(F.col("query_id").alias("key"), "rank"), "candidates")
    asked = queries.join(suspects.select("key"), "key", "left_semi")
    parts = keyed(segments).join(suspects.select("key"), "key", "left_semi")
    placed = assembly.place_reads(text_formats.read_library(spark, config.reads), queries, stages, options.insert, options.sd)
    inner = alignment.inner_indels(parts, asked, subjects)
    found = assembly.validate(asked, parts, placed.coverage, placed.placements, placed.insert, placed.sd, stages, inner, subjects, options.single_cell, options.indel)
    titles = queries.select("key", F.col("title").alias("query"))
    named = found.results.withColumnRenamed("subject", "subject_id").join(titles, "key").join(known.subjects.select("subject_id", F.col("title").alias("subject")), "subject_id", "left")
    columns = ("query", "mis_kind", "q_start", "q_end", "s_start", "s_end", "subject", "result")
    sinks.write_results(named.select(*columns), f"{options.out}/results")
    whole = known.queries.join(suspects.select(F.col("key").alias("query_id")), "query_id", "left_anti").select("query_id", F.lit(0).alias("piece"), "title", "seq")
    sinks.write_fasta(found.corrected.unionByName(whole), "title", "seq", f"{options.out}/query_cor")
    sinks.write_snapshot({"verdicts": found.queries, "regions": found.regions}, f"{options.out}/catalog")
    sinks.write_table(sizes(spark, {"before": config.queries, "after": [f"{options.out}/query_cor"]}, options.min_len), f"{options.out}/sizes")
    stages.drop()


def sizes(spark: SparkSession, files: dict[str, list[str]], min_len: int = MIN_QUERY_LEN) -> DataFrame:
    """Length metrics of FASTA files, one row under each name, such as an assembly before and after its correction."""
    rows = [lengths.length_metrics(text_formats.read_fasta(spark, paths), "len", min_len).withColumn("name", F.lit(name)) for name, paths in files.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def everything(spark: SparkSession, config: Config, options: Options) -> None:
    for verb in (merge, metrics, misass):
        verb(spark, config, options)


VERBS: dict[str, Callable[[SparkSession, Config, Options], None]] = {"all": everything, "merge": merge, "metrics": metrics, "misass": misass}


def results(spark: SparkSession, out: str) -> DataFrame:
    """The result rows that ``misass`` wrote, with the file they are in as ``result``."""
    return spark.read.csv(f"{out}/results", sep="\t", header=True, inferSchema=True)
