"""FASTA, FASTQ, pairwise alignment reports and library configuration as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.functions.sequences import clean


def read_fasta(spark: SparkSession, paths: str | list[str], cut: str = "\t") -> DataFrame:
    """(title, seq, len): one row a record; sequence lines joined, titles cut at ``cut``.

    Records are the reader's lines, split at a line feed and ``>``, so a file is read in splits.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("v")).where(F.length(F.trim("v")) > 0)
    title = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    for c in cut:
        title = F.substring_index(title, c, 1)
    body = F.when(F.instr("v", "\n") > 0, F.substr("v", F.instr("v", "\n") + 1)).otherwise(F.lit(""))
    seq = clean(F.translate(body, "\r\n", ""))
    return raw.select(title.alias("title"), seq.alias("seq")).withColumn("len", F.length("seq"))


def merge_references(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All reference files as one relation; trailing characters that are no bases are cut."""
    return read_fasta(spark, paths, cut=" \t").withColumn("seq", F.regexp_replace("seq", "[^ACGTNacgtn.]+$", "")).withColumn("len", F.length("seq"))


def _ordinals(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.text(path), "line")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """(name, value) in file order, numbered from 0 over all splits of one file: a count for each split, then its own numbers."""
    lines = rows.select("value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each split
    placed = lines.join(F.broadcast(splits.select("_b", "_first", before.alias("_before"))), "_b")
    return placed.select((F.col("_m") - F.col("_first") + F.col("_before")).alias(name), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, seq): four lines a record; a truncated record raises when it is read."""
    lines = _ordinals(spark, path)
    at = F.pmod("line", F.lit(4))
    record = lines.groupBy(F.floor(F.col("line") / 4).cast("long").alias("record")).agg(
        F.max(F.when(at == 0, F.substr("value", F.lit(2)))).alias("name"), F.max(F.when(at == 1, F.col("value"))).alias("seq"), F.count("*").alias("_n")
    )
    whole = F.when(F.col("_n") == 4, F.col("seq")).otherwise(F.raise_error(F.lit("truncated record")).cast("string"))
    return record.select("record", "name", whole.alias("seq"))


def read_fasta_reads(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, seq) of one file of reads, numbered from 0 in file order."""
    raw = _numbered(spark.read.option("lineSep", "\n>").text(path), "record").where(F.length(F.trim("value")) > 0)
    v = F.regexp_replace("value", "^>", "")
    return raw.select("record", F.regexp_replace(F.substring_index(v, "\n", 1), "\r$", "").alias("name"), F.translate(F.regexp_replace(v, "^[^\n]*\n?", ""), "\r\n", "").alias("seq"))


def read_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(read_id, pair_id, mate, seq) of two mate files; read_id is odd for the first mate. A mate that is missing in one file raises when it is read."""
    both = first.select("record", F.struct("seq").alias("one")).join(second.select("record", F.struct("seq").alias("two")), "record", "full")
    seq = F.when(F.col("one").isNull() | F.col("two").isNull(), F.raise_error(F.lit("the mate files differ in length")).cast("string"))
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.coalesce(seq, F.col(f"{name}.seq")).alias("seq")) for m, name in ((1, "one"), (2, "two"))])
    each = both.select((F.col("record") + 1).alias("pair_id"), F.explode(mates).alias("m")).select("pair_id", "m.*")
    return each.select((2 * (F.col("pair_id") - 1) + F.col("mate")).alias("read_id"), "pair_id", "mate", "seq")


def interleaved_pairs(reads: DataFrame) -> DataFrame:
    """The same from one file in which mates alternate."""
    return reads.select((F.col("record") + 1).alias("read_id"), (F.floor(F.col("record") / 2) + 1).cast("long").alias("pair_id"), (F.pmod("record", F.lit(2)) + 1).cast("int").alias("mate"), "seq")


def read_format(spark: SparkSession, path: str) -> str:
    """fasta or fastq, by the first character."""
    first = spark.read.text(path).first()
    kind = {">": "fasta", "@": "fastq"}.get((first[0] if first else "")[:1])
    if kind is None:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    return kind


def read_library(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(read_id, pair_id, mate, seq) of a library: two mate files, or one in which mates alternate. All files have one format."""
    kinds = {read_format(spark, p) for p in paths}
    if len(kinds) != 1 or len(paths) > 2:
        raise ValueError(f"one or two read files of one format: {', '.join(paths)}")
    read = read_fasta_reads if kinds == {"fasta"} else read_fastq
    reads = [read(spark, p) for p in paths]
    return read_pairs(*reads) if len(reads) == 2 else interleaved_pairs(reads[0])


def read_hit_table(spark: SparkSession, path: str) -> DataFrame:
    """Segments from a tab-separated hit table with the twelve standard columns."""
    names = "query string, subject string, identity double, total_len long, mismatches long, gap_opens long, q_start long, q_end long, s_start long, s_end long, evalue double, score double"
    rows = spark.read.schema(names).csv(path, sep="\t", comment="#")
    strand = F.when(F.col("s_start") <= F.col("s_end"), 0).otherwise(1)
    hsp = F.row_number().over(W.partitionBy("query", "subject").orderBy(F.desc("score"), "q_start", "s_start"))
    return rows.select("*", strand.alias("strand"), F.round(F.col("identity") * F.col("total_len") / 100).cast("long").alias("match_len"), hsp.alias("hsp"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("long"))


def _title(section: Column) -> Column:
    """The title before ``Length=``, its lines joined by single blanks."""
    return F.trim(F.regexp_replace(F.regexp_extract(section, r"(?s)^(.*?)(?:\r?\n\s*Length=|$)", 1), r"\s*\r?\n\s*", " "))


def read_report(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segments from a pairwise text report: one row for each, and one of nulls for a query and subject without any.

    (query, query_len, subject, subject_len, hsp, q_start, q_end, s_start, s_end, strand, match_len, total_len, gaps, identity,
    q_row, s_row). The strand is 0 if the subject's is exactly ``Plus``; else s_start is the larger end. Records are the
    reader's, cut where a line begins with ``Query=``, so files are read in splits; one row holds the report of one query.
    """
    # a file that begins with a query keeps the mark; text before the first query has no length
    queries = spark.read.option("lineSep", "\nQuery=").text(paths).select(F.regexp_replace("value", "^Query=", "").alias("v")).where(F.col("v").rlike(r"\n\s*Length="))
    subjects = queries.select(_title(F.col("v")).alias("query"), _number(F.col("v"), r"\n\s*Length=\s*(\d+)").alias("query_len"), F.explode(F.slice(F.split("v", r"\n(?:Subject=|>)"), 2, 2**31 - 1)).alias("s"))
    named = subjects.select("query", "query_len", _title(F.col("s")).alias("subject"), _number(F.col("s"), r"\n\s*Length=\s*(\d+)").alias("subject_len"), F.split("s", r"\n Score =").alias("p"))
    rows = named.select("query", "query_len", "subject", "subject_len", F.posexplode_outer(F.slice("p", 2, 2**31 - 1)).alias("_at", "h"))
    h = F.col("h")
    lines = lambda side, group: F.regexp_extract_all(h, F.lit(rf"(?m)^{side}\s+(\d+)\s+([A-Za-z*.-]+)\s+(\d+)"), F.lit(group))
    ends = {x: c for side, a in (("Query", "q"), ("Sbjct", "s")) for x, c in ((f"{a}_start", F.get(lines(side, 1), F.lit(0)).cast("long")), (f"{a}_end", F.try_element_at(lines(side, 3), F.lit(-1)).cast("long")), (f"{a}_row", F.array_join(lines(side, 2), "")))}
    match, total = _number(h, r"Identities\s*=\s*(\d+)/(\d+)"), _number(h, r"Identities\s*=\s*(\d+)/(\d+)", 2)
    strand = F.when(h.isNotNull(), F.when(F.regexp_extract(h, r"Strand\s*=\s*\w+\s*/\s*(\w+)", 1) == "Plus", 0).otherwise(1))
    found = rows.select(
        "query", "query_len", "subject", "subject_len", (F.col("_at") + 1).cast("long").alias("hsp"), *[ends[x].alias(x) for x in ("q_start", "q_end", "s_start", "s_end")], strand.alias("strand"),
        match.alias("match_len"), total.alias("total_len"), _number(h, r"Gaps\s*=\s*(\d+)/").alias("gaps"), F.round(F.try_divide(match, total), 4).alias("identity"), ends["q_row"].alias("q_row"), ends["s_row"].alias("s_row"),
    )
    return found


@dataclass
class Config:
    queries: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    library: str | None = None
    reads: list[str] = field(default_factory=list)


#: The kinds of read libraries.
LIBRARIES = ("PE", "MP", "PE_IN", "LONG_PE", "LONG_SE")


def parse_config(lines: list[str]) -> Config:
    """Sections QUERY, REF and READS, each closed by END; ``#`` begins a comment; one library."""
    config, section = Config(), None
    for line in (x.split("#", 1)[0].strip() for x in lines):
        if not line:
            continue
        if section is None:
            if line not in ("QUERY", "REF", "READS"):
                raise ValueError(f"no section: {line}")
            section = line
        elif line == "END":
            section = None
        elif section == "READS":
            kind, _, files = line.partition("=")
            if kind not in LIBRARIES or config.library:
                raise ValueError(f"one library of {', '.join(LIBRARIES)}: {line}")
            config.library, config.reads = kind, files.split()
        else:
            (config.queries if section == "QUERY" else config.references).append(line)
    if section:
        raise ValueError(f"{section} is not closed")
    return config
