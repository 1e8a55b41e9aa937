"""The training-data pipeline over documents: toxicity, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage
judges what its predecessor kept. Rows with a null doc_id can't be told apart by key: they pass the
second and third stage. Rows that repeat a doc_id stay or go together. Null and empty texts, which are neither toxic nor alike nor leaked, pass with
no tokens; texts are whole however long; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontig.llm import byte_bpe, decontaminate, ngram_join, toxicity
from kontig.llm.common import Scratch, small, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, score_col="_toxic").where("_toxic < 0.5").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle Jaccard of 0.75 or more, the one with the smallest doc_id."""
    linked = ngram_join.link_documents(docs)
    others = written(linked.where("doc_id != component_id").select("doc_id").distinct(), "others")
    return docs.join(small(others, others.count(), 1_000_000), "doc_id", "left_anti").select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; ``whole`` says whether they decode to the text's bytes."""
    rank_file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    sized = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    decoded = byte_bpe.round_trip(sized, rank_file, pattern)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("whole"))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", remove_leaks),
    ("byte_bpe", encode),
]

#: Rows of an Arrow batch: each holds a whole text, in an executor's JVM and in its Python worker at once.
BATCH_ROWS = 1_000

#: The first and last stage are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"  # stays set: the last stage runs when the caller reads it
    spark.conf.set(at_once, min(BATCH_ROWS, int(spark.conf.get(at_once))) if int(spark.conf.get(at_once)) > 0 else BATCH_ROWS)
    docs, before, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)  # the stage before is read no more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
