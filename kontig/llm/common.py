"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset a fresh local folder does for a local master, whose executors
    share the driver's disk; any other master is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="kontig-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder: ``write`` cuts the lineage, ``drop`` frees what is read no more.

    Parquet in the shared folder outlives any executor, and later reads prune its columns. Shuffle files go when
    the table that they were made for is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/kontig-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    return Scratch(df.sparkSession).write(df, name)


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint for ``df`` of ``rows`` counted rows, only below ``limit``; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def give_back() -> None:
    """Memory that a Python worker needs no more goes back to the system: workers live on, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and ``give_back`` behind the last one."""
    try:
        yield from batches
    finally:
        give_back()


def text_slices(batch: pa.RecordBatch, at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, in column ``at``, have about ``size`` bytes; an empty batch gives itself."""
    held = begin = 0
    for i, value in enumerate(batch.column(at)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= size:
            yield batch.slice(begin, i + 1 - begin)
            held, begin = 0, i + 1
    if begin < batch.num_rows or not batch.num_rows:
        yield batch.slice(begin)
