"""Tables that a plan of several stages writes between them, so that no stage is computed twice or lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Parquet tables of one run in the folder that ``spark.checkpoint.dir`` names; ``drop`` frees those read no more."""

    def __init__(self, spark: SparkSession) -> None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="kontig-stages-")  # a local master's executors share the driver's disk
            spark.conf.set("spark.checkpoint.dir", shared)
        self.spark, self.root = spark, f"{shared.rstrip('/')}/kontig-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back."""
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete this run's tables."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
