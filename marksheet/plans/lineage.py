"""Written tables between the rounds of a job.

A round's state is written as Parquet in the shared folder named by ``spark.checkpoint.dir``.
Lost executors then cost a re-read instead of a recomputation of all earlier rounds, and the
optimizer sees the true file size when it decides whether a side may be broadcast.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="marksheet-")
    return _local_dirs[app]


def scratch_root(spark: SparkSession) -> str:
    """Where this application writes."""
    return f"{scratch_dir(spark)}/marksheet/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written and not yet deleted; results not yet written are lost."""
    delete_path(spark, scratch_root(spark))


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class RoundTable:
    """The state of an iterative job: one written table per round, the one before it dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)
        self.round = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.round += 1
        path = f"{self.base}/round={self.round}"
        df.write.parquet(path)
        if self.round > 1:
            delete_path(self.spark, f"{self.base}/round={self.round - 1}")
        return self.spark.read.schema(df.schema).parquet(path)
