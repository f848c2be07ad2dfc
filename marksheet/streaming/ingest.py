"""The raw-log load as a file stream: the same rows as ``raw_to_table``, month by month as they land."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marksheet.sources.logs import explode_answer_json


def raw_stream(spark: SparkSession, raw_root: str) -> DataFrame:
    """Answers of the raw lines below ``raw_root``, as a stream; months come from the folder names."""
    lines = spark.readStream.schema("value string, p_month string").text(raw_root)
    return explode_answer_json(lines)


def stream_to_table(spark: SparkSession, raw_root: str, path: str, checkpoint: str) -> StreamingQuery:
    """Load everything that has landed, exactly once per file, and stop."""
    return (raw_stream(spark, raw_root).writeStream.format("parquet").partitionBy("p_month")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
