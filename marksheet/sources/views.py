"""Answer-log views over the star-schema tables: the inputs of the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered answers: user_id, skill, item_id, answer, ts, event_id."""
    k = F.get_json_object("props", "$.k").cast("int") % 20
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("skill"),
        F.concat(F.col("event_type"), F.lit(","), k.cast("string")).alias("item_id"),
        F.when(F.col("value") >= 35, 1).otherwise(0).alias("answer"), "ts", "event_id")


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("item_id"))
            .agg(F.avg("l_quantity").alias("avg_quantity")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 0/1 answer per learner and item: user_id, item_id, answer."""
    return _purchases(spark, sf_dir).select(
        "user_id", "item_id", F.when(F.col("avg_quantity") >= 25.5, 1).otherwise(0).alias("answer"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graded score 0..3 per learner and item: user_id, item_id, score."""
    graded = F.least(F.lit(3), F.floor((F.col("avg_quantity") - 1) / 12.5)).cast("int")
    return _purchases(spark, sf_dir).select("user_id", "item_id", graded.alias("score"))


def items(responses: DataFrame) -> DataFrame:
    """Deterministic item parameters for an answer table: item_id, a, b, c."""
    digits = F.substring("item_id", 7, 10).cast("int") % 10
    smoothed = (F.sum("answer") + 1.0) / (F.count("answer") + 2)
    return responses.groupBy("item_id").agg(((1 - smoothed) * 5 - 2.5).alias("b")).select(
        "item_id", (0.75 + 0.05 * digits).alias("a"), "b", (0.01 * digits).alias("c"))


def users(responses: DataFrame) -> DataFrame:
    """A starting ability for each learner: user_id, theta."""
    return responses.groupBy("user_id").agg((F.avg("answer") * 4 - 2).alias("theta"))
