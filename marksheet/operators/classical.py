"""Classical item statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.plans.skew import skew_join


def item_calibration(responses: DataFrame, item: str = "item_id", answer: str = "answer") -> DataFrame:
    """Laplace-corrected accuracy and difficulty on a 0..5 scale; slope 1, guess 0."""
    accuracy = (F.sum(answer) + 1.0) / (F.count(answer) + 2)
    return (responses.groupBy(item)
            .agg(F.count(answer).alias("n"), F.sum(answer).cast("long").alias("n_right"),
                 accuracy.alias("accuracy"))
            .withColumn("difficulty", (1 - F.col("accuracy")) * 5)
            .withColumn("slope", F.lit(1.0)).withColumn("guess", F.lit(0.0)))


def difficulty_unsmoothed(responses: DataFrame, item: str = "item_id", answer: str = "answer") -> DataFrame:
    """Difficulty (1 - mean) * 5 without correction."""
    return responses.groupBy(item).agg(((1 - F.avg(answer)) * 5).alias("difficulty"))


def attach_item_info(rows: DataFrame, items: DataFrame, item: str = "item_id",
                     names: dict[str, str] | None = None) -> DataFrame:
    """Item statistics joined to every answer (null for unknown items), with columns renamed."""
    return skew_join(rows.withColumnsRenamed(names or {}), items.withColumnsRenamed(names or {}), [item])


def mean_accuracy_by(responses: DataFrame, columns: list[str], answer: str = "answer") -> DataFrame:
    """Mean answer by each of several columns in one pass: dimension, key, n, accuracy."""
    sets = [[F.col(c)] for c in columns]
    grouped = responses.groupingSets(sets, *columns).agg(
        F.count(answer).alias("n"), F.avg(answer).alias("accuracy"), F.grouping_id().alias("_id"))
    # In the grouping id, the bit of the one column that is kept is 0.
    full = (1 << len(columns)) - 1
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        kept = F.col("_id") == (full ^ (1 << (len(columns) - 1 - i)))
        dimension = F.when(kept, F.lit(c)).otherwise(dimension)
        key = F.when(kept, F.col(c).cast("string")).otherwise(key)
    return grouped.select(dimension.alias("dimension"), key.alias("key"), "n", "accuracy")
