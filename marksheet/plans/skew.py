"""Joins, ranks and running totals that stay spread out when one key holds a large share of rows."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marksheet.plans.lineage import cut_lineage

HOT_ROWS = 1_000_000   # a key with more rows than this is split


def tune(spark: SparkSession) -> None:
    """Session settings every job here relies on; all of them can be changed at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Rows here are small but costly (folds, EM), so small partitions are worth their own task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > hot_rows).select(*keys))


def skew_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join of a large ``fact`` with a table that has one row per key.

    No hint: adaptive execution (see ``tune``) decides from real shuffle sizes whether the small side
    is broadcast, and splits a hot partition of ``fact``.
    """
    return fact.join(dim, on, how)


def kept_by(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A written table for repeated joins and sums on ``key``: hash-partitioned and kept on the
    executors' disks, so that no round shuffles it again.

    Left as it is when some key is hot, since its rows must not share one partition.  Lost blocks
    are rebuilt from the written table.  The caller unpersists it.
    """
    if not hot_keys(df, [key], hot_rows).isEmpty():
        return df
    return df.repartition(key).persist(StorageLevel.DISK_ONLY)


def range_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned on ``order`` and written, with the partition number as ``_part``.

    The table is written because a second evaluation could sample other range bounds.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str],
                   keys: list[str] | None = None) -> DataFrame:
    """Exact running totals over a global order without a single-task window.

    Adds, for every ``{new: value column}``, the total over all rows at or before this one.
    ``order`` must be unique within ``keys``.  Each range partition is summed on its own and then
    shifted by the total of the partitions before it.
    """
    keys = keys or []
    parts = range_parts(df, [*keys, *order])
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*keys, "_part", *[
        F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in totals])
    within = Window.partitionBy(*keys, "_part").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.select("*", *[F.sum(v).over(within).alias(n) for n, v in totals.items()])
    joined = summed.join(F.broadcast(shifts) if not keys else shifts, [*keys, "_part"])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_shift_{n}")).alias(n) for n in totals])


def dense_rank_of(keys: DataFrame, order: list[str], alias: str) -> DataFrame:
    """Number distinct rows 0..n-1 in ``order``."""
    numbered = running_totals(keys.withColumn("_one", F.lit(1).cast("long")), order, {alias: "_one"})
    return numbered.withColumn(alias, F.col(alias) - 1).drop("_one")


def row_number_by(df: DataFrame, keys: list[str], order: list[str], alias: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row_number`` within ``keys`` by the unique ``order``; hot groups are ranked in pieces."""
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias(alias)
    if hot_keys(df, keys, hot_rows).isEmpty():
        return df.select("*", plain)
    hot = hot_keys(df, keys, hot_rows)
    cold = df.join(hot, keys, "left_anti").select("*", plain)
    counted = running_totals(df.join(hot, keys, "left_semi").withColumn("_one", F.lit(1).cast("long")),
                             order, {alias: "_one"}, keys).drop("_one")
    return cold.unionByName(counted)


def null_safe_sum(condition: Column) -> Column:
    """Number of rows where ``condition`` holds, 0 for an empty table."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows in so many parts that every core has some, for work that costs time by its numbers, not by its bytes.

    The parts go by a hash of their own: by the keys themselves, an exchange before would be taken for this one and coalesced.
    """
    spark = rows.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, F.xxhash64(*keys))
