"""Answer tables, parameter tables and result files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.plans.skew import skew_join
from marksheet.sources.logs import explode_answer_json, read_raw_lines


def insert_json_into_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Load JSON rows into an existing table, replacing only the partitions they touch."""
    target = spark.table(table)
    rows = spark.read.schema(target.schema).json(path, mode="FAILFAST").select(*target.columns)
    insert_overwrite(rows, table)
    return spark.table(table)


def insert_overwrite(rows: DataFrame, table: str) -> None:
    spark = rows.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, "STATIC")
    spark.conf.set(key, "dynamic")
    try:
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, before)


def write_answers_partitioned(answers: DataFrame, path: str, month: str = "p_month") -> None:
    """Answer table as Parquet, one folder per month; months without new rows stay."""
    answers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def raw_to_table(spark: SparkSession, raw_root: str, path: str) -> DataFrame:
    """Raw lines to the month-partitioned answer table, in one job."""
    write_answers_partitioned(explode_answer_json(read_raw_lines(spark, raw_root)), path)
    return spark.read.parquet(path)


def star_join_responses(fact: DataFrame, dims: list[tuple[DataFrame, str, str]],
                        where: Column, answer: Column, columns: dict[str, str]) -> DataFrame:
    """Answer log from a fact table and its dimensions: ``dims`` holds (table, fact key, its key)."""
    joined = fact
    for dim, fact_key, dim_key in dims:
        joined = joined.join(dim, F.col(fact_key) == F.col(dim_key))
    return joined.filter(where).select(
        *[F.col(source).alias(name) for name, source in columns.items()], answer.alias("answer"))


def slice_responses(log: DataFrame, equals: dict, columns: list[str]) -> DataFrame:
    """Rows matching every equality, with an explicit projection; both reach the file scan."""
    rows = log
    for name, value in equals.items():
        rows = rows.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return rows.select(*columns)


def recode_answers(log: DataFrame, names: dict[str, str], answer: str = "answer") -> DataFrame:
    """Canonical column names; any answer code but 1 (also null) becomes 0."""
    return (log.select(*[F.col(old).alias(new) for old, new in names.items()])
            .withColumn(answer, F.when(F.col(answer) == 1, 1).otherwise(0)))


def read_with_fallback(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the primary source, and of the secondary one for keys the primary lacks."""
    known = primary.select(*key).distinct()
    return primary.unionByName(skew_join(secondary, known, key, "left_anti"))


def candidate_items(items: DataFrame, equals: dict, within: dict[str, list], like: dict[str, str]) -> DataFrame:
    """Item-bank rows by equality, list and pattern, with slope 1."""
    rows = items
    for name, value in equals.items():
        rows = rows.filter(F.col(name) == value)
    for name, values in within.items():
        rows = rows.filter(F.col(name).isin(values))
    for name, pattern in like.items():
        rows = rows.filter(F.col(name).like(pattern))
    return rows.withColumn("a", F.lit(1.0))


def save_params(items: DataFrame, users: DataFrame, path: str) -> None:
    items.write.mode("overwrite").parquet(f"{path}/items")
    users.write.mode("overwrite").parquet(f"{path}/users")


def load_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/users")


def write_submission(predictions: DataFrame, path: str, row="row_id", prob="prob") -> None:
    """Row and probability as a tab-separated file with a header."""
    predictions.select(row, prob).write.mode("overwrite").csv(path, sep="\t", header=True)


def badcase_rows(evaluated: DataFrame, answer="answer", label="pred_label") -> DataFrame:
    """Evaluated rows whose label is wrong."""
    return evaluated.filter(F.col(label) != F.col(answer))


def write_badcase(evaluated: DataFrame, path: str, answer="answer", label="pred_label") -> None:
    badcase_rows(evaluated, answer, label).write.mode("overwrite").parquet(path)
