"""Readers of raw answer logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a tutor step log.
STEP_LOG = T.StructType([
    T.StructField("Row", T.IntegerType()),
    T.StructField("Anon Student Id", T.StringType()),
    T.StructField("Problem Hierarchy", T.StringType()),
    T.StructField("Problem Name", T.StringType()),
    T.StructField("Problem View", T.IntegerType()),
    T.StructField("Step Name", T.StringType()),
    T.StructField("Step Duration (sec)", T.DoubleType()),
    T.StructField("Correct Step Duration (sec)", T.DoubleType()),
    T.StructField("Error Step Duration (sec)", T.DoubleType()),
    T.StructField("Correct First Attempt", T.IntegerType()),
    T.StructField("Incorrects", T.IntegerType()),
    T.StructField("Hints", T.IntegerType()),
    T.StructField("Corrects", T.IntegerType()),
    T.StructField("KC(SubSkills)", T.StringType()),
    T.StructField("Opportunity(SubSkills)", T.StringType()),
])
# Columns kept from a held-out step log.
STEP_LOG_TEST = ["Row", "Anon Student Id", "Problem Hierarchy", "Correct First Attempt",
                 "Problem Name", "Step Name"]

# Where each public step-log data set lies below its root folder.
DATASETS = {
    ("a56", "train"): "algebra_2005_2006/algebra_2005_2006_train.txt",
    ("a56", "test"): "algebra_2005_2006/algebra_2005_2006_master.txt",
    ("a67", "train"): "algebra_2006_2007_new_20100409/algebra_2006_2007_train.txt",
    ("a67", "test"): "algebra_2006_2007_new_20100409/algebra_2006_2007_master.txt",
    ("a89", "train"): "algebra_2008_2009/algebra_2008_2009_train.txt",
    ("a89", "test"): "algebra_2008_2009/algebra_2008_2009_test.txt",
    ("ba67", "train"): "bridge_to_algebra_2006_2007/bridge_to_algebra_2006_2007_train.txt",
    ("ba67", "test"): "bridge_to_algebra_2006_2007/bridge_to_algebra_2006_2007_master.txt",
    ("ba89", "train"): "bridge_to_algebra_2008_2009/bridge_to_algebra_2008_2009_train.txt",
    ("ba89", "test"): "bridge_to_algebra_2008_2009/bridge_to_algebra_2008_2009_test.txt",
}
# Columns kept per data set; the others keep all they read.
KEPT = {
    "a89": ["Row", "Anon Student Id", "Problem Hierarchy", "Correct First Attempt",
            "Problem Name", "Step Name", "item_name"],
    "ba89": ["Row", "Anon Student Id", "Problem Hierarchy", "Correct First Attempt", "item_name"],
}

# Columns of a raw answer line before its JSON, and of one answer inside it.
RAW_COLUMNS = ["id", "student_id", "course_id", "course_level_id", "start_time", "city_code",
               "isdeleted", "create_time", "modify_time"]
ANSWER_FIELDS = T.StructType([
    T.StructField("answerStatus", T.IntegerType()),
    T.StructField("answerContent", T.StringType()),
    T.StructField("levelQuestionId", T.StringType()),
])
RAW_SEPARATOR = "\x01"

SKILL_LOG = T.StructType([
    T.StructField("answer", T.IntegerType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("knowledge", T.StringType()),
])


def read_step_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tutor step log with its declared 15 columns."""
    return (spark.read.schema(STEP_LOG)
            .csv(path, sep="\t", header=True, mode="FAILFAST", escape='"'))


def read_step_log_test(spark: SparkSession, path: str) -> DataFrame:
    """Held-out step log: the same file layout, six columns."""
    return read_step_log(spark, path).select(*STEP_LOG_TEST)


def item_name(problem="Problem Name", step="Step Name") -> Column:
    """Problem and step as one name; null when either is missing."""
    return F.concat(F.col(problem), F.lit(","), F.col(step))


def derive_item_name(log: DataFrame, problem="Problem Name", step="Step Name") -> DataFrame:
    return log.withColumn("item_name", item_name(problem, step))


def load_dataset(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """One of the ten named step logs, with ``item_name`` and only the columns it keeps."""
    if (name, split) not in DATASETS:
        raise ValueError(f"unknown data set {name!r} / {split!r}")
    path = f"{root.rstrip('/')}/{DATASETS[name, split]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    reader = read_step_log if split == "train" else read_step_log_test
    log = derive_item_name(reader(spark, path))
    return log.select(*KEPT[name]) if name in KEPT else log


def explode_answer_json(lines: DataFrame, value: str = "value", month: str = "p_month",
                        fields: T.StructType = ANSWER_FIELDS) -> DataFrame:
    """Raw lines to one row per answer; deleted lines are dropped, JSON keys are not kept.

    A line that is too short or whose JSON cannot be read stops the load, as it does for a step log.
    ``fields`` are those of one answer.
    """
    parts = F.split(F.col(value), RAW_SEPARATOR)
    base = [F.element_at(parts, i + 1).alias(c) for i, c in enumerate(RAW_COLUMNS)]
    parsed = F.from_json(F.element_at(parts, -1), T.MapType(T.StringType(), fields), {"mode": "FAILFAST"})
    return (lines.select(*base, F.col(month), parsed.alias("_answers"))
            .withColumn("isdeleted", F.col("isdeleted").cast("int"))
            .filter("isdeleted = 0")
            .withColumn("_answer", F.explode(F.map_values("_answers")))
            .select(*RAW_COLUMNS, *[F.col(f"_answer.{f.name}").alias(f.name) for f in fields], month))


def read_raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """Raw answer lines below ``root``; the month is the value of the ``p_month=`` folder."""
    return (spark.read.option("wholetext", "false").text(root)
            .withColumn("p_month", F.col("p_month").cast("string")))


def read_skill_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``answer, user, item, knowledge`` log; codes 1 and 2 become 0 and 1."""
    return (spark.read.schema(SKILL_LOG).csv(path, sep="\t", mode="FAILFAST")
            .withColumn("answer", F.col("answer") - 1))


def expand_pattern_counts(patterns: DataFrame, pattern: str, count: str, item_ids: list,
                          block: int = 100_000) -> DataFrame:
    """Pattern frequencies to one row per respondent and item.

    A frequent pattern is first cut into blocks of respondents, which are spread over the tasks.
    """
    blocks = patterns.withColumn("_block", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / block).cast("long"))))
    if not fits_one_block(patterns, count, block):
        blocks = blocks.repartition(pattern, "_block")
    first = F.col("_block") * block + 1
    last = F.least(F.col(count).cast("long"), (F.col("_block") + 1) * block)
    answers = F.arrays_zip(F.array(*[F.lit(i) for i in item_ids]).alias("item_id"),
                           F.col(pattern).alias("answer"))
    return (blocks.select(F.col(pattern), F.explode(F.sequence(first, last)).alias("respondent"))
            .select(pattern, "respondent", F.explode(answers).alias("_a"))
            .select(pattern, "respondent", F.col("_a.item_id").alias("item_id"),
                    F.col("_a.answer").alias("answer")))


def fits_one_block(patterns: DataFrame, count: str, block: int) -> bool:
    return patterns.filter(F.col(count) > block).isEmpty()
