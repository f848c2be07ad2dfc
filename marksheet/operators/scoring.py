"""Scoring with given item and learner parameters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.functions import logistic as lg
from marksheet.plans.skew import skew_join

ITEMS_PER_BLOCK = 1000


def with_parameters(responses: DataFrame, users: DataFrame | None, items: DataFrame) -> DataFrame:
    """Answers with the parameters of their item and, if given, learner."""
    joined = skew_join(responses, items, ["item_id"], "inner")
    return joined if users is None else skew_join(joined, users, ["user_id"], "inner")


def answered(responses: DataFrame) -> DataFrame:
    """The rows with an answer: a missing one says nothing about learner or item."""
    return responses.filter(F.col("answer").isNotNull())


def score_records(pairs: DataFrame, users: DataFrame, items: DataFrame, form: str = "difficulty",
                  D: float = lg.SCALE) -> DataFrame:
    """Chance of a right answer for given (learner, item) pairs."""
    return with_parameters(pairs, users, items).withColumn("prob", lg.prob(form=form, D=D))


def user_item_table(users: DataFrame, items: DataFrame, params: list[str]) -> DataFrame:
    """Every learner with every item: the output itself has learners x items rows.

    Items are packed into blocks of bounded size.  Each learner row is repeated once per block and
    meets the block by an equi-join on (block, salt), with the learners spread over all salts.
    """
    spark = users.sparkSession
    n_blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = (items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int"))
              .groupBy("_block").agg(F.collect_list(F.struct("item_id", *params)).alias("_items"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))))
    asked = (users.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
             .withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(splits)).cast("int")))
    return (asked.join(packed, ["_block", "_salt"]).withColumn("_item", F.explode("_items"))
            .select(*users.columns, *[F.col(f"_item.{c}").alias(c) for c in ("item_id", *params)]))


def score_matrix(users: DataFrame, items: DataFrame, form: str = "difficulty", D: float = lg.SCALE) -> DataFrame:
    """Chance of a right answer for every learner and item."""
    return user_item_table(users, items, ["a", "b", "c"]).select(
        "user_id", "item_id", lg.prob(form=form, D=D).alias("prob"))


def mirt_probability(compensatory: bool = True) -> Column:
    return lg.prob_compensatory() if compensatory else lg.prob_noncompensatory()


def mirt_score_records(pairs: DataFrame, users: DataFrame, items: DataFrame,
                       compensatory: bool = True) -> DataFrame:
    """Multi-dimensional scoring of given pairs; theta, a (and b) are arrays."""
    return with_parameters(pairs, users, items).withColumn("prob", mirt_probability(compensatory))


def mirt_score_matrix(users: DataFrame, items: DataFrame, compensatory: bool = True) -> DataFrame:
    """Multi-dimensional scoring of every learner and item."""
    return user_item_table(users, items, ["a", "b", "c"]).select(
        "user_id", "item_id", mirt_probability(compensatory).alias("prob"))


def _answer_log(form: str, D: float) -> Column:
    return lg.bernoulli_log("answer", lg.prob(form=form, D=D))


def log_likelihood(responses: DataFrame, users: DataFrame, items: DataFrame, form: str = "difficulty",
                   D: float = lg.SCALE) -> DataFrame:
    """Log-likelihood of all answers."""
    return with_parameters(responses, users, items).agg(
        F.count("answer").alias("n"), F.sum(_answer_log(form, D)).alias("loglik"))


def log_likelihood_by_user(responses: DataFrame, users: DataFrame, items: DataFrame,
                           form: str = "difficulty", D: float = lg.SCALE) -> DataFrame:
    return with_parameters(responses, users, items).groupBy("user_id").agg(
        F.count("answer").alias("n"), F.sum(_answer_log(form, D)).alias("loglik"))


def model_fit_stats(responses: DataFrame, users: DataFrame, items: DataFrame, form: str = "difficulty",
                    D: float = lg.SCALE) -> DataFrame:
    """Root mean squared error and share of answers equal to the rounded probability."""
    p = lg.prob(form=form, D=D)
    return with_parameters(responses, users, items).agg(
        F.sqrt(F.avg((F.col("answer") - p) ** 2)).alias("rmse"),
        F.avg((F.rint(p) == F.col("answer")).cast("double")).alias("accuracy"))
