"""Jobs on a four-parameter item bank (difficulty form)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.functions import logistic as lg
from marksheet.plans.skew import null_safe_sum, skew_join


def over_grid(items: DataFrame, grid: list[float]) -> DataFrame:
    """Each item once per ability of a fixed grid."""
    return items.withColumn("theta", F.explode(lg.doubles(grid)))


def information(D: float = 1.0, parity: bool = True) -> Column:
    """Item information; ``parity`` leaves the scale out of the slope factor."""
    p = F.col("prob")
    slope = F.col("a") if parity else F.lit(float(D)) * F.col("a")
    spread = F.col("d") - F.col("c")
    return F.try_divide((slope * (p - F.col("c")) * (F.col("d") - p)) ** 2, spread ** 2 * p * (1 - p))


def item_characteristic_curve(items: DataFrame, grid: list[float], D: float = 1.0) -> DataFrame:
    """Chance of a right answer per item over an ability grid."""
    return over_grid(items, grid).withColumn("prob", lg.prob4("theta", D=D)).select("item_id", "theta", "prob")


def item_information_curve(items: DataFrame, grid: list[float], D: float = 1.0, parity: bool = True) -> DataFrame:
    """Information per item over an ability grid."""
    return (over_grid(items, grid).withColumn("prob", lg.prob4("theta", D=D))
            .select("item_id", "theta", information(D, parity).alias("information")))


def test_information(items: DataFrame, grid: list[float], test: str = "test_id", D: float = lg.SCALE,
                     parity: bool = True) -> DataFrame:
    """Information, variance, standard error and reliability of each test over an ability grid."""
    infinity = F.lit(math.inf)
    summed = (over_grid(items, grid).withColumn("prob", lg.prob4("theta", D=D))
              .groupBy(test, "theta").agg(F.sum(information(D, parity)).alias("information")))
    variance = F.coalesce(F.try_divide(F.lit(1.0), F.col("information")), -infinity)
    return (summed.withColumn("variance", variance)
            .withColumn("standard_error", F.when(F.col("variance") < 0, infinity)
                        .otherwise(F.sqrt("variance")))
            .withColumn("reliability", 1 - F.col("variance")))


def item_peak_information(items: DataFrame) -> DataFrame:
    """Ability at which each item is most informative, in closed form."""
    c, d = F.col("c"), F.col("d")
    u = (c + d - 2 * c * d) / 2 - 0.75
    v = (c + d - 1) / 4
    angle = F.acos(-(v / 2) * F.sqrt(27 / -(u * u * u))) / 3 + 4 * math.pi / 3
    peak = 2 * F.sqrt(-u / 3) * F.cos(angle) + 0.5
    return items.select("item_id", (F.col("b") + F.log((peak - c) / (d - peak)) / F.col("a")).alias("peak_theta"))


def bank_log_likelihood(responses: DataFrame, users: DataFrame, items: DataFrame, D: float = lg.SCALE) -> DataFrame:
    """Four-parameter log-likelihood of each learner's answers, and its negative."""
    checked = F.when(F.col("answer").isin(0, 1), F.col("answer")).otherwise(
        F.raise_error(F.lit("answers must be 0 or 1")).cast("int"))
    joined = skew_join(skew_join(responses.withColumn("answer", checked), items, ["item_id"], "inner"),
                       users, ["user_id"], "inner")
    return (joined.groupBy("user_id")
            .agg(F.sum(lg.bernoulli_log("answer", lg.prob4("theta", D=D))).alias("loglik"))
            .withColumn("neg_loglik", -F.col("loglik")))


def normalize_item_bank(items: DataFrame) -> DataFrame:
    """Fill a bank that has only b, or a and b, or a, b and c, to four parameters."""
    defaults = {"a": 1.0, "c": 0.0, "d": 1.0}
    return items.select("item_id", *[
        (F.coalesce(F.col(c), F.lit(defaults[c])) if c in items.columns else F.lit(defaults[c])).alias(c)
        if c in defaults else F.col(c) for c in ("a", "b", "c", "d")])


def validate_item_bank(items: DataFrame, raise_error: bool = False) -> DataFrame:
    """Violations per rule: rule, n.  A missing column counts every row."""
    rules = {
        "a < 0": ("a", lambda x: x < 0),
        "c < 0": ("c", lambda x: x < 0),
        "c > 1": ("c", lambda x: x > 1),
        "d < 0": ("d", lambda x: x < 0),
        "d > 1": ("d", lambda x: x > 1),
    }
    missing = {f"no column {c}": c for c in ("a", "b", "c", "d")}
    counts = [null_safe_sum(test(F.col(c)) if c in items.columns else F.lit(False)).alias(rule)
              for rule, (c, test) in rules.items()]
    counts += [null_safe_sum(F.lit(c not in items.columns)).alias(rule) for rule, c in missing.items()]
    wide = items.agg(*counts)
    report = wide.select(F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("n")) for rule in wide.columns])).alias("_r")) \
        .select("_r.rule", "_r.n")
    if raise_error:
        broken = [row.rule for row in report.filter("n > 0").collect()]
        if broken:
            raise ValueError("item bank: " + ", ".join(broken))
    return report
