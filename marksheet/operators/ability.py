"""Ability estimation with given item parameters.

Answers carry their item's a, b, c.  A learner's answers are put into an array only up to
``MAX_ANSWERS``; learners with more are estimated by rounds of combinable sums.  Both ways stop for
a learner whose ability moves by ``tol`` or less, and tell in ``converged`` whether that was reached.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import logistic as lg
from marksheet.functions.grids import normal_grid
from marksheet.operators.scoring import answered, with_parameters
from marksheet.plans.lineage import RoundTable, cut_lineage
from marksheet.plans.skew import skew_join

MAX_ANSWERS = 8192
ROUNDS = 30
TOL = 1e-10
STEP = 1.0


def score_terms(theta: Column, a: Column, b: Column, c: Column, y: Column, form: str, D: float):
    """Score and expected information of one answer with respect to ability."""
    slope = a if form == "intercept" else F.lit(float(D)) * a
    p = lg.prob(theta, a, b, c, form, D)
    rise = slope * (p - c) / (1 - c)
    return rise * (y - p) / p, rise * rise * (1 - p) / p


def newton(theta: Column, gradient: Column, information: Column, mu, sigma) -> Column:
    """One bounded Newton step; with a normal prior when ``mu`` is given."""
    if mu is not None:
        gradient = gradient - (theta - mu) / (sigma * sigma)
        information = information + 1.0 / (sigma * sigma)
    step = lg.clip(F.coalesce(F.try_divide(gradient, information), F.lit(0.0)), (-STEP, STEP))
    return lg.clip(theta + step, lg.THETA_BOUNDS)


def _estimate(answers: DataFrame, mu, sigma, form, D, rounds, max_answers, start, tol) -> DataFrame:
    rows = answered(answers).select("user_id", "a", "b", "c", "answer")
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    longest = counts.agg(F.max("_n")).first()[0]
    if longest is None or longest <= max_answers:
        return _from_arrays(rows, mu, sigma, form, D, rounds, start, tol)
    long_users = counts.filter(F.col("_n") > max_answers).select("user_id", F.lit(True).alias("_long"))
    flagged = cut_lineage(skew_join(rows, long_users, ["user_id"]), "answers")
    whole = _from_arrays(flagged.filter("_long is null"), mu, sigma, form, D, rounds, start, tol)
    return whole.unionByName(_from_sums(flagged.filter("_long"), mu, sigma, form, D, rounds, start, tol))


def _from_arrays(rows: DataFrame, mu, sigma, form, D, rounds, start, tol) -> DataFrame:
    """All Newton rounds of many learners at once, on the flat answers of an Arrow batch."""
    numbers = F.struct(*[F.col(c).cast("double").alias(c) for c in ("a", "b", "c", "answer")])
    collected = rows.groupBy("user_id").agg(F.collect_list(numbers).alias("_r"))
    schema = T.StructType([rows.schema["user_id"], T.StructField("theta", T.DoubleType()),
                           T.StructField("converged", T.BooleanType())])
    low, high = lg.THETA_BOUNDS

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_r")
            lengths = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            a, b, c, y = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
            slope = a if form == "intercept" else D * a
            shift = b if form == "intercept" else -slope * b
            theta = np.full(len(lengths), float(start))
            moved = np.full(len(lengths), np.inf)
            for _ in range(rounds):
                active = moved > tol
                if not active.any():
                    break
                p = c + (1 - c) / (1 + np.exp(-(slope * np.repeat(theta, lengths) + shift)))
                rise = slope * (p - c) / (1 - c)
                gradient = np.add.reduceat(rise * (y - p) / p, starts)
                information = np.add.reduceat(rise * rise * (1 - p) / p, starts)
                if mu is not None:
                    gradient -= (theta - mu) / sigma ** 2
                    information += 1 / sigma ** 2
                step = np.divide(gradient, information, out=np.zeros_like(theta), where=information != 0)
                new = np.clip(theta + np.clip(step, -STEP, STEP), low, high)
                moved = np.where(active, np.abs(new - theta), moved)
                theta = np.where(active, new, theta)
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), pa.array(theta), pa.array(moved <= tol)],
                                             names=["user_id", "theta", "converged"])

    return collected.mapInArrow(run, schema)


def _from_sums(rows: DataFrame, mu, sigma, form, D, rounds, start, tol) -> DataFrame:
    state = RoundTable(rows.sparkSession, "theta")
    theta = state.put(rows.select("user_id").distinct().withColumns(
        {"theta": F.lit(float(start)), "moved": F.lit(float("inf"))}))
    g, h = score_terms(*[F.col(c) for c in ("theta", "a", "b", "c", "answer")], form, D)
    new = F.when(F.col("moved") > tol, newton(F.col("theta"), F.col("g"), F.col("h"), mu, sigma)).otherwise(F.col("theta"))
    for _ in range(rounds):
        sums = skew_join(rows, theta, ["user_id"], "inner").groupBy("user_id").agg(
            F.first("theta").alias("theta"), F.first("moved").alias("moved"), F.sum(g).alias("g"), F.sum(h).alias("h"))
        theta = state.put(sums.select("user_id", new.alias("theta"), F.abs(new - F.col("theta")).alias("moved")))
        if theta.filter(F.col("moved") > tol).isEmpty():
            break
    return theta.select("user_id", "theta", (F.col("moved") <= tol).alias("converged"))


def theta_mle(answers: DataFrame, form: str = "difficulty", D: float = 1.0, rounds: int = ROUNDS,
              max_answers: int = MAX_ANSWERS, start: float = 0.0, tol: float = TOL) -> DataFrame:
    """Maximum-likelihood ability per learner: user_id, theta, converged.

    All-right and all-wrong learners reach the bounds, where they count as converged.
    """
    return _estimate(answers, None, None, form, D, rounds, max_answers, start, tol)


def theta_map(answers: DataFrame, mu: float = 0.0, sigma: float = 1.0, form: str = "difficulty",
              D: float = 1.0, rounds: int = ROUNDS, max_answers: int = MAX_ANSWERS,
              start: float = 0.0, tol: float = TOL) -> DataFrame:
    """Ability per learner with a normal prior: user_id, theta, converged."""
    return _estimate(answers, float(mu), float(sigma), form, D, rounds, max_answers, start, tol)


def theta_gradient_information(responses: DataFrame, users: DataFrame, items: DataFrame,
                               form: str = "difficulty", D: float = 1.0) -> DataFrame:
    """Score and information of every learner at the given ability."""
    g, h = score_terms(*[F.col(c) for c in ("theta", "a", "b", "c", "answer")], form, D)
    return with_parameters(answered(responses), users, items).groupBy("user_id").agg(
        F.sum(g).alias("gradient"), F.sum(h).alias("information"))


def item_node_logs(items: DataFrame, nodes: list[float], form: str, D: float) -> DataFrame:
    """log P(wrong) and log P(right) of every item at every node, as two arrays."""
    def logs(answer):
        return F.transform(lg.doubles(nodes), lambda t: lg.bernoulli_log(F.lit(answer), lg.prob(t, form=form, D=D)))

    return items.select("item_id", logs(0).alias("_log0"), logs(1).alias("_log1"))


def estep_posterior(responses: DataFrame, items: DataFrame, size: int = 40, low: float = -6.0,
                    high: float = 6.0, weights: str = "normal", form: str = "intercept",
                    D: float = 1.0) -> DataFrame:
    """Posterior of every learner over the ability grid: user_id, posterior, loglik.

    One combinable sum per node, so a learner with very many answers never sits in one task.
    """
    nodes, mass = normal_grid(size, low, high, weights)
    joined = skew_join(answered(responses), item_node_logs(items, nodes, form, D), ["item_id"], "inner")
    logs = F.when(F.col("answer") == 1, F.col("_log1")).otherwise(F.col("_log0"))
    summed = joined.select("user_id", logs.alias("_log")).groupBy("user_id").agg(
        lg.array_of("sum(_log[{k}])", size).alias("_sums"))
    raw = F.zip_with("_sums", lg.doubles(np.log(mass)), lambda s, m: s + m)
    return normalized(summed.select("user_id", raw.alias("_raw")))


def normalized(raw: DataFrame) -> DataFrame:
    """Unnormalised log weights ``_raw`` to a posterior that sums to 1, by log-sum-exp."""
    keys = [c for c in raw.columns if c != "_raw"]
    shifted = raw.withColumn("_max", F.array_max("_raw")) \
        .withColumn("_w", F.transform("_raw", lambda x: F.exp(x - F.col("_max")))) \
        .withColumn("_total", F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x))
    return shifted.select(*keys, F.transform("_w", lambda x: x / F.col("_total")).alias("posterior"),
                          (F.col("_max") + F.log("_total")).alias("loglik"))


def posterior_mean(nodes: list[float]) -> Column:
    return lg.dot("posterior", lg.doubles(nodes))


def theta_eap(responses: DataFrame, items: DataFrame, size: int = 40, low: float = -6.0, high: float = 6.0,
              weights: str = "normal", form: str = "intercept", D: float = 1.0) -> DataFrame:
    """Posterior mean ability of every learner."""
    nodes, _ = normal_grid(size, low, high, weights)
    return estep_posterior(responses, items, size, low, high, weights, form, D).select(
        "user_id", posterior_mean(nodes).alias("theta"))
