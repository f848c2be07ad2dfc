"""Graded responses: P(score >= j) = sigmoid(slope * theta + threshold_j)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import logistic as lg
from marksheet.functions.grids import hermite_grid
from marksheet.operators import marginal, newton
from marksheet.operators.ability import normalized
from marksheet.operators.patterns import pack, table
from marksheet.plans.lineage import RoundTable, cut_lineage
from marksheet.plans.skew import kept_by, skew_join

TINY = 1e-200
MAX_STEP = 1.0


def score_range(scores: DataFrame) -> tuple[int, int]:
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    return int(low), int(high)


def score_patterns(scores: DataFrame) -> DataFrame:
    """Indicator of every category for each learner and item."""
    low, high = score_range(scores)
    return scores.withColumn("category", F.explode(F.sequence(F.lit(low), F.lit(high)))).select(
        "user_id", "item_id", "category", F.when(F.col("score") == F.col("category"), 1).otherwise(0).alias("hit"))


def start_items(scores: DataFrame, categories: int) -> DataFrame:
    """Slope 1 and evenly spaced falling thresholds."""
    thresholds = [categories / 2 - 1 - i for i in range(categories - 1)]
    return scores.select("item_id").distinct().select(
        "item_id", F.lit(1.0).alias("slope"), lg.doubles(thresholds).alias("thresholds"))


def _category_arrays(nodes: list[float]):
    """Per node, the probability of every category."""
    def at(theta):
        upto = F.transform("thresholds", lambda t: lg.sigmoid(F.col("slope") * theta + t))
        above = F.concat(F.array(F.lit(1.0)), upto)
        below = F.concat(upto, F.array(F.lit(0.0)))
        return F.zip_with(above, below, lambda x, y: x - y)

    return F.transform(lg.doubles(nodes), at)


def grm_category_probs(items: DataFrame, nodes: list[float] | None = None) -> DataFrame:
    """Chance of every category per item and node: item_id, node, theta, category, prob."""
    nodes = hermite_grid()[0] if nodes is None else nodes
    return (items.select("item_id", F.posexplode(F.arrays_zip(
                lg.doubles(nodes).alias("theta"), _category_arrays(nodes).alias("probs"))).alias("node", "_n"))
            .select("item_id", "node", F.col("_n.theta").alias("theta"),
                    F.posexplode("_n.probs").alias("category", "prob")))


def grm_estep(scores: DataFrame, items: DataFrame, low: int, size: int = 11) -> DataFrame:
    """Expected learners per item, score and node: item_id, score, counts (array over nodes).

    Two combinable aggregations; neither a learner nor an item is gathered in one place.
    """
    nodes, mass = hermite_grid(size)
    logs = items.select("item_id", F.transform(_category_arrays(nodes), lambda probs: F.transform(
        probs, lambda p: F.log(F.greatest(p, F.lit(TINY))))).alias("_logs"))
    joined = skew_join(scores, logs, ["item_id"], "inner")
    summed = joined.groupBy("user_id").agg(
        lg.array_of(f"sum(_logs[{{k}}][score - {low}])", size).alias("_sums"))
    raw = F.zip_with("_sums", lg.doubles(np.log(mass)), lambda s, m: s + m)
    posterior = normalized(summed.select("user_id", raw.alias("_raw")))
    weighted = skew_join(scores, posterior.select("user_id", "posterior"), ["user_id"], "inner")
    return weighted.groupBy("item_id", "score").agg(lg.array_of("sum(posterior[{k}])", size).alias("counts"))


def category_chances(slope, thresholds, nodes):
    """P(score >= j) for j = 0..m+1 and P(score = j), per item and node."""
    n = len(slope)
    upto = 1 / (1 + np.exp(-(slope[:, None, None] * nodes + thresholds[:, :, None])))
    edge = np.ones((n, 1, len(nodes)))
    reach = np.concatenate([edge, upto, 0 * edge], axis=1)
    return reach, reach[:, :-1] - reach[:, 1:]


def expected_log_likelihood(slope, thresholds, counts, nodes):
    """Per item; minus infinity where thresholds do not fall."""
    _, chance = category_chances(slope, thresholds, nodes)
    value = (counts * np.log(np.maximum(chance, 1e-300))).sum((1, 2))
    return np.where((np.diff(thresholds, axis=1) < 0).all(1), value, -np.inf)


def newton_step(slope, thresholds, counts, nodes):
    """One Fisher step of every item, halved until it gains; counts are (item, category, node)."""
    n, m = thresholds.shape
    reach, chance = category_chances(slope, thresholds, nodes)
    rise = reach * (1 - reach)
    chance = np.maximum(chance, 1e-12)
    slopes = np.zeros((n, m + 1, m + 1, len(nodes)))   # item, category, parameter, node
    for j in range(m):
        slopes[:, j + 1, j] = rise[:, j + 1]
        slopes[:, j, j] = -rise[:, j + 1]
    slopes[:, :, m] = nodes * (rise[:, :-1] - rise[:, 1:])
    gradient = np.einsum("nck,ncpk->np", counts / chance, slopes)
    information = np.einsum("nk,ncpk,ncqk->npq", counts.sum(1), slopes / chance[:, :, None], slopes)
    information += 1e-9 * np.eye(m + 1)
    step = np.clip(np.linalg.solve(information, gradient[:, :, None])[:, :, 0], -MAX_STEP, MAX_STEP)
    before = expected_log_likelihood(slope, thresholds, counts, nodes)
    for _ in range(30):
        after = expected_log_likelihood(slope + step[:, m], thresholds + step[:, :m], counts, nodes)
        worse = after < before
        if not worse.any():
            break
        step[worse] /= 2
    return slope + step[:, m], thresholds + step[:, :m], np.abs(step).max(1)


def grm_mstep(items: DataFrame, counts: DataFrame, low: int, high: int, size: int = 11) -> DataFrame:
    """New slope and thresholds: item_id, slope, thresholds, moved.  One row per item."""
    nodes = np.array(hermite_grid(size)[0])
    zeros = lg.doubles([0.0] * size)
    by_score = counts.groupBy("item_id").agg(*[
        F.max(F.when(F.col("score") == s, F.col("counts"))).alias(f"_c{i}")
        for i, s in enumerate(range(low, high + 1))])
    table = items.select("item_id", "slope", "thresholds").join(by_score, ["item_id"]).select(
        "item_id", "slope", "thresholds",
        F.concat(*[F.coalesce(f"_c{i}", zeros) for i in range(high - low + 1)]).alias("counts"))
    schema = T.StructType([table.schema["item_id"], T.StructField("slope", T.DoubleType()),
                           T.StructField("thresholds", T.ArrayType(T.DoubleType())),
                           T.StructField("moved", T.DoubleType())])

    def step(frames):
        for frame in frames:
            if frame.empty:
                continue
            slope, thresholds, moved = newton_step(
                frame["slope"].to_numpy(), np.stack(frame["thresholds"].to_numpy()),
                np.stack(frame["counts"].to_numpy()).reshape(len(frame), high - low + 1, size), nodes)
            out = frame[["item_id"]].copy()
            out["slope"], out["thresholds"], out["moved"] = slope, list(thresholds), moved
            yield out

    return table.mapInPandas(step, schema)


def log_slopes(slope, thresholds, nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of ``category_chances`` with first and second derivatives by (slope, thresholds): (item, category[, ...], node)."""
    n, m = thresholds.shape
    reach, chance = category_chances(slope, thresholds, nodes)
    chance = np.maximum(chance, TINY)
    rise = reach * (1 - reach)
    bend = rise * (1 - 2 * reach)
    first, second = np.zeros((n, m + 1, m + 1, len(nodes))), np.zeros((n, m + 1, m + 1, m + 1, len(nodes)))
    for j in range(1, m + 1):
        for category, sign in ((j, 1.0), (j - 1, -1.0)):
            first[:, category, j] += sign * rise[:, j]
            first[:, category, 0] += sign * nodes * rise[:, j]
            second[:, category, j, j] += sign * bend[:, j]
            second[:, category, 0, j] += sign * nodes * bend[:, j]
            second[:, category, j, 0] += sign * nodes * bend[:, j]
            second[:, category, 0, 0] += sign * nodes ** 2 * bend[:, j]
    first /= chance[:, :, None]
    second = second / chance[:, :, None, None] - first[:, :, :, None] * first[:, :, None]
    return np.log(chance), first, second


INNER = 10      # Fisher steps of every item between two expectation steps
EARLY = 8       # EM steps before Newton steps


def fit_grm(scores: DataFrame, max_rounds: int = 1000, tol: float = 1e-5, size: int = 11, history: list | None = None):
    """EM until no parameter moves by ``tol``: items (item_id, slope, thresholds, converged) and the number of rounds.

    Equal score patterns are merged and EM steps extrapolated where that raises the marginal log-likelihood,
    which ``history`` gets.  After ``EARLY`` steps come Newton steps, with up to ``newton.UNKNOWNS`` parameters, till the one that is left is
    below ``tol``; where they do not get there, EM goes on.  With more items than ``patterns.MOST_ITEMS`` the steps go by joins.
    """
    scores = cut_lineage(scores.select("user_id", "item_id", "score"), "scores")
    low, high = score_range(scores)
    found = pack(scores.withColumn("score", F.col("score") - F.lit(low)), "score")
    if found is None:
        return _fit_by_joins(scores, max_rounds, tol, size)
    nodes, mass = (np.array(x) for x in hermite_grid(size))
    first = start_items(scores, high - low + 1).first()
    start = np.tile([first.slope, *first.thresholds], (len(found.items), 1))
    blocks = found.blocks()

    def em(x):
        _, chance = category_chances(x[:, 0], x[:, 1:], nodes)
        loglik, counts = marginal.expectation(blocks, np.log(np.maximum(chance, TINY)), mass)
        slope, thresholds = x[:, 0], x[:, 1:]
        for _ in range(INNER):
            slope, thresholds, moved = newton_step(slope, thresholds, counts, nodes)
            if moved.max() < 1e-9:
                break
        return loglik, np.column_stack([slope, thresholds])

    falling = lambda x: x if (np.diff(x[:, 1:], axis=1) < 0).all() else None
    settled = lambda f0, f1, x0, x1: np.abs(x1 - x0).max() < tol

    def curvature(z):
        x = z.reshape(start.shape)
        if falling(x) is None:
            return -np.inf, np.zeros(z.size), np.zeros((z.size, z.size))
        return marginal.curvature(blocks, *log_slopes(x[:, 0], x[:, 1:], nodes), mass)

    use_newton = start.size <= newton.UNKNOWNS
    x, _, rounds, done, values = marginal.accelerated(start, em, falling, min(EARLY, max_rounds) if use_newton else max_rounds, settled)
    if use_newton and not done and rounds < max_rounds:
        z, _, used, done, more = newton.ascend(x.ravel(), curvature, lambda step, _: np.abs(step).max() < tol, passes=min(newton.PASSES, max_rounds - rounds))
        x, rounds, values = z.reshape(start.shape), rounds + used, [*values, *more[1:]]
        if not done and rounds < max_rounds:
            x, _, used, done, more = marginal.accelerated(x, em, falling, max_rounds - rounds, settled)
            rounds, values = rounds + used, [*values, *more[1:]]
    if history is not None:
        history += values
    return table(scores.sparkSession, found.items, scores.schema["item_id"],
                 {"slope": x[:, 0], "thresholds": x[:, 1:], "converged": done}), rounds


def _fit_by_joins(scores: DataFrame, max_rounds: int, tol: float, size: int):
    """EM as joins and sums over the long table, for any number of items."""
    scores = kept_by(cut_lineage(scores.select("user_id", "item_id", "score"), "scores"), "user_id")
    low, high = score_range(scores)
    state = RoundTable(scores.sparkSession, "items")
    items = state.put(start_items(scores, high - low + 1).withColumn("moved", F.lit(float("inf"))))
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        counts = grm_estep(scores, items, low, size)
        items = state.put(grm_mstep(items, counts, low, high, size))
        if items.agg(F.max("moved")).first()[0] < tol:
            break
    scores.unpersist()
    return items.select("item_id", "slope", "thresholds", (F.col("moved") < tol).alias("converged")), rounds
