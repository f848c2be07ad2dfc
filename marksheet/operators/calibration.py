"""Item calibration: estimates of a, b and c from a long answer table.

Every round is a combinable sum per item, followed by a closed-form step on the item table, so
neither a popular item nor a busy learner is ever gathered in one place.  All in intercept form
(a * theta + b) unless stated.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import logistic as lg
from marksheet.functions.grids import normal_grid
from marksheet.operators import marginal
from marksheet.operators.ability import estep_posterior, posterior_mean
from marksheet.operators.patterns import pack, per_row, table
from marksheet.operators.scoring import answered, with_parameters
from marksheet.plans.lineage import RoundTable, cut_lineage
from marksheet.plans.skew import kept_by, skew_join

MAX_STEP = 1.0


def item_slopes(theta: Column, a: Column, b: Column, c: Column, form: str = "intercept", D: float = 1.0):
    """P(right) and its derivatives with respect to a, b and c."""
    s = lg.sigmoid(lg.clip(lg.linear(theta, a, b, form, D), (-30.0, 30.0)))
    p = c + (1 - c) * s
    rise = (1 - c) * s * (1 - s)
    if form == "intercept":
        return p, [rise * theta, rise, 1 - s]
    return p, [rise * float(D) * (theta - b), rise * (-float(D)) * a, 1 - s]


def item_gradient_information(responses: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Score vector and curvature of every item with respect to slope and intercept."""
    p, (da, db, _) = item_slopes(*[F.col(x) for x in ("theta", "a", "b", "c")])
    ratio = (F.col("answer") - p) / (p * (1 - p))
    weight = 1 / (p * (1 - p))
    return with_parameters(answered(responses), users, items).groupBy("item_id").agg(
        F.sum(ratio * da).alias("grad_a"), F.sum(ratio * db).alias("grad_b"),
        (-F.sum(weight * da * da)).alias("hess_aa"), (-F.sum(weight * da * db)).alias("hess_ab"),
        (-F.sum(weight * db * db)).alias("hess_bb"))


def solve(gradient: list[Column], information: list[list[Column]], limits: list[float] | None = None) -> list[Column]:
    """Newton step of a 1x1, 2x2 or 3x3 system in closed form; 0 where it is singular."""
    limits = limits or [MAX_STEP] * len(gradient)

    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return lg.total([(1 if j % 2 == 0 else -1) * m[0][j] * det([r[:j] + r[j + 1:] for r in m[1:]])
                         for j in range(3)])

    bottom = det(information)
    steps = []
    for j in range(len(gradient)):
        swapped = [[gradient[i] if k == j else v for k, v in enumerate(row)] for i, row in enumerate(information)]
        steps.append(lg.clip(F.coalesce(F.try_divide(det(swapped), bottom), F.lit(0.0)), (-limits[j], limits[j])))
    return steps


GUESS_STEP = 0.05

BOUNDS = {"a": lg.A_BOUNDS, "b": lg.B_BOUNDS, "c": lg.C_BOUNDS}


def item_mle(responses: DataFrame, users: DataFrame, items: DataFrame, model: str = "2PL",
             rounds: int = 20, tol: float = 1e-6, estimate_c: bool = False, fixed_rounds: bool = False) -> DataFrame:
    """Item parameters by maximum likelihood with given abilities; ``items`` are the start values.

    Fisher steps; stops when no parameter moves by more than ``tol`` or after ``rounds``.
    """
    free = [c for c in lg.MODELS[model].free if c != "c" or estimate_c]
    answers = cut_lineage(skew_join(answered(responses).select("user_id", "item_id", "answer"),
                                    users.select("user_id", "theta"), ["user_id"], "inner")
                          .select("item_id", "theta", "answer"), "answers")
    state = RoundTable(responses.sparkSession, "items")
    current = state.put(items.select("item_id", "a", "b", "c").withColumn("moved", F.lit(0.0)))
    for _ in range(rounds):
        current = state.put(_item_step(answers, current, free))
        if not fixed_rounds and current.agg(F.max("moved")).first()[0] <= tol:
            break
    return current.select("item_id", "a", "b", "c")


def _item_step(answers: DataFrame, items: DataFrame, free: list[str]) -> DataFrame:
    p, slopes = item_slopes(*[F.col(x) for x in ("theta", "a", "b", "c")])
    use = [slopes["abc".index(c)] for c in free]
    ratio, weight = (F.col("answer") - p) / (p * (1 - p)), 1 / (p * (1 - p))
    n = len(free)
    sums = [F.sum(ratio * d).alias(f"_g{i}") for i, d in enumerate(use)]
    sums += [F.sum(weight * use[i] * use[j]).alias(f"_h{i}{j}") for i in range(n) for j in range(i, n)]
    joined = skew_join(answers, items.select("item_id", "a", "b", "c"), ["item_id"], "inner")
    return _apply_step(items, joined.groupBy("item_id").agg(*sums), free)


def _apply_step(items: DataFrame, sums: DataFrame, free: list[str]) -> DataFrame:
    n = len(free)
    g = [F.col(f"_g{i}") for i in range(n)]
    h = [[F.col(f"_h{min(i, j)}{max(i, j)}") for j in range(n)] for i in range(n)]
    steps = solve(g, h, [GUESS_STEP if c == "c" else MAX_STEP for c in free])
    if "c" in free:
        # A guess that rests on a bound and pushes against it leaves the system.
        low, high = BOUNDS["c"]
        resting = ((F.col("c") <= low) & (g[-1] <= 0)) | ((F.col("c") >= high) & (g[-1] >= 0))
        others = [*solve(g[:-1], [row[:-1] for row in h[:-1]]), F.lit(0.0)]
        steps = [F.when(resting, o).otherwise(s) for o, s in zip(others, steps)]
    new = {c: lg.clip(F.col(c) + F.coalesce(s, F.lit(0.0)), BOUNDS[c]) for c, s in zip(free, steps)}
    moved = F.greatest(F.lit(0.0), F.lit(0.0), *[F.abs(new[c] - F.col(c)) for c in free])
    return items.select("item_id", "a", "b", "c").join(sums, ["item_id"], "left").select(
        "item_id", *[new.get(c, F.col(c)).alias(c) for c in ("a", "b", "c")], moved.alias("moved"))


def expected_counts(responses: DataFrame, posterior: DataFrame, size: int = 40) -> DataFrame:
    """Expected right and wrong answers of every item at every node, as arrays.

    ``posterior`` may carry a ``weight`` per learner (respondents sharing one answer pattern).
    """
    weight = F.col("weight") if "weight" in posterior.columns else F.lit(1.0)
    joined = skew_join(responses.select("user_id", "item_id", "answer"),
                       posterior.select("user_id", "posterior", weight.alias("_w")), ["user_id"], "inner")

    shares = joined.select("item_id", "posterior", *[
        F.when(F.col("answer") == y, F.col("_w")).otherwise(0.0).alias(f"_w{y}") for y in (0, 1)])
    return shares.groupBy("item_id").agg(lg.array_of("sum(posterior[{k}] * _w1)", size).alias("right"),
                                         lg.array_of("sum(posterior[{k}] * _w0)", size).alias("wrong"))


def mstep_items(items: DataFrame, counts: DataFrame, nodes: list[float], model: str = "2PL",
                rounds: int = 10) -> DataFrame:
    """New a and b of every item from its expected counts; c stays at its start value.

    One row per item; the Newton rounds are a fold over the node arrays.
    """
    free = [c for c in lg.MODELS[model].free if c != "c"]
    joined = items.select("item_id", "a", "b", "c").join(counts, ["item_id"]) \
        .withColumn("_k", F.arrays_zip("right", "wrong", lg.doubles(nodes).alias("node")))
    n = len(free)
    names = [f"g{i}" for i in range(n)] + [f"h{i}{j}" for i in range(n) for j in range(i, n)]

    def one_round(state, _):
        def add(acc, k):
            p, slopes = item_slopes(k["node"], state["a"], state["b"], F.col("c"))
            use = [slopes["abc".index(c)] for c in free]
            both = k["right"] + k["wrong"]
            base = 1 / (p * (1 - p))
            terms = [(k["right"] - both * p) * base * d for d in use]
            terms += [both * base * use[i] * use[j] for i in range(n) for j in range(i, n)]
            return F.struct(*[(acc[name] + t).alias(name) for name, t in zip(names, terms)])

        sums = F.aggregate("_k", F.struct(*[F.lit(0.0).alias(x) for x in names]), add)

        def step(s):
            steps = solve([s[f"g{i}"] for i in range(n)],
                          [[s[f"h{min(i, j)}{max(i, j)}"] for j in range(n)] for i in range(n)])
            new = {c: lg.clip(state[c] + d, BOUNDS[c]) for c, d in zip(free, steps)}
            return F.struct(*[new.get(c, state[c]).alias(c) for c in ("a", "b")])

        return F.transform(F.array(sums), step)[0]

    final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct("a", "b"), one_round)
    return joined.select("item_id", "c", final.alias("_f")).select(
        "item_id", F.col("_f.a").alias("a"), F.col("_f.b").alias("b"), "c")


def plug_in_log_likelihood(responses: DataFrame, abilities: DataFrame, items: DataFrame) -> float:
    """Log-likelihood at point abilities (user_id, theta, weight)."""
    joined = skew_join(skew_join(responses, items, ["item_id"], "inner"), abilities, ["user_id"], "inner")
    value = F.col("weight") * lg.bernoulli_log("answer", lg.prob())
    return joined.agg(F.sum(value)).first()[0]


def fit_mml(responses: DataFrame, items: DataFrame | None = None, model: str = "2PL", size: int = 40,
            low: float = -6.0, high: float = 6.0, weights: str = "normal", max_rounds: int = 500,
            tol: float = 1e-6, inner_rounds: int = 10, fixed_rounds: int | None = None):
    """Marginal-likelihood EM in intercept form: items, abilities, and {rounds, loglik, converged, history}.

    ``responses`` may carry a ``weight`` per learner (pattern frequencies).  Equal answer patterns are merged,
    EM steps are extrapolated, and the fit stops when an EM step raises the marginal log-likelihood by at
    most ``tol``.  With more items than ``patterns.MOST_ITEMS``, or for a fixed number of plain rounds, the
    steps go by joins (``_fit_by_joins``).
    """
    found = None if fixed_rounds else pack(responses.select(*[c for c in ("user_id", "item_id", "answer", "weight") if c in responses.columns]))
    if found is None:
        return _fit_by_joins(responses, items, model, size, low, high, weights, max_rounds, tol, inner_rounds, fixed_rounds)
    nodes, mass = (np.array(x) for x in normal_grid(size, low, high, weights))
    n, free = len(found.items), lg.MODELS[model].free
    start = {k: np.full(n, v) for k, v in (("a", 1.0), ("b", 0.0), ("c", 0.0))}
    if items is not None:
        given = {r.item_id: r for r in items.select("item_id", "a", "b", "c").collect()}
        start = {k: np.array([float(given[i][k]) for i in found.items]) for k in "abc"}
    c = start["c"]

    def em(x):
        loglik, counts = marginal.expectation(found.distinct, marginal.item_logs(x[0], x[1], c, nodes), mass)
        return loglik, np.stack(marginal.item_step(x[0], x[1], c, counts, nodes, free, inner_rounds))

    inside = lambda x: np.stack([np.clip(v, *bounds) for v, bounds in zip(x, (lg.A_BOUNDS, lg.B_BOUNDS))])
    (a, b), loglik, rounds, done, history = marginal.accelerated(
        np.stack([start["a"], start["b"]]), em, inside, max_rounds, lambda f0, f1, x0, x1: f1 - f0 <= tol)
    logs = marginal.item_logs(a, b, c, nodes)
    users = per_row(found.learners, ["user_id"], [T.StructField("theta", T.DoubleType())],
                    lambda rows, _: {"theta": marginal.posterior(rows, logs, mass)[0] @ nodes})
    fitted = table(responses.sparkSession, found.items, responses.schema["item_id"], {"a": a, "b": b, "c": c})
    return fitted, users, {"rounds": rounds, "loglik": loglik, "converged": done, "history": history}


def _fit_by_joins(responses, items, model, size, low, high, weights, max_rounds, tol, inner_rounds, fixed_rounds):
    """EM steps as joins and sums over the long table, for any number of items."""
    spark = responses.sparkSession
    weighted = "weight" in responses.columns
    answers = cut_lineage(answered(responses).select("user_id", "item_id", "answer", *(["weight"] if weighted else [])), "answers")
    weights_of = answers.groupBy("user_id").agg(F.max("weight").cast("double").alias("weight")) if weighted else None
    answers = kept_by(answers.select("user_id", "item_id", "answer"), "user_id")
    if items is None:
        items = answers.select("item_id").distinct().select(
            "item_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    nodes, _ = normal_grid(size, low, high, weights)
    item_state, post_state = RoundTable(spark, "items"), RoundTable(spark, "posterior")
    current = item_state.put(items.select("item_id", "a", "b", "c"))
    history, abilities, rounds, done = [], None, 0, False
    for rounds in range(1, (fixed_rounds or max_rounds) + 1):
        posterior = estep_posterior(answers, current, size, low, high, weights)
        posterior = posterior.join(weights_of, ["user_id"]) if weighted else posterior.withColumn("weight", F.lit(1.0))
        posterior = post_state.put(posterior.withColumn("theta", posterior_mean(nodes)))
        history.append(posterior.agg(F.sum(F.col("weight") * F.col("loglik"))).first()[0])
        abilities = posterior.select("user_id", "theta", "weight")
        if not fixed_rounds and len(history) > 1 and history[-1] - history[-2] <= tol:
            done = True
            break
        counts = expected_counts(answers, posterior, size)
        current = item_state.put(mstep_items(current, counts, nodes, model, inner_rounds)
                                 .select("item_id", "a", "b", "c"))
    answers.unpersist()
    return current, abilities.select("user_id", "theta"), {"rounds": rounds, "loglik": history[-1], "converged": done, "history": history}
