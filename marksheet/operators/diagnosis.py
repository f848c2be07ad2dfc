"""Cognitive diagnosis: the deterministic-input, noisy-and-gate model over skill patterns.

A class is a set of mastered skills, as bits.  An item asks for the skills of its q-mask: a learner whose class
holds them all answers right but for a slip, any other only by a guess.  EM runs over answer patterns
(``patterns``): one pass gives the expected learners of every class and the expected answers of every item
and class, and the item step is closed.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.functions import logistic as lg
from marksheet.operators import marginal, newton
from marksheet.operators.ability import normalized
from marksheet.operators.patterns import Rows, pack, sums, table
from marksheet.operators.scoring import answered
from marksheet.plans.lineage import cut_lineage
from marksheet.plans.skew import skew_join

MOST_SKILLS = 12        # classes are 2 ** skills
CELLS = 1 << 22         # items x codes x classes that a pass holds
EDGE = 1e-6             # slip and guess stay so far from 0 and 1
START = 0.2
EARLY = 20              # EM steps before Newton steps
LEAST = 1e-12           # share of a class


def skill_masks(q: DataFrame, skills: list | None = None) -> tuple[DataFrame, list]:
    """item_id and mask (bit k: the item asks for the k-th skill) from rows of item_id and skill; and the skills in order."""
    if skills is None:
        skills = sorted(r.skill for r in q.select("skill").distinct().limit(MOST_SKILLS + 1).collect())
    if len(skills) > MOST_SKILLS:
        raise ValueError(f"more than {MOST_SKILLS} skills")
    bit = F.coalesce(*[F.when(F.col("skill") == s, F.lit(1 << k)) for k, s in enumerate(skills)])
    return q.select("item_id", bit.alias("bit")).distinct().groupBy("item_id").agg(F.sum("bit").cast("int").alias("mask")), skills


def ideal(masks: np.ndarray, skills: int) -> np.ndarray:
    """(item, class): whether the class holds all skills of the item."""
    return (np.arange(1 << skills) & masks[:, None]) == masks[:, None]


def _logs(slip, guess, eta) -> np.ndarray:
    right = np.where(eta, 1 - slip[:, None], guess[:, None])
    return np.log(np.stack([1 - right, right], 1))


def _maximised(counts: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slip and guess of the largest expected likelihood under guess <= 1 - slip."""
    wrong, right = counts[:, 0], counts[:, 1]
    of = lambda x, side: np.where(side, x, 0).sum(1)
    rate = lambda r, w, other: np.where(r + w > 0, r / np.maximum(r + w, 1e-300), other)
    all_right, all_wrong = right.sum(1), wrong.sum(1)
    pooled = rate(all_right, all_wrong, 0.5)
    able, unable = rate(of(right, eta), of(wrong, eta), pooled), rate(of(right, ~eta), of(wrong, ~eta), pooled)
    crossed = unable > able
    able, unable = (np.clip(np.where(crossed, pooled, x), EDGE, 1 - EDGE) for x in (able, unable))
    return 1 - able, unable


def curvature(blocks: DataFrame, eta: np.ndarray, able: np.ndarray, unable: np.ndarray, mass: np.ndarray, learners: float):
    """Marginal log-likelihood less ``learners`` times what the shares add to over one; its gradient and Hessian by the logits of a right
    answer of able and of unable learners, and by the shares.  Its maximum in the shares is where they add to one."""
    n, classes = eta.shape
    P = np.where(eta, able[:, None], unable[:, None])
    logs = np.log(np.stack([1 - P, P], 1))
    place = [np.where(eta[:, c], np.arange(n), n + np.arange(n)) for c in range(classes)]
    N = 2 * n + classes

    def work(rows: Rows):
        value, slope, hessian = 0.0, np.zeros(N), np.zeros((N, N))
        for part in rows.parts(N):
            cells, weight = part.matrix(n, 2, sparse=True), part.weight
            raw = cells @ logs.reshape(2 * n, classes)
            most = raw.max(1, keepdims=True)
            chance = np.exp(raw - most)
            total = chance @ mass
            value += (weight * (most[:, 0] + np.log(total))).sum()
            ratio = chance / total[:, None]
            right, both = np.ascontiguousarray(cells[:, 1::2].T), np.ascontiguousarray((cells[:, ::2] + cells[:, 1::2]).T)
            mean = np.zeros((N, len(weight)))       # slopes of every row's log-likelihood
            for c in range(classes):
                at, by = place[c], right - both * P[:, c, None]
                share = ratio[:, c] * mass[c]
                hessian[np.ix_(at, at)] += (by * (weight * share)) @ by.T
                mean[at] += by * share
                cross = by @ (weight * ratio[:, c])
                hessian[at, 2 * n + c] += cross
                hessian[2 * n + c, at] += cross
                hessian[at, at] -= both @ (weight * share) * P[:, c] * (1 - P[:, c])
            mean[2 * n:] = ratio.T
            slope += mean @ weight
            hessian -= (mean * weight) @ mean.T
        return {"loglik": np.array(value), "gradient": slope, "hessian": hessian}

    found = sums(blocks, {"loglik": (), "gradient": (N,), "hessian": (N, N)}, work)
    gradient = found["gradient"].copy()
    gradient[2 * n:] -= learners
    return float(found["loglik"]) - learners * (mass.sum() - 1), gradient, found["hessian"]


def _climb(blocks: DataFrame, eta: np.ndarray, x: np.ndarray, learners: float, tol: float, passes: int):
    """Newton steps under the bounds of slip, guess and shares till the step that is left gains at most ``tol``; see ``newton.ascend``."""
    n, classes = eta.shape
    edge = np.log((1 - EDGE) / EDGE)
    low = np.concatenate([np.full(2 * n, -edge), np.full(classes, LEAST)])
    high = np.concatenate([np.full(2 * n, edge), np.ones(classes)])
    unit = np.eye(len(low))
    bounds = np.concatenate([unit, -unit, unit[:n] - unit[n:2 * n]])

    def room(z):
        return bounds, np.maximum(np.concatenate([z - low, high - z, z[:n] - z[n:2 * n]]), 0)

    def inside(z):
        z = np.clip(z, low, high)
        middle = (z[:n] + z[n:2 * n]) / 2
        shares = z[2 * n:]
        return np.concatenate([np.maximum(z[:n], middle), np.minimum(z[n:2 * n], middle), shares / shares.sum()])

    chances = lambda z: 1 / (1 + np.exp(-z[:2 * n]))
    start = np.concatenate([np.log((1 - x[:n]) / x[:n]), np.log(x[n:2 * n] / (1 - x[n:2 * n])), x[2 * n:]])
    z, loglik, used, done, history = newton.ascend(
        inside(start), lambda z: curvature(blocks, eta, *np.split(chances(z), 2), z[2 * n:], learners), lambda _, gain: gain <= tol,
        newton.bounded_step, room, inside, passes)
    right = chances(z)
    return np.concatenate([1 - right[:n], right[n:], z[2 * n:]]), loglik, used, done, history


def fit_dina(responses: DataFrame, q: DataFrame, max_rounds: int = 1000, tol: float = 1e-6, fixed_rounds: int | None = None,
             history: list | None = None):
    """Slip and guess of every item and the share of every class: items, classes, {rounds, loglik, converged, skills}.

    ``responses`` holds user_id, item_id, answer (null: skipped) and ``q`` rows of item_id and skill; an item
    without a skill is right for all but a slip.  Starts from slip and guess ``START`` and equal classes.  EM
    steps are extrapolated where that raises the marginal likelihood, and the fit stops when a step gains at
    most ``tol``.  After ``EARLY`` steps come Newton steps, with up to ``newton.UNKNOWNS`` parameters, till the one that is left would gain at
    most ``tol``; where they do not get there, EM goes on.  ``fixed_rounds`` are plain EM steps.  Equal classes of learners are told apart only by items
    that ask for them, so their shares may stay at their start.
    """
    masks, skills = skill_masks(q)
    classes = 1 << len(skills)
    found = pack(cut_lineage(answered(responses).select("user_id", "item_id", "answer"), "answers"), most_items=CELLS // (2 * classes))
    if found is None:
        raise ValueError(f"more than {CELLS // (2 * classes)} items with {len(skills)} skills")
    of = {r.item_id: r["mask"] for r in masks.collect() if r.item_id in set(found.items)}
    mask = np.array([of.get(i, 0) for i in found.items], int)
    eta, n, blocks = ideal(mask, len(skills)), len(found.items), found.blocks()

    def em(x):
        slip, guess, mass = x[:n], x[n:2 * n], x[2 * n:]
        got = marginal.expectations(blocks, _logs(slip, guess, eta), mass)
        return float(got["loglik"]), np.concatenate([*_maximised(got["counts"], eta), got["mass"] / got["mass"].sum()])

    def inside(x):
        able, unable = (np.clip(v, EDGE, 1 - EDGE) for v in (1 - x[:n], x[n:2 * n]))
        middle, mass = (able + unable) / 2, np.maximum(x[2 * n:], 1e-12)
        return np.concatenate([1 - np.maximum(able, middle), np.minimum(unable, middle), mass / mass.sum()])

    x = np.concatenate([np.full(2 * n, START), np.full(classes, 1 / classes)])
    if fixed_rounds:
        for rounds in range(1, fixed_rounds + 1):
            loglik, x = em(x)
        done = False
    else:
        settled = lambda f0, f1, x0, x1: f1 - f0 <= tol
        use_newton = len(x) <= newton.UNKNOWNS
        x, loglik, rounds, done, values = marginal.accelerated(x, em, inside, min(EARLY, max_rounds) if use_newton else max_rounds, settled)
        if use_newton and not done and rounds < max_rounds:
            learners = found.distinct.agg(F.sum("weight")).first()[0]
            x, loglik, used, done, more = _climb(blocks, eta, x, learners, tol, min(newton.PASSES, max_rounds - rounds))
            rounds, values = rounds + used, [*values, *more[1:]]
            if not done and rounds < max_rounds:
                x, loglik, used, done, more = marginal.accelerated(x, em, inside, max_rounds - rounds, settled)
                rounds, values = rounds + used, [*values, *more[1:]]
        if history is not None:
            history += values
    spark = responses.sparkSession
    items = table(spark, found.items, responses.schema["item_id"], {"slip": x[:n], "guess": x[n:2 * n], "mask": mask.astype(float)})
    shares = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x[2 * n:])], "class int, share double")
    return items.withColumn("mask", F.col("mask").cast("int")), shares, {"rounds": rounds, "loglik": loglik, "converged": done, "skills": skills}


def _class_log(answer: Column, classes: int) -> Column:
    able = lambda k: (F.lit(k).bitwiseAND(F.col("mask")) == F.col("mask"))
    def log(k):
        right = F.when(able(k), 1 - F.col("slip")).otherwise(F.col("guess"))
        return F.log(F.when(answer == 1, right).otherwise(1 - right))
    return F.array(*[log(k) for k in range(classes)])


def dina_classify(responses: DataFrame, items: DataFrame, shares: DataFrame, skills: int) -> DataFrame:
    """user_id, map_class (most likely class, of equal ones the smallest), map_share, eap (chance of every skill), loglik.

    ``items`` holds item_id, slip, guess, mask; ``shares`` the share of every class.  Two combinable steps: a
    sum per class for every learner, so no learner is gathered; answers to unknown items are skipped.
    """
    classes = 1 << skills
    mass = np.zeros(classes)
    for r in shares.collect():      # 2 ** skills rows
        mass[r["class"]] = r.share
    joined = skew_join(answered(responses), items.select("item_id", "slip", "guess", "mask"), ["item_id"], "inner")
    summed = joined.select("user_id", _class_log(F.col("answer"), classes).alias("_log")).groupBy("user_id").agg(
        lg.array_of("sum(_log[{k}])", classes).alias("_sums"))
    raw = F.zip_with("_sums", lg.doubles(np.log(np.maximum(mass, 1e-300))), lambda s, m: s + m)
    posterior = normalized(summed.select("user_id", raw.alias("_raw")))
    most = F.array_max("posterior")
    eap = F.array(*[lg.total([F.col("posterior")[c] for c in range(classes) if c >> k & 1]) for k in range(skills)])
    return posterior.select("user_id", (F.array_position("posterior", most) - 1).cast("int").alias("map_class"), most.alias("map_share"),
                            eap.alias("eap"), "loglik")
