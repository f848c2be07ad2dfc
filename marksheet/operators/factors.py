"""Learning factors: opportunity counts, and the additive and the conjunctive factor model.

For an answer that asks for skills k, with T earlier answers of the learner on each, the additive model has
logit = learner + sum of (easiness_k + rate_k * T_k); the conjunctive one multiplies a logistic for each skill.
Newton steps eliminate the learners: every learner's intercept enters the equations of the skills through its
own 1 x 1 block (a Schur complement), so the driver solves 2 x skills unknowns and no learner reaches it.
The conjunctive model mixes the observed information with that of EM over the unseen success on each skill,
which is always positive: more of the observed one while steps succeed, more of the other when one fails.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import logistic as lg
from marksheet.plans.lineage import RoundTable, cut_lineage
from marksheet.plans.skew import HOT_ROWS, hot_keys, kept_by, running_totals, skew_join

MOST_SKILLS = 500       # the driver solves twice as many unknowns
RIDGE = 1e-3            # of the skills' parameters; a learner's intercept has a prior N(0, 1)


def opportunities(log: DataFrame, q: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per answer and skill of its item: the columns of ``log``, skill, and the learner's earlier answers
    on the skill: n_before, right_before, wrong_before.

    ``log`` holds user_id, item_id, answer and the ``order`` columns, unique for each learner; ``q`` rows of
    item_id and skill.  Null answers are practice that is neither right nor wrong.  A learner with more than
    ``hot_rows`` answers on a skill is summed in pieces.
    """
    named = q.select("item_id", F.col("skill").alias("factor")).distinct()
    rows = skew_join(log, named, ["item_id"], "inner").withColumns({
        "_one": F.lit(1).cast("long"), "_right": F.when(F.col("answer") == 1, 1).otherwise(0).cast("long"),
        "_wrong": F.when(F.col("answer") == 0, 1).otherwise(0).cast("long")})
    own = {"n_before": "_one", "right_before": "_right", "wrong_before": "_wrong"}
    keys = ["user_id", "factor"]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = {new: F.coalesce(F.sum(old).over(before), F.lit(0).cast("long")) for new, old in own.items()}
    if hot_keys(rows, keys, hot_rows).isEmpty():
        return rows.withColumns(plain).drop(*own.values())
    hot = hot_keys(rows, keys, hot_rows)
    cold = rows.join(hot, keys, "left_anti").withColumns(plain)
    summed = running_totals(rows.join(hot, keys, "left_semi"), order, own, keys)
    return cold.unionByName(summed.withColumns({new: F.col(new) - F.col(old) for new, old in own.items()})).drop(*own.values())


def _sums(rows: DataFrame, phi: np.ndarray, conjunctive: bool, unseen: float) -> DataFrame:
    """Sums of each learner, and (user_id null, slot 1...) the matrix of the skills, as rows of numbers.

    A learner's are: log-likelihood, gradient, information, gradient by the skills, cross information.
    ``unseen`` is the part of EM in the conjunctive information.
    """
    size = len(phi)
    width = 3 + 2 * size
    schema = T.StructType([rows.schema["user_id"], T.StructField("slot", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        whole = np.zeros((size, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cells")
            lengths = np.diff(cells.offsets.to_numpy())
            answer = np.repeat(np.arange(batch.num_rows), lengths)
            skill, before = (f.to_numpy(zero_copy_only=False) for f in cells.flatten().flatten())
            theta, y = batch.column("theta").to_numpy(), batch.column("answer").to_numpy().astype(float)
            start = np.cumsum(lengths) - lengths
            parts = phi[2 * skill] + phi[2 * skill + 1] * before
            x = np.zeros((batch.num_rows, size))
            if conjunctive:
                p = 1 / (1 + np.exp(-np.clip(theta[answer] + parts, -30, 30)))
                product = np.minimum(np.multiply.reduceat(p, start), 1 - 1e-12)
                loglik = np.where(y == 1, np.log(product), np.log1p(-product))
                both, right = product[answer], y[answer] == 1
                r = np.where(right, 1.0, (p - both) / (1 - both)) - p
                seen = np.where(right, p * (1 - p), -both * p * (1 - p) / (1 - both))
                w = unseen * p * (1 - p) + (1 - unseen) * seen
                rows_x, at = np.zeros((len(skill), size)), np.arange(len(skill))
                rows_x[at, 2 * skill], rows_x[at, 2 * skill + 1] = 1.0, before
                # Skills of one wrong answer share a rank-one part.
                joint = (1 - unseen) * np.where(y == 1, 0.0, product / (1 - product) ** 2)
                turned = np.add.reduceat((1 - p)[:, None] * rows_x, start)
                total = np.add.reduceat(1 - p, start)
                owner = answer
                whole[:, :size] += (turned * joint[:, None]).T @ turned
            else:
                np.add.at(x, (answer, 2 * skill), 1.0)
                np.add.at(x, (answer, 2 * skill + 1), before)
                logit = np.clip(theta + x @ phi, -30, 30)
                p = 1 / (1 + np.exp(-logit))
                loglik = np.where(y == 1, -np.log1p(np.exp(-logit)), -np.log1p(np.exp(logit)))
                r, w, rows_x, owner = y - p, p * (1 - p), x, np.arange(batch.num_rows)
                joint, turned, total = np.zeros(batch.num_rows), x, y
            whole[:, :size] += (rows_x * w[:, None]).T @ rows_x
            ids, of = np.unique(batch.column("user").to_numpy(), return_inverse=True)
            first = np.unique(of, return_index=True)[1]
            v = np.zeros((len(ids), width))
            np.add.at(v[:, 0], of, loglik)
            np.add.at(v[:, 1], of[owner], r)
            np.add.at(v[:, 2], of[owner], w)
            np.add.at(v[:, 2], of, joint * total ** 2)
            np.add.at(v[:, 3:3 + size], of[owner], rows_x * r[:, None])
            np.add.at(v[:, 3 + size:], of[owner], rows_x * w[:, None])
            np.add.at(v[:, 3 + size:], of, (joint * total)[:, None] * turned)
            yield _numbers(batch.column("user_id").take(pa.array(first)), np.zeros(len(ids), np.int32), v)
        kind = schema["user_id"].dataType
        from pyspark.sql.pandas.types import to_arrow_type
        yield _numbers(pa.nulls(size, to_arrow_type(kind)), np.arange(1, size + 1, dtype=np.int32), whole)

    found = rows.select("user_id", F.xxhash64("user_id").alias("user"), "theta", "answer", "cells").mapInArrow(run, schema)
    return found.groupBy("user_id", "slot").agg(lg.array_of("sum(v[{k}])", width).alias("v"))


def _numbers(ids, slots, values: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.RecordBatch.from_arrays([ids, pa.array(slots), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["user_id", "slot", "v"])


def fit_factors(rows: DataFrame, conjunctive: bool = False, max_rounds: int = 500, tol: float = 1e-6, history: list | None = None):
    """Skills (skill, easiness, rate), learners (user_id, theta) and {rounds, loglik, gradient, converged}.

    ``rows`` are answers as ``opportunities`` gives them, with a ``row_id`` for each answer; null answers are
    left out.  The penalised log-likelihood (learners N(0, 1), ridge ``RIDGE`` on the skills) never falls:
    a step that would lower it is halved.  The fit stops when no entry of the gradient is above ``tol`` times the
    number of answers.
    """
    spark = rows.sparkSession
    seen = rows.filter("answer is not null")
    skills = sorted(r.factor for r in seen.select("factor").distinct().limit(MOST_SKILLS + 1).collect())
    if len(skills) > MOST_SKILLS:
        raise ValueError(f"more than {MOST_SKILLS} skills")
    kind = T.StructType([T.StructField("_k", T.IntegerType()), T.StructField("factor", rows.schema["factor"].dataType)])
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(skills)), kind))
    cells = F.array_sort(F.collect_list(F.struct(F.col("_k").alias("skill"), F.col("n_before").cast("double").alias("before")))).alias("cells")
    packed = cut_lineage(seen.join(numbers, "factor").groupBy("row_id", "user_id", "answer").agg(cells), "factors")
    packed = kept_by(packed, "user_id")
    size, n = 2 * len(skills), packed.count()
    learners = RoundTable(spark, "learners")
    # theta = at + length * step: a shorter step needs no new sums of the old point.
    state = learners.put(packed.select("user_id").distinct().withColumns({"at": F.lit(0.0), "step": F.lit(0.0)}))
    phi, length, best = np.zeros(size), 0.0, -np.inf
    move, values, done, rounds, largest, unseen = np.zeros(size), [], False, 0, np.inf, 0.5 if conjunctive else 0.0
    for rounds in range(1, max_rounds + 1):
        trial = phi + length * move
        here = state.select("user_id", (F.col("at") + length * F.col("step")).alias("theta"))
        sums = cut_lineage(_sums(skew_join(packed, here, ["user_id"], "inner"), trial, conjunctive, unseen), "sums")
        users = skew_join(sums.filter("slot = 0"), here, ["user_id"], "inner")
        information = np.array([r.v[:size] for r in sums.filter("slot > 0").orderBy("slot").collect()]) + RIDGE * np.eye(size)
        g = F.col("v")[1] - F.col("theta")
        h = F.greatest(F.col("v")[2] + 1.0, F.lit(0.2))     # the prior's own part is 1
        parts = _reduced(users.select("v", "theta", g.alias("g"), h.alias("h")), size)
        value = parts["value"] - RIDGE * float(trial @ trial) / 2
        if value < best - 1e-9 * abs(best) and length > 1e-6:
            length /= 2
            unseen = min(1.0, 2 * unseen)
            continue
        best, phi, length, unseen = value, trial, 1.0, unseen / 2
        values.append(value)
        gradient = parts["by_skill"] - RIDGE * phi
        largest = max(float(np.abs(gradient).max(initial=0)), parts["by_learner"])
        if largest <= tol * n:
            done = True
            state = learners.put(users.select("user_id", F.col("theta").alias("at"), F.lit(0.0).alias("step")))
            length = 0.0
            break
        curve, axes = np.linalg.eigh(information - parts["eliminated"])
        move = axes @ ((axes.T @ (gradient - parts["carried"])) / np.maximum(np.abs(curve), 1e-6))
        cross = lg.total([F.lit(0.0), *[F.col("v")[3 + size + k] * float(m) for k, m in enumerate(move)]])
        state = learners.put(users.select("user_id", F.col("theta").alias("at"), ((g - cross) / h).alias("step")))
    packed.unpersist()
    if history is not None:
        history += values
    found = [(s, float(phi[2 * k]), float(phi[2 * k + 1])) for k, s in enumerate(skills)]
    fields = [T.StructField("skill", rows.schema["factor"].dataType), T.StructField("easiness", T.DoubleType()), T.StructField("rate", T.DoubleType())]
    return (spark.createDataFrame(found, T.StructType(fields)), state.select("user_id", (F.col("at") + length * F.col("step")).alias("theta")),
            {"rounds": rounds, "loglik": best, "gradient": largest, "converged": done})


def _reduced(users: DataFrame, size: int) -> dict:
    """What the learners' blocks give to the skills' equations."""
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("most", T.DoubleType())])
    shapes = {"value": 1, "by_skill": size, "carried": size, "eliminated": size * size}

    def run(batches):
        total, most = np.zeros(sum(shapes.values())), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            theta, g, h = (batch.column(c).to_numpy() for c in ("theta", "g", "h"))
            cross = v[:, 3 + size:]
            total += np.concatenate([[(v[:, 0] - theta ** 2 / 2).sum()], v[:, 3:3 + size].sum(0), (cross * (g / h)[:, None]).sum(0),
                                     ((cross / h[:, None]).T @ cross).ravel()])
            most = max(most, np.abs(g).max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), most))],
                                         names=["slot", "total", "most"])

    rows = users.mapInArrow(run, schema).groupBy("slot").agg(F.sum("total").alias("total"), F.max("most").alias("most")).orderBy("slot").collect()
    flat = np.array([r.total for r in rows])
    value, by_skill, carried, eliminated = np.split(flat, np.cumsum(list(shapes.values()))[:-1])
    return {"value": float(value[0]), "by_skill": by_skill, "carried": carried, "eliminated": eliminated.reshape(size, size),
            "by_learner": float(rows[0].most)}
