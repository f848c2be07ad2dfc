"""Invariants, independent calculations and recovery of known parameters."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.functions import hmm
from marksheet.functions.grids import hermite_grid
from marksheet.operators import ability, bank, calibration, evaluation, graded, joint, sequences, tracing, training
from marksheet.operators.tracing import LEVELS, STANDARD, TracingConfig
from marksheet.sources import views


@pytest.fixture(scope="module")
def simulated(spark):
    """Answers of 1,500 learners to 12 items with known parameters, intercept form."""
    rng = np.random.default_rng(5)
    theta = rng.normal(size=1500)
    a, b = rng.uniform(0.8, 2.0, 12), rng.uniform(-1.5, 1.5, 12)
    p = 1 / (1 + np.exp(-(np.outer(theta, a) + b)))
    y = (rng.random(p.shape) < p).astype(int)
    rows = [(u, i, int(y[u, i])) for u in range(1500) for i in range(12)]
    answers = spark.createDataFrame(rows, "user_id int, item_id int, answer int").repartition(4).cache()
    return answers, theta, a, b


def errors(items, a, b):
    found = {r.item_id: r for r in items.collect()}
    return (np.array([found[i].a for i in range(12)]) - a, np.array([found[i].b for i in range(12)]) - b)


def test_item_mle_recovers(spark, simulated):
    answers, theta, a, b = simulated
    users = spark.createDataFrame([(u, float(t)) for u, t in enumerate(theta)], "user_id int, theta double")
    start = spark.createDataFrame([(i, 1.0, 0.0, 0.0) for i in range(12)], "item_id int, a double, b double, c double")
    found = calibration.item_mle(answers, users, start)
    assert max(np.abs(e).max() for e in errors(found, a, b)) < 0.35
    grad = calibration.item_gradient_information(answers, users, found).agg(
        F.max(F.abs("grad_a")), F.max(F.abs("grad_b"))).first()
    assert max(grad) < 1e-3


def test_three_parameter_item_fit_beats_two_parameters(spark, simulated):
    answers, theta, _, _ = simulated
    users = spark.createDataFrame([(u, float(t)) for u, t in enumerate(theta)], "user_id int, theta double")
    start = spark.createDataFrame([(i, 1.0, 0.0, 0.1) for i in range(12)], "item_id int, a double, b double, c double")
    plain = calibration.item_mle(answers, users, start.withColumn("c", F.lit(0.0)), "2PL", 6)
    three = calibration.item_mle(answers, users, start, "3PL", 10, estimate_c=True)
    likelihood = lambda items: calibration.plug_in_log_likelihood(
        answers, users.withColumn("weight", F.lit(1.0)), items)
    assert three.filter("c < 0 or c > 0.5").count() == 0
    assert likelihood(three) > likelihood(plain) - 1.0


def test_stochastic_fit_agrees_with_marginal_fit(simulated):
    answers, theta, a, b = simulated
    exact, users, _ = calibration.fit_mml(answers, fixed_rounds=6)
    sampled, abilities = joint.fit_mhrm(answers, rounds=6, draws=3)
    left, right = errors(exact, a, b), errors(sampled, a, b)
    assert np.abs(left[1] - right[1]).max() < 0.35
    assert np.abs(left[0] - right[0]).mean() < 0.35
    pairs = users.join(abilities.withColumnRenamed("theta", "other"), ["user_id"])
    assert pairs.agg(F.corr("theta", "other")).first()[0] > 0.85


def test_stochastic_item_fit_runs_to_sensible_items(simulated):
    answers, _, a, b = simulated
    items, _ = joint.fit_mh_mle(answers, rounds=6, draws=20)
    assert np.corrcoef(errors(items, 0 * a, 0 * b)[1], b)[0, 1] > 0.95


def test_modal_fit_recovers(simulated):
    answers, theta, a, b = simulated
    items, users, _ = joint.fit_bayes_modal(answers, "2PL", rounds=6)
    found = {r.item_id: r for r in items.collect()}
    difficulty = np.array([found[i].b for i in range(12)])
    assert np.corrcoef(difficulty, -b / a)[0, 1] > 0.97
    got = {r.user_id: r.theta for r in users.collect()}
    assert np.corrcoef([got[u] for u in range(1500)], theta)[0, 1] > 0.8


def _log_posterior(answers, items, users, model):
    p, _, _ = model.slopes()
    joined = answers.join(items, ["item_id"]).join(users, ["user_id"])
    value = joined.agg(F.sum(F.when(F.col("answer") == 1, F.log(p)).otherwise(F.log1p(-p)))).first()[0]
    for r in users.collect():
        value -= sum(t * t for t in r.theta) / 2
    for r in items.collect():
        value -= sum(x * x for x in r.b) / 2 + sum(math.log(x) + math.log(x) ** 2 / 2 for x in r.a)
        if model.guessing:
            value += (model.beta[0] - 1) * math.log(r.c) + (model.beta[1] - 1) * math.log(1 - r.c)
    return value


@pytest.mark.parametrize("compensatory,guessing", [(True, False), (False, False), (True, True), (False, True)])
def test_multidimensional_modal_fit_climbs(spark, sf_dir, compensatory, guessing):
    answers = views.answers(spark, sf_dir)
    model = joint.ModalModel(2, compensatory, guessing, False, 1.0, (2.0, 5.0))
    values = [_log_posterior(answers, *joint.fit_modal(answers, model, rounds)[:2], model) for rounds in (1, 3)]
    assert values[0] < values[1]


def test_posterior_sums_to_one(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    sums = ability.estep_posterior(answers, views.items(answers)).select(
        F.aggregate("posterior", F.lit(0.0), lambda x, y: x + y).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-6").count() == 0


# ---- knowledge tracing ------------------------------------------------------------------------

def naive_em(config, answers, difficulty, rounds):
    """Expectation maximisation of one sequence with plain loops; returns pi, A and the log-likelihoods."""
    S, n, bounds = config.states, len(answers), config.bounds()
    pi, A, B = np.array(config.pi, float), np.array(config.A, float), None if config.leveled else np.array(config.B, float)
    trace = []
    for _ in range(rounds):
        e = np.zeros((n, S))
        for t in range(n):
            for i in range(S):
                if config.leveled:
                    right = 1 / (1 + math.exp(difficulty[t] - i - config.offset_train))
                else:
                    right = B[i][1]
                e[t, i] = right if answers[t] else (1 - right if config.leveled else B[i][0])
        alpha, beta = np.zeros((n, S)), np.ones((n, S))
        alpha[0] = pi * e[0]
        for t in range(1, n):
            alpha[t] = (alpha[t - 1] @ A) * e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = A @ (e[t + 1] * beta[t + 1])
        like = alpha[-1].sum()
        trace.append(math.log(like))
        gamma = alpha * beta / like
        xi = sum(np.outer(alpha[t], e[t + 1] * beta[t + 1]) * A for t in range(n - 1)) / like
        pi = naive_bounds(gamma[0], bounds["pi_low"], bounds["pi_high"])
        A = np.array([naive_bounds(row / row.sum() if row.sum() > 0 else np.ones(S), lo, hi)
                      for row, lo, hi in zip(xi, bounds["A_low"], bounds["A_high"])])
        if B is not None:
            counts = np.array([[gamma[[t for t in range(n) if answers[t] == k], i].sum() for k in (0, 1)] for i in range(S)])
            B = np.array([naive_bounds(row / row.sum(), lo, hi)
                          for row, lo, hi in zip(counts, bounds["B_low"], bounds["B_high"])])
    return pi, A, trace


def naive_bounds(row, low, high):
    row = [min(max(x, lo), hi) for x, lo, hi in zip(row, low, high)]
    for _ in range(1000):
        off = sum(row) - 1
        if abs(off) < 1e-12:
            break
        free = [i for i in range(len(row)) if (row[i] > low[i] if off > 0 else row[i] < high[i])]
        for i in free:
            row[i] -= off / len(free)
        row = [min(max(x, lo), hi) for x, lo, hi in zip(row, low, high)]
    return np.array(row)


@pytest.mark.parametrize("config", [STANDARD, LEVELS], ids=["standard", "levels"])
def test_batch_fit_matches_plain_loops(spark, sf_dir, config):
    log = views.tracing_answers(spark, sf_dir).withColumn("difficulty", (F.col("event_id") % 9) / 2.0)
    seqs = sequences.build_sequences(log, ["skill"], ["user_id"], ["ts", "event_id"],
                                     {"obs": "answer", "difficulty": "difficulty"})
    fitted = {(r.trace, r.grp): r for r in training.fit_by_sequence(seqs, config, rounds=4).collect()}
    for row in seqs.filter("size(seq) >= 3").collect():
        answers, difficulty = [x.obs for x in row.seq], [x.difficulty for x in row.seq]
        pi, A, trace = naive_em(config, answers, difficulty, 4)
        model = fitted[row.trace, row.grp]
        assert np.allclose(model.pi, pi, atol=1e-7) and np.allclose(model.A, A, atol=1e-7)
        assert model.loglik == pytest.approx(trace[-1], abs=1e-8)


def test_trained_models_respect_bounds_and_climb(spark, sf_dir):
    log = views.tracing_answers(spark, sf_dir)
    seqs = sequences.build_sequences(log, ["skill"], ["user_id"], ["ts", "event_id"], {"obs": "answer"})
    before = None
    for rounds in (1, 3):
        models = training.fit_by_skill(seqs, rounds=rounds).collect()
        for m in models:
            assert np.allclose(np.sum(m.A, axis=1), 1) and np.allclose(np.sum(m.B, axis=1), 1)
            assert m.B[0][0] >= 0.7 - 1e-9 and m.B[1][1] >= 0.7 - 1e-9 and m.A[1] == [0, 1]
        now = {m.trace: m.loglik for m in models}
        assert before is None or all(now[t] >= before[t] - 1e-9 for t in now)
        before = now


def test_skill_fit_equals_sequence_fit_on_single_sequences(spark, sf_dir):
    log = views.tracing_answers(spark, sf_dir).withColumn("own", F.concat_ws("_", "skill", "user_id"))
    seqs = sequences.build_sequences(log, ["own"], ["user_id"], ["ts", "event_id"], {"obs": "answer"})
    by_skill = {r.trace: r for r in training.fit_by_skill(seqs).collect()}
    for m in training.fit_by_sequence(seqs).collect():
        other = by_skill[m.trace]
        assert (m.iter, m.success) == (other.iter, other.success)
        assert np.allclose(m.pi, other.pi) and np.allclose(m.A, other.A) and np.allclose(m.B, other.B)


def test_short_sequences_do_not_train(spark):
    rows = [("a", 1, 0, 1), ("a", 1, 1, 0), ("b", 1, 0, 1), ("b", 1, 1, 0), ("b", 1, 2, 1)]
    df = spark.createDataFrame(rows, "trace string, grp int, ord int, obs int")
    seqs = sequences.build_sequences(df, ["trace"], ["grp"], ["ord"], {"obs": "obs"})
    for fit in (training.fit_by_skill, training.fit_by_sequence):
        found = {m.trace: m for m in fit(seqs).collect()}
        assert not found["a"].success and found["a"].pi == STANDARD.pi and found["a"].iter == 0
        assert found["b"].success and found["b"].iter > 0


def test_total_tolerance_takes_longer(spark, sf_dir):
    log = views.tracing_answers(spark, sf_dir).filter("skill = 'view'")
    seqs = sequences.build_sequences(log, ["skill"], ["user_id"], ["ts", "event_id"], {"obs": "answer"})
    loose = training.fit_by_skill(seqs).first().iter
    strict = training.fit_by_skill(seqs, TracingConfig(**{**STANDARD.__dict__, "tol_mode": "total"})).first().iter
    assert strict > loose


def test_config_is_checked():
    with pytest.raises(ValueError):
        TracingConfig(pi=[0.5, 0.4], A=[[1, 0], [0, 1]], B=[[0.5, 0.5], [0.5, 0.5]])
    with pytest.raises(ValueError):
        TracingConfig(pi=[0.5, 0.5], A=[[1, 0, 0], [0, 1, 0]], B=[[0.5, 0.5], [0.5, 0.5]])


def test_rows_move_into_bounds():
    rng = np.random.default_rng(1)
    rows = rng.dirichlet(np.ones(7), 200)
    values, ok = hmm.into_bounds(rows, np.zeros(7), np.full(7, 0.3))
    assert ok.all() and np.allclose(values.sum(1), 1) and values.max() <= 0.3 + 1e-12 and values.min() >= 0
    assert np.allclose(values, [naive_bounds(r, np.zeros(7), np.full(7, 0.3)) for r in rows], atol=1e-9)
    _, ok = hmm.into_bounds(rows, np.zeros(7), np.full(7, 0.1))
    assert not ok.any()


# ---- graded responses -------------------------------------------------------------------------

def test_graded_step_climbs_and_recovers(spark):
    rng = np.random.default_rng(3)
    theta = rng.normal(size=1200)
    slope, thresholds = np.array([1.0, 1.5, 2.0, 0.8, 1.2]), np.array([[1.5, 0, -1.5]] * 5) + rng.normal(0, 0.3, (5, 1))
    u = rng.random((1200, 5))
    reach = 1 / (1 + np.exp(-(slope[None, :, None] * theta[:, None, None] + thresholds[None])))
    score = (u[:, :, None] < reach).sum(2)
    rows = [(n, i, int(score[n, i])) for n in range(1200) for i in range(5)]
    items, rounds = graded.fit_grm(spark.createDataFrame(rows, "user_id int, item_id int, score int"),
                                   max_rounds=12, tol=1e-3)
    found = {r.item_id: r for r in items.collect()}
    assert rounds <= 12
    assert max(abs(found[i].slope - slope[i]) for i in range(5)) < 0.4
    assert max(np.abs(np.array(found[i].thresholds) - thresholds[i]).max() for i in range(5)) < 0.4


def test_graded_gradient_is_numeric_gradient():
    nodes = np.array(hermite_grid()[0])
    rng = np.random.default_rng(2)
    counts = rng.uniform(1, 5, (1, 4, len(nodes)))
    slope, thresholds = np.array([1.1]), np.array([[1.2, 0.1, -0.9]])

    def value(s, t):
        upto = 1 / (1 + np.exp(-(s[0] * nodes + t[0][:, None])))
        reach = np.concatenate([np.ones((1, len(nodes))), upto, np.zeros((1, len(nodes)))])
        return (counts[0] * np.log(reach[:-1] - reach[1:])).sum()

    new_slope, new_thresholds, moved = graded.newton_step(slope, thresholds, counts, nodes)
    assert value(new_slope, new_thresholds) > value(slope, thresholds)
    for _ in range(60):
        slope, thresholds, moved = graded.newton_step(slope, thresholds, counts, nodes)
    assert moved[0] < 1e-8
    for delta in (1e-4, -1e-4):
        assert value(slope + delta, thresholds) < value(slope, thresholds)
        for j in range(3):
            shifted = thresholds.copy()
            shifted[0, j] += delta
            assert value(slope, shifted) < value(slope, thresholds)


# ---- evaluation -------------------------------------------------------------------------------

def test_measures_skip_nulls(spark):
    rows = [(1, 0.9), (0, 0.2), (1, None), (0, float("nan")), (None, 0.5)]
    found = evaluation.evaluate_binary(spark.createDataFrame(rows, "answer int, prob double")).first()
    assert (found.n, found.n_null) == (2, 3)
    assert (found.accuracy, found.auc, found.base_rate) == (1.0, 1.0, 0.5)
    assert found.mae == pytest.approx(0.15)


def test_measures_of_one_class_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.2)], "answer int, prob double")
    found = evaluation.evaluate_binary(rows).first()
    assert found.auc is None and found.accuracy == 0.5
    empty = evaluation.evaluate_binary(rows.limit(0))
    assert empty.count() <= 1


def test_grid_lines():
    lines = ["# comment", "", "  ", "UIrt2PL\t1000\t1", "MIrt3PL\t500\t3"]
    assert evaluation.read_grid(lines, ["model", "tune", "k"]) == [
        {"model": "UIrt2PL", "tune": "1000", "k": "1"}, {"model": "MIrt3PL", "tune": "500", "k": "3"}]


def test_bank_rejects_bad_input(spark):
    items = spark.createDataFrame([(1, -1.0, 0.0, 0.2, 1.0)], "item_id int, a double, b double, c double, d double")
    with pytest.raises(ValueError, match="a < 0"):
        bank.validate_item_bank(items, raise_error=True)
    answers = spark.createDataFrame([(1, 1, 2)], "user_id int, item_id int, answer int")
    users = spark.createDataFrame([(1, 0.0)], "user_id int, theta double")
    with pytest.raises(Exception, match="0 or 1"):
        bank.bank_log_likelihood(answers, users, items).collect()


def test_test_information_without_information(spark):
    items = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0)],
                                  "item_id int, test_id int, a double, b double, c double, d double")
    row = bank.test_information(items, [0.0]).first()
    assert (row.variance, row.standard_error, row.reliability) == (-math.inf, math.inf, math.inf)


def test_peak_information_is_the_maximum(spark):
    items = spark.createDataFrame([(1, 1.2, 0.3, 0.15, 0.95), (2, 0.8, -1.0, 0.0, 1.0)],
                                  "item_id int, a double, b double, c double, d double")
    peaks = {r.item_id: r.peak_theta for r in bank.item_peak_information(items).collect()}
    grid = [x / 100 for x in range(-300, 301)]
    curve = bank.item_information_curve(items, grid).collect()
    for item, peak in peaks.items():
        best = max((r for r in curve if r.item_id == item), key=lambda r: r.information)
        assert best.theta == pytest.approx(peak, abs=0.011)
