"""Published numbers and derived values."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.operators import ability, calibration, sequences, tracing, training
from marksheet.operators.tracing import TracingConfig
from marksheet.sources import logs, views

ORDER = ["ord"]

# Ten right answers of one learner, state 0 mastered, code 0 right.
TEN = TracingConfig(
    pi=[0.5, 0.5], A=[[1, 0], [0.4, 0.6]], B=[[0.8, 0.2], [0.2, 0.8]],
    A_low=[[1, 0], [0, 0]], A_high=[[1, 1], [1, 1]], B_low=[[0, 0], [0, 0]], B_high=[[1, 0.3], [0.3, 1]])
# PI[0], A[1][0] and log-likelihood after each round.
TEN_ROUNDS = [
    (0.894737, 0.85, -2.81336),
    (0.969543, 0.955, -0.0802953),
    (0.990959, 0.9865, -0.0218485),
    (0.997296, 0.99595, -0.00637449),
    (0.99919, 0.998785, -0.00189665),
]


def one_sequence(spark, answers, difficulty=None):
    rows = [("s", 1, i, int(x), float(difficulty[i]) if difficulty else 0.0) for i, x in enumerate(answers)]
    df = spark.createDataFrame(rows, "trace string, grp int, ord int, obs int, difficulty double")
    return sequences.build_sequences(df, ["trace"], ["grp"], ORDER, {"obs": "obs", "difficulty": "difficulty"})


@pytest.mark.parametrize("fit,checked", [(training.fit_by_skill, [1, 3]), (training.fit_by_sequence, [1, 2, 3, 4, 5])])
def test_ten_answers_by_round(spark, fit, checked):
    seqs = one_sequence(spark, [0] * 10)
    for rounds in checked:
        pi, rise, loglik = TEN_ROUNDS[rounds - 1]
        model = fit(seqs, TEN, rounds).first()
        assert model.pi[0] == pytest.approx(pi, abs=1e-6)
        assert model.A[1][0] == pytest.approx(rise, abs=1e-6)
        assert model.A[0] == [1, 0]
        assert np.allclose(model.B, [[1, 0], [0.3, 0.7]])
        assert model.loglik == pytest.approx(loglik, rel=1e-5)
    last = fit(seqs, TEN).first()
    assert last.iter == 5 and last.loglik == pytest.approx(TEN_ROUNDS[4][2], rel=1e-5)


def test_viterbi_three_states(spark):
    config = TracingConfig(
        pi=[0.2, 0.4, 0.4], A=[[0.5, 0.2, 0.3], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]],
        B=[[0.5, 0.5], [0.4, 0.6], [0.7, 0.3]])
    rows = tracing.viterbi(one_sequence(spark, [0, 1, 0]), config=config).orderBy("step").collect()
    assert [row.state for row in rows] == [2, 2, 2]
    assert math.exp(rows[0].score) == pytest.approx(0.0147)


# Answer patterns of a five-item attitude survey and how often each occurs.
SURVEY = """
00000 156  00001 26  00010 14  00011 9  00100 127  00101 26  00110 66  00111 16
01000 174  01001 35  01010 36  01011 13  01100 208  01101 65  01110 195  01111 129
10000 8  10001 2  10010 1  10011 3  10100 4  10101 4  10110 18  10111 9
11000 8  11001 2  11010 5  11011 3  11100 19  11101 10  11110 31  11111 68
"""
# Published slopes, intercepts, and the abilities of the two extreme patterns.
SURVEY_A = [1.19657514, 0.71439153, 1.53009649, 2.54849683, 0.92251695]
SURVEY_B = [-2.35338353, 0.7964392, 0.99177572, -0.66901923, -1.09691322]
SURVEY_THETA = {"00000": -1.1905970587, "11111": 1.5435788954}


def survey(spark):
    words = SURVEY.split()
    rows = [(p, [int(x) for x in p], int(n)) for p, n in zip(words[::2], words[1::2])]
    return spark.createDataFrame(rows, "name string, pattern array<int>, n int")


@pytest.mark.parametrize("block", [100_000, 50])
def test_survey_counts(spark, block):
    long = logs.expand_pattern_counts(survey(spark), "pattern", "n", [0, 1, 2, 3, 4], block)
    assert long.select("pattern", "respondent").distinct().count() == 1490
    right = {r.item_id: r.n for r in long.groupBy("item_id").agg(F.sum("answer").alias("n")).collect()}
    assert [right[i] for i in range(5)] == [195, 1001, 995, 616, 420]


def survey_answers(spark):
    return survey(spark).select(F.col("name").alias("user_id"), F.col("n").alias("weight"),
                                F.posexplode("pattern").alias("item_id", "answer"))


def check_survey(items, users, tolerance):
    found = {r.item_id: r for r in items.collect()}
    for name, expected in (("a", SURVEY_A), ("b", SURVEY_B)):
        errors = [found[i][name] - expected[i] for i in range(5)]
        assert np.mean(np.square(errors)) < tolerance and np.mean(np.abs(errors)) < tolerance
    theta = {r.user_id: r.theta for r in users.collect()}
    for pattern, value in SURVEY_THETA.items():
        assert theta[pattern] == pytest.approx(value, abs=tolerance)


def test_survey_published_values_stay(spark):
    start = spark.createDataFrame([(i, SURVEY_A[i], SURVEY_B[i], 0.0) for i in range(5)],
                                  "item_id int, a double, b double, c double")
    items, users, _ = calibration.fit_mml(survey_answers(spark), start, fixed_rounds=2)
    check_survey(items, users, 1e-4)
    weights = survey_answers(spark).select("user_id", "weight").distinct()
    loglik = calibration.plug_in_log_likelihood(
        survey_answers(spark).drop("weight"), users.join(weights, "user_id"), items)
    assert loglik == pytest.approx(-2979.47, abs=0.01)


def test_survey_from_the_usual_start(spark):
    items, users, info = calibration.fit_mml(survey_answers(spark))
    check_survey(items, users, 1e-4)
    weights = survey_answers(spark).select("user_id", "weight").distinct()
    loglik = calibration.plug_in_log_likelihood(survey_answers(spark).drop("weight"), users.join(weights, "user_id"), items)
    assert loglik == pytest.approx(-2979.4700, abs=1e-2) and info["converged"] and info["rounds"] < 153


# Derived from the stationarity equation: prior mean 2.4, n items of slope 1 and intercept -1, all right.
PRIOR_ABILITY = {1: 2.57194, 2: 2.70708, 3: 2.81875, 4: 2.91409, 5: 2.99739, 6: 3.07143, 8: 3.19884}


@pytest.mark.parametrize("max_answers", [8192, 2])
def test_prior_ability(spark, max_answers):
    rows = [(n, i, 1.0, -1.0, 0.0, 1) for n in PRIOR_ABILITY for i in range(n)]
    answers = spark.createDataFrame(rows, "user_id int, item_id int, a double, b double, c double, answer int")
    found = ability.theta_map(answers, 2.4, 1.0, "intercept", max_answers=max_answers)
    assert {r.user_id: pytest.approx(r.theta, abs=1e-5) for r in found.collect()} == PRIOR_ABILITY


def test_ability_cases(spark):
    """One right, one wrong, all right, all wrong, mixed, missing cells."""
    cases = {"right": [1], "wrong": [0], "all_right": [1, 1, 1], "all_wrong": [0, 0, 0],
             "mixed": [1, 0, 1], "missing": [1, None, 0]}
    rows = [(u, i, 1.0, float(i - 1), 0.0, y) for u, ys in cases.items() for i, y in enumerate(ys) if y is not None]
    answers = spark.createDataFrame(rows, "user_id string, item_id int, a double, b double, c double, answer int")
    theta = {r.user_id: r.theta for r in ability.theta_mle(answers).collect()}
    assert theta["right"] == theta["all_right"] == 6.0
    assert theta["wrong"] == theta["all_wrong"] == -6.0
    assert -6 < theta["missing"] < theta["mixed"] < 6


# Values of an independent calculation: skills of the middle test size, converged.
BY_SKILL = {
    "click": (150, 8, -1452.553, 0.6716, 0.9369),
    "view": (150, 8, -1428.165, 0.7971, 0.9410),
}


def test_tracing_by_skill(spark):
    rows = views.tracing_answers(spark, "/root/testdata/sf0.01").filter("skill in ('click', 'view')")
    seqs = sequences.build_sequences(rows, ["skill"], ["user_id"], ["ts", "event_id"], {"obs": "answer"})
    for m in training.fit_by_skill(seqs).collect():
        n, rounds, loglik, pi, stay = BY_SKILL[m.trace]
        assert (m.n_seq, m.iter, m.success) == (n, rounds, True)
        assert m.loglik == pytest.approx(loglik, abs=1e-3)
        assert (m.pi[0], m.A[0][0]) == (pytest.approx(pi, abs=1e-4), pytest.approx(stay, abs=1e-4))
        assert np.allclose(m.B, [[0.7, 0.3], [0.3, 0.7]])
