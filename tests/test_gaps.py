"""Missing answers, impossible answers and malformed raw lines."""
import math

import pytest
from pyspark.sql import functions as F

from marksheet.operators import ability, calibration, scoring, sequences, tracing
from marksheet.operators.tracing import TracingConfig
from marksheet.sources import logs, tables, views


@pytest.fixture(scope="module")
def answers(spark, sf_dir):
    return views.answers(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def gaps(answers):
    """The same answers, and as many rows again without one."""
    return answers.unionByName(answers.withColumn("answer", F.lit(None).cast("int")))


def same(left, right):
    def plain(df):
        rows = [[v for _, v in sorted(r.asDict().items())] for r in df.collect()]
        return sorted(([round(v, 8) if isinstance(v, float) else [round(x, 8) for x in v] if isinstance(v, list) else v for v in r]
                       for r in rows), key=repr)
    assert plain(left) == plain(right)


@pytest.mark.parametrize("work", [
    lambda a, i, u: scoring.log_likelihood(a, u, i),
    lambda a, i, u: scoring.log_likelihood_by_user(a, u, i),
    lambda a, i, u: ability.theta_mle(a.join(i, ["item_id"])),
    lambda a, i, u: ability.theta_map(a.join(i, ["item_id"]), max_answers=18),
    lambda a, i, u: ability.theta_gradient_information(a, u, i),
    lambda a, i, u: ability.theta_eap(a, i),
    lambda a, i, u: ability.estep_posterior(a, i),
    lambda a, i, u: calibration.item_gradient_information(a, u, i),
    lambda a, i, u: calibration.item_mle(a, u, i, rounds=2),
    lambda a, i, u: calibration.fit_mml(a, fixed_rounds=1)[0],
], ids=["loglik", "loglik_by_user", "mle", "map", "theta_gradient", "eap", "estep", "item_gradient", "item_mle", "mml"])
def test_missing_answers_are_skipped(answers, gaps, work):
    items, users = views.items(answers), views.users(answers)
    same(work(gaps, items, users), work(answers, items, users))


def test_impossible_answers_have_one_rule(spark):
    never_wrong = TracingConfig(pi=[0.5, 0.5], A=[[1.0, 0.0], [0.0, 1.0]], B=[[0.0, 1.0], [0.0, 1.0]])
    log = spark.createDataFrame([(1, k, "s", y) for k, y in enumerate([1, 0, 1])], "user_id long, ts long, skill string, answer int")
    seqs = sequences.build_sequences(log, ["skill"], ["user_id"], ["ts"], {"obs": "answer"})
    row = tracing.forward(seqs, None, never_wrong).first()
    assert row.loglik < -600 and not any(math.isnan(x) for x in row.state)
    assert tracing.smooth(seqs, None, never_wrong).count() == 3


def raw(key, answers):
    return "\x01".join([key, "s", "c", "l", "t", "7", "0", "x", "y", answers])


@pytest.mark.parametrize("bad", [raw("b", "{not json"), "a\x01short"])
def test_malformed_lines_stop_the_load(spark, bad):
    good = raw("a", '{"1": {"answerStatus": 1}}')
    read = lambda lines: logs.explode_answer_json(
        spark.createDataFrame([(x, "2020-01") for x in lines], "value string, p_month string"))
    assert read([good]).count() == 1
    with pytest.raises(Exception, match="MALFORMED|INVALID_ARRAY_INDEX|ArrayIndex"):
        read([good, bad]).collect()


def test_a_month_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = lambda *values: spark.createDataFrame(values, "id string, p_month string")
    tables.write_answers_partitioned(rows(("a", "2020-01"), ("b", "2020-02")), path)
    tables.write_answers_partitioned(rows(("c", "2020-02")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "c"]
