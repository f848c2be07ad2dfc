"""Hot keys: the split paths must give what the plain ones give."""
import pytest
from pyspark.sql import functions as F

from marksheet.operators import ability, responses, sequences, tracing, training
from marksheet.operators.tracing import LEVELS, TracingConfig
from marksheet.plans import skew
from marksheet.sources import views

STEADY = TracingConfig(pi=[0.6, 0.4], A=[[0.85, 0.15], [0.0, 1.0]], B=[[0.75, 0.25], [0.3, 0.7]])


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def close(left, right):
    """Equal rows, doubles to nine digits."""
    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    a, b = ([tuple(plain(v) for v in row) for row in rows_of(df)] for df in (left, right))
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.fixture(scope="module")
def fact(spark):
    # One key holds a third of the rows, and some keys are null.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50)
    return spark.range(3000).select(key.cast("int").alias("k"), F.col("id").alias("v"))


def test_row_number_of_hot_groups(spark, fact):
    close(skew.row_number_by(fact, ["k"], ["v"], "n", hot_rows=100), skew.row_number_by(fact, ["k"], ["v"], "n"))


def test_running_totals(spark, fact):
    from itertools import accumulate
    found = skew.running_totals(fact.repartition(13), ["v"], {"upto": "v"}).orderBy("v").collect()
    assert [r.upto for r in found] == list(accumulate(r.v for r in found))


def test_dense_rank(spark, fact):
    keys = fact.select("k").distinct().filter("k is not null")
    found = skew.dense_rank_of(keys.repartition(7), ["k"], "i").orderBy("k").collect()
    assert [r.i for r in found] == list(range(len(found)))


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return views.tracing_answers(spark, sf_dir).withColumn("difficulty", (F.col("event_id") % 9) / 2.0)


def sequences_of(log, max_len=sequences.MAX_LEN):
    return sequences.build_sequences(log, ["skill"], ["user_id"], ["ts", "event_id"],
                                     {"obs": "answer", "difficulty": "difficulty"}, max_len)


@pytest.fixture(scope="module")
def whole(log):
    return sequences_of(log)


@pytest.fixture(scope="module")
def pieces(log):
    return sequences_of(log, 8)


def test_pieces_hold_all_answers_in_order(whole, pieces):
    assert "seg" not in whole.columns and "seg" in pieces.columns
    assert pieces.agg(F.max(F.size("seq"))).first()[0] <= 8
    assert pieces.filter("seg is not null").count() > 10
    joined = pieces.groupBy("trace", "grp").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "seq"))), lambda p: p["seq"])).alias("seq"))
    close(joined, whole)


@pytest.mark.parametrize("config", [STEADY, LEVELS], ids=["table", "levels"])
def test_forward(whole, pieces, config):
    cols = ["trace", "grp", "n_obs", "state", "next", "loglik"]
    close(tracing.forward(pieces, None, config).select(*cols), tracing.forward(whole, None, config).select(*cols))


@pytest.mark.parametrize("config", [STEADY, LEVELS], ids=["table", "levels"])
def test_smooth(whole, pieces, config):
    close(tracing.smooth(pieces, None, config), tracing.smooth(whole, None, config))
    close(tracing.decode_map(pieces, None, config), tracing.decode_map(whole, None, config))


@pytest.mark.parametrize("config", [STEADY, LEVELS], ids=["table", "levels"])
def test_viterbi(whole, pieces, config):
    close(tracing.viterbi(pieces, None, config), tracing.viterbi(whole, None, config))
    cols = ["trace", "grp", "next_state", "score"]
    close(tracing.predict_viterbi(pieces, None, config).select(*cols),
          tracing.predict_viterbi(whole, None, config).select(*cols))


def test_short_sequences_are_dropped_by_their_whole_length(whole, pieces):
    left = sequences.drop_short_sequences(pieces, 12).select("trace", "grp").distinct()
    close(left, sequences.drop_short_sequences(whole, 12).select("trace", "grp"))


def test_statistics(whole, pieces):
    def sums(seqs):
        return training.summed_stats(training.sequence_stats(seqs, None, STEADY), 2)
    close(sums(pieces), sums(whole))


def test_fits(whole, pieces):
    close(training.fit_by_skill(pieces, rounds=3), training.fit_by_skill(whole, rounds=3))
    close(training.fit_by_sequence(pieces, rounds=3), training.fit_by_sequence(whole, rounds=3))


def test_level_fit(whole, pieces):
    close(training.fit_levels(pieces, rounds=2), training.fit_levels(whole, rounds=2))


def test_abilities(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    rated = answers.join(views.items(answers), ["item_id"])
    close(ability.theta_mle(rated, max_answers=18), ability.theta_mle(rated))


def test_quota_split(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    order = ["item_id", "user_id"]
    close(responses.quota_split(answers, order, hot_rows=20), responses.quota_split(answers, order))
