"""Tree scans: the same contexts as a walk over all pieces, with few values in any task."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.operators import sequences, tracing
from marksheet.operators.tracing import LEVELS
from marksheet.plans import scan
from test_skew import STEADY, close

SCHEMA = "k string, seg long, value array<double>"


def numbered(spark, rows):
    """Running sums as a scan: the context is the sum before a piece, starting from that of ``tops``."""
    pieces = spark.createDataFrame([(k, seg, [float(v)]) for k, seg, v in rows], SCHEMA).repartition(5)
    tops = pieces.select("k").distinct().withColumn("context", F.array(F.lit(100.0)))
    spread = lambda values, context: [context + s for s in np.cumsum(np.vstack([[0.0], values[:-1]]), 0)]
    return lambda bits: scan.tree_scan(pieces, tops, ["k"], 1, lambda v: v.sum(0), spread, bits)


@pytest.mark.parametrize("bits", [3, 6])
def test_sums_before_every_piece(spark, bits):
    draw = np.random.default_rng(2)
    rows = [("long", int(s), int(v)) for s, v in zip(np.unique(draw.integers(0, 1 << 20, 400)), draw.integers(0, 9, 400))]
    rows += [(None, s << 16, s) for s in range(9)] + [("one", 5, 3)]
    found = {(r.k, r.seg): r.context for r in numbered(spark, rows)(bits).collect()}
    expected = {}
    for k in ("long", None, "one"):
        before = 100.0
        for _, seg, value in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            expected[k, seg] = [before]
            before += value
    assert found == expected


def test_single_pieces_and_no_pieces(spark):
    assert [r.context for r in numbered(spark, [("a", 3, 1), ("b", 9, 1)])(6).collect()] == [[100.0]] * 2
    assert numbered(spark, [])(6).collect() == []


def test_levels_split_the_varying_bits_only():
    assert scan.level_shifts(0) == [0]
    assert scan.level_shifts(0b1011 << 40 | 0b11, 3) == [0, 41, 44]
    assert scan.level_shifts((1 << 13) - 1) == [0, 6, 12, 13]


@pytest.fixture(scope="module")
def answers(spark):
    """One learner with 10,000 answers, one with 40, one with 3."""
    rows = spark.range(10_000).select("id", F.lit("s").alias("s"), F.lit("u").alias("u"))
    rows = rows.unionByName(spark.range(40).select("id", F.lit("s").alias("s"), F.lit("v").alias("u")))
    rows = rows.unionByName(spark.range(3).select("id", F.lit("t").alias("s"), F.lit("u").alias("u")))
    noise = F.xxhash64("id", "u") % 7
    return rows.withColumn("answer", F.when(noise > 1, 1).otherwise(0)).withColumn("difficulty", (F.col("id") % 9) / 2.0)


def cut(answers, max_len):
    return sequences.build_sequences(answers, ["s"], ["u"], ["id"], {"obs": "answer", "difficulty": "difficulty"}, max_len)


@pytest.mark.parametrize("config", [STEADY, LEVELS], ids=["table", "levels"])
def test_five_thousand_pieces_give_what_one_row_gives(answers, config):
    whole, pieces = cut(answers, 1 << 14), cut(answers, 2)
    assert pieces.filter("trace = 's' and grp = 'u'").count() >= 5_000
    close(tracing.smooth(pieces, None, config), tracing.smooth(whole, None, config))
    close(tracing.viterbi(pieces, None, config).select("trace", "grp", "step", "state", F.round("score", 4).alias("score")),
          tracing.viterbi(whole, None, config).select("trace", "grp", "step", "state", F.round("score", 4).alias("score")))
    cols = ["trace", "grp", "n_obs", "state", "next", F.round("loglik", 5).alias("loglik")]
    close(tracing.forward(pieces, None, config).select(*cols), tracing.forward(whole, None, config).select(*cols))
