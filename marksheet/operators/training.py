"""Training of knowledge-tracing models.

Few models with many sequences: a driver loop, where each round turns every sequence into one row
of additive statistics and sums them per trace, so a hot skill is spread over all tasks.
Many models with one sequence each: the whole EM runs inside Arrow batches, in one pass.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import hmm
from marksheet.functions.logistic import array_of
from marksheet.operators import tracing
from marksheet.operators.sequences import build_sequences_generic, drop_short_sequences, is_split
from marksheet.operators.tracing import DOUBLES, LEVELS, MATRIX, STANDARD, TracingConfig, doubles, matrix
from marksheet.plans.lineage import RoundTable, cut_lineage
from marksheet.plans.skew import spread


def sequence_stats(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD,
                   offset: float | None = None) -> DataFrame:
    """Additive statistics of every sequence: first-step state, transitions, mass per answer, loglik."""
    offset = config.offset_train if offset is None else offset
    table = tracing.in_context(tracing.with_models(seqs, models, config), config, offset)

    def work(block):
        first, moves, by_answer, loglik = hmm.statistics(
            block.prior, block.A, block.emission, block.obs, block.lengths, block.later, block.continued)
        n = len(first)
        return [block.lengths.astype(np.int64), first, moves.reshape(n, -1), by_answer.reshape(n, -1), loglik]

    stats = tracing.run_batches(table, ["trace", "grp", "seg", "prior"], (config, offset, work), [
        ("n_obs", T.LongType()), ("first", DOUBLES), ("moves", DOUBLES), ("by_answer", DOUBLES),
        ("loglik", T.DoubleType())])
    if not is_split(seqs):
        return stats.withColumn("begins", F.lit(True)).drop("prior")
    starts = stats.filter("seg is not null").groupBy("trace", "grp").agg(
        F.min("seg").alias("seg")).withColumn("_starts", F.lit(True))
    begins = F.col("seg").isNull() | F.coalesce("_starts", F.lit(False))
    return stats.join(starts, ["trace", "grp", "seg"], "left").withColumn("begins", begins) \
        .drop("prior", "_starts")


def summed_stats(stats: DataFrame, states: int) -> DataFrame:
    """Statistics summed per trace; partial sums are combined before the shuffle."""
    starting = stats.withColumn("first", F.when(F.col("begins"), F.col("first")))
    return starting.groupBy("trace").agg(
        F.expr("count_if(begins)").alias("n_seq"), array_of("sum(first[{k}])", states).alias("first"),
        array_of("sum(moves[{k}])", states * states).alias("moves"),
        array_of("sum(by_answer[{k}])", states * 2).alias("by_answer"), F.sum("loglik").alias("loglik"))


def update_models(sums: DataFrame, config: TracingConfig = STANDARD) -> DataFrame:
    """New bounded parameters per trace: trace, n_seq, loglik, pi, A, B, success."""
    S, fit_B, bounds = config.states, not config.leveled, config.bounds()
    schema = T.StructType([sums.schema["trace"], T.StructField("n_seq", T.LongType()),
                           T.StructField("loglik", T.DoubleType()), T.StructField("pi", DOUBLES),
                           T.StructField("A", MATRIX), T.StructField("B", MATRIX),
                           T.StructField("success", T.BooleanType())])

    def update(frames):
        for frame in frames:
            if frame.empty:
                continue
            stack = {c: np.stack(frame[c].to_numpy()) for c in ("first", "moves", "by_answer")}
            pi, A, B, ok = hmm.new_parameters(
                stack["first"], frame["n_seq"].to_numpy(), stack["moves"].reshape(-1, S, S),
                stack["by_answer"].reshape(-1, S, 2), bounds, fit_B)
            out = frame[["trace", "n_seq", "loglik"]].copy()
            out["pi"], out["A"] = list(pi), [a.tolist() for a in A]
            out["B"] = [b.tolist() for b in B] if fit_B else None
            out["success"] = ok
            yield out

    return sums.mapInPandas(update, schema)


def start_models(seqs: DataFrame, config: TracingConfig) -> DataFrame:
    """One untrained model per trace."""
    B = F.lit(None).cast(MATRIX) if config.leveled else matrix(config.B)
    return seqs.select("trace").distinct().select(
        "trace", doubles(config.pi).alias("pi"), matrix(config.A).alias("A"), B.alias("B"),
        F.lit(0).alias("iter"), F.lit(None).cast("double").alias("loglik"),
        F.lit(0).cast("long").alias("n_seq"), F.lit(True).alias("active"), F.lit(True).alias("success"))


MODEL_COLUMNS = ["trace", "pi", "A", "B", "iter", "loglik", "n_seq", "success"]


def fit_by_skill(seqs: DataFrame, config: TracingConfig = STANDARD, rounds: int | None = None) -> DataFrame:
    """EM with one model per trace over all its sequences.

    A trace stops when its log-likelihood gains less than ``tol`` (per sequence or in total).
    ``rounds`` fixes the number of rounds instead.  A trace without a long enough sequence keeps
    the start values and ``success = false``.
    """
    spark = seqs.sparkSession
    seqs = cut_lineage(seqs, "sequences")
    valid = drop_short_sequences(seqs, config.minimum_obs)
    state = RoundTable(spark, "models")
    models = state.put(start_models(seqs, config))
    for _ in range(rounds or config.max_iter):
        active = models.filter("active")
        stats = sequence_stats(valid, active, config)
        new = update_models(summed_stats(stats, config.states), config).select(
            "trace", *[F.col(c).alias(f"_{c}") for c in ("pi", "A", "B", "loglik", "n_seq", "success")])
        gain = F.col("_loglik") - F.col("loglik")
        if config.tol_mode == "per_sequence":
            gain = gain / F.col("_n_seq")
        ended = F.col("_n_seq").isNull() | (F.lit(rounds is None) & F.coalesce(gain < config.tol, F.lit(False)))
        tried = F.col("active")
        stepped = models.join(new, ["trace"], "left")
        models = state.put(stepped.select(
            "trace", *[F.when(tried & F.col("_n_seq").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                       for c in ("pi", "A", "B")],
            (F.col("iter") + F.when(tried & F.col("_n_seq").isNotNull(), 1).otherwise(0)).alias("iter"),
            F.coalesce("_loglik", "loglik").alias("loglik"), F.coalesce("_n_seq", "n_seq").alias("n_seq"),
            (tried & ~ended & F.coalesce("_success", F.lit(True))).alias("active"),
            (F.col("success") & F.when(tried, F.coalesce("_success", F.lit(False))).otherwise(True))
            .alias("success")))
        if models.filter("active").isEmpty():
            break
    return models.select(*MODEL_COLUMNS)


def fit_by_sequence(seqs: DataFrame, config: TracingConfig = STANDARD, rounds: int | None = None) -> DataFrame:
    """EM with one model per (trace, group).

    Whole sequences are trained inside Arrow batches without any shuffle.  Sequences that were cut
    into pieces go through the round-by-round job, which never needs a sequence in one place.
    """
    whole = seqs.filter("seg is null") if is_split(seqs) else seqs
    table = spread(tracing.batch_input(tracing.with_models(whole, None, config), config), "trace", "grp")
    bounds, S, fit_B = config.bounds(), config.states, not config.leveled
    limit, offset = rounds or config.max_iter, config.offset_train

    def work(block):
        n = len(block.lengths)
        pi, A = block.pi.copy(), block.A.copy()
        B = block.numbers("B", 2).reshape(n, S, 2).copy() if fit_B else None
        loglik, iters = np.full(n, -np.inf), np.zeros(n, dtype=np.int32)
        success = block.lengths >= config.minimum_obs
        active = success.copy()
        for _ in range(limit):
            at = np.flatnonzero(active)
            if not len(at):
                break
            obs, lengths = block.obs[at], block.lengths[at]
            emission = hmm.emission_from_table(B[at], obs) if fit_B else block.emission[at]
            none = np.zeros(len(at), bool)
            first, moves, by_answer, value = hmm.statistics(
                pi[at], A[at], emission, obs, lengths, np.ones((len(at), S)), none)
            new_pi, new_A, new_B, ok = hmm.new_parameters(first, np.ones(len(at)), moves, by_answer,
                                                          bounds, fit_B)
            pi[at], A[at] = new_pi, new_A
            if fit_B:
                B[at] = new_B
            iters[at] += 1
            success[at] &= ok
            ended = (value - loglik[at] < config.tol) if rounds is None else none
            loglik[at] = value
            active[at] = ok & ~ended
        flat_B = B.reshape(n, S * 2) if fit_B else np.zeros((n, 0))
        return [pi, A, flat_B, iters, np.where(np.isfinite(loglik), loglik, np.nan), success]

    fitted = tracing.run_batches(table, ["trace", "grp"], (config, offset, work), [
        ("pi", DOUBLES), ("A", MATRIX), ("flat_B", DOUBLES), ("iter", T.IntegerType()),
        ("loglik", T.DoubleType()), ("success", T.BooleanType())])
    B = F.array(*[F.array(F.col("flat_B")[2 * i], F.col("flat_B")[2 * i + 1]) for i in range(S)]) \
        if fit_B else F.lit(None).cast(MATRIX)
    models = fitted.select("trace", "grp", "pi", "A", B.alias("B"), "iter",
                           F.nanvl("loglik", F.lit(None).cast("double")).alias("loglik"),
                           F.when(F.col("iter") > 0, 1).otherwise(0).cast("long").alias("n_seq"), "success")
    if not is_split(seqs):
        return models
    pieces = seqs.filter("seg is not null")
    keyed = pieces.withColumn("trace", F.struct("trace", "grp"))
    split = fit_by_skill(keyed, config, rounds)
    return models.unionByName(split.select(F.col("trace.trace").alias("trace"), F.col("trace.grp").alias("grp"),
                                           *MODEL_COLUMNS[1:]))


def fit_levels(seqs: DataFrame, config: TracingConfig = LEVELS, rounds: int | None = None) -> DataFrame:
    """Level model per (trace, group): answers depend on level and item difficulty; pi and A are trained."""
    return fit_by_sequence(seqs, config, rounds)


def fit_batch(rows: DataFrame, trace_by: list[str], group_by: list[str], sorted_by: list[str],
              values: dict[str, str], config: TracingConfig = STANDARD, longer_than: int = 3,
              rounds: int | None = None) -> DataFrame:
    """Train every trace of a log: in one pass when each trace has one sequence, else round by round."""
    seqs = cut_lineage(build_sequences_generic(rows, trace_by, group_by, sorted_by, values, longer_than),
                       "sequences")
    most = seqs.groupBy("trace").agg(F.count_distinct("grp").alias("n")).agg(F.max("n")).first()[0]
    if most is not None and most > 1:
        return fit_by_skill(seqs, config, rounds)
    return fit_by_sequence(seqs, config, rounds).select(*MODEL_COLUMNS)


def model_summary(models: DataFrame) -> DataFrame:
    """Number of models, of successes, rounds and log-likelihood."""
    return models.agg(F.count(F.lit(1)).alias("n_models"),
                      F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("n_success"),
                      F.max("iter").alias("max_iter"), F.sum("loglik").alias("loglik"))
