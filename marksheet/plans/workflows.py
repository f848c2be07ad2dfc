"""Whole analyses, composed from the operators; no rows pass through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.operators import calibration, classical, evaluation, responses, scoring, tracing, training
from marksheet.operators.sequences import build_sequences
from marksheet.operators.tracing import LEVELS, STANDARD
from marksheet.plans.lineage import cut_lineage
from marksheet.plans.skew import skew_join

ORDER = ["ts", "event_id"]


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last answer of every (skill, learner) with at least five answers against the rest."""
    marked = cut_lineage(responses.leave_last_out(log, ["skill", "user_id"], ORDER, "event_id"), "split")
    return marked.filter("not is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


def with_difficulty(log: DataFrame, items: DataFrame) -> DataFrame:
    """Answers with the calibrated difficulty of their item."""
    return classical.attach_item_info(log, items.select("item_id", "difficulty"))


def kt_standard_eval(train: DataFrame, test: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Standard model on the test side: history, prediction, label (right when above one half)."""
    seqs = build_sequences(train, ["skill"], ["user_id"], ORDER, {"obs": "answer"})
    if models is not None and "grp" in models.columns:
        predicted = _own_models(seqs, models)
    else:
        predicted = tracing.predict_next(seqs, models)
    probs = predicted.select(F.col("trace").alias("skill"), F.col("grp").alias("user_id"), "prob")
    return evaluation.label_predictions(skew_join(test, probs, ["skill", "user_id"]), 0.5, strict=True)


def _own_models(seqs: DataFrame, models: DataFrame) -> DataFrame:
    """Prediction where every (trace, group) has its own model."""
    keyed = seqs.withColumn("trace", F.struct("trace", "grp"))
    own = models.filter("success").withColumn("trace", F.struct("trace", "grp"))
    found = tracing.predict_next(keyed, own)
    return found.withColumn("trace", F.col("trace.trace"))


def level_predictions(train: DataFrame, test: DataFrame, rounds: int | None = None) -> DataFrame:
    """Train the level model per (skill, learner) and score the test answers; null where it cannot."""
    items = cut_lineage(classical.item_calibration(train), "items")
    rated = with_difficulty(train, items)
    seqs = cut_lineage(build_sequences(rated, ["skill"], ["user_id"], ORDER,
                                       {"obs": "answer", "difficulty": "difficulty"}), "sequences")
    models = training.fit_levels(seqs, rounds=rounds)
    keyed = seqs.withColumn("trace", F.struct("trace", "grp"))
    own = models.filter("success").withColumn("trace", F.struct("trace", "grp"))
    states = tracing.forward(keyed, own, LEVELS).select(
        F.col("trace.trace").alias("skill"), F.col("grp").alias("user_id"), "next")
    joined = skew_join(with_difficulty(test, items), states, ["skill", "user_id"])
    return joined.withColumn("prob", tracing.next_right(LEVELS, "difficulty")).drop("next", "difficulty")


def kt_challenge(log: DataFrame, rounds: int | None = None) -> DataFrame:
    """Split, calibrate, train the level model, predict, fall back: row_id, answer, prob, source."""
    train, test = split_log(log)
    predicted = level_predictions(train, test, rounds)
    filled = evaluation.fallback_predict(train, predicted)
    return filled.select(F.col("event_id").alias("row_id"), "answer", "prob", "source")


def kt_compare(logs: dict[str, DataFrame], rounds: int | None = None) -> DataFrame:
    """Per data set, three trainers on the same split, reported side by side."""
    scored = None
    for name, log in logs.items():
        train, test = split_log(log)
        seqs = cut_lineage(build_sequences(train, ["skill"], ["user_id"], ORDER, {"obs": "answer"}), "sequences")
        runs = {
            "levels": level_predictions(train, test, rounds),
            "per_learner": kt_standard_eval(train, test, training.fit_by_sequence(seqs, STANDARD, rounds)),
            "per_skill": kt_standard_eval(train, test, training.fit_by_skill(seqs, STANDARD, rounds)),
        }
        for model, rows in runs.items():
            part = evaluation.fallback_predict(train, rows).select(
                F.lit(name).alias("dataset"), F.lit(model).alias("model"), "answer", "prob")
            scored = part if scored is None else scored.unionByName(part)
    return evaluation.final_report(cut_lineage(scored, "scored"))


def irt_train_eval(answers: DataFrame, order: list[str], max_rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """Quota split, marginal-likelihood fit on the rest, measures on both sides: one row."""
    marked = cut_lineage(responses.quota_split(answers, order), "split")
    train = marked.filter("not is_test").drop("is_test")
    items, users, _ = calibration.fit_mml(train, max_rounds=max_rounds, tol=tol)
    split = F.when(F.col("is_test"), "test").otherwise("train")
    rows = scoring.score_records(marked, users, items, "intercept", 1.0).select(
        F.lit("2PL").alias("model"), split.alias("split"), "answer", "prob")
    return evaluation.compare_models(cut_lineage(rows, "scored"), ["model"])
