"""Evaluation of predictions: tables with ``answer`` (0/1) and ``prob``."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.functions import logistic as lg
from marksheet.plans.skew import null_safe_sum, running_totals, skew_join

THRESHOLDS = [i / 10 for i in range(11)]


def _known(answer="answer", prob="prob") -> Column:
    return F.col(answer).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(F.col(prob).cast("double"))


def predicted_label(prob="prob", threshold: float = 0.5, strict: bool = False) -> Column:
    above = F.col(prob) > threshold if strict else F.col(prob) >= threshold
    return F.when(above, 1).otherwise(0)


def label_predictions(rows: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Probability to label, and whether the label is right."""
    return (rows.withColumn("pred_label", predicted_label("prob", threshold, strict))
            .withColumn("pred_result", F.col("pred_label") == F.col("answer")))


def _points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Right, wrong and unusable answers per distinct probability: all measures follow from these."""
    known = _known()
    answer = F.col("answer").cast("long")
    return rows.groupBy(*keys, F.col("prob").cast("double").alias("prob")).agg(
        F.sum(F.when(known, answer).otherwise(0)).alias("pos"),
        F.sum(F.when(known, 1 - answer).otherwise(0)).alias("neg"),
        null_safe_sum(~known).alias("missing"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the number of wrong answers at or below them; per range partition, then shifted."""
    return running_totals(_points(rows, keys), ["prob"], {"neg_upto": "neg"}, keys)


def _measures() -> dict[str, Column]:
    pos, neg, prob = F.col("pos"), F.col("neg"), F.coalesce(F.nanvl("prob", F.lit(0.0)), F.lit(0.0))
    n = F.sum(pos + neg)
    mse = F.try_divide(F.sum(pos * (1 - prob) ** 2 + neg * prob ** 2), n)
    base = F.try_divide(F.sum(pos), n)
    accuracy = _accuracy(prob >= 0.5)
    return {
        "n": n, "n_null": F.coalesce(F.sum("missing"), F.lit(0)), "base_rate": base,
        "mae": F.try_divide(F.sum(pos * F.abs(1 - prob) + neg * F.abs(prob)), n), "mse": mse, "rmse": F.sqrt(mse),
        "accuracy": accuracy, "gain": accuracy - base,
        "auc": F.try_divide(F.sum(pos * (F.col("neg_upto") - neg / 2.0)), F.sum(pos).cast("double") * F.sum(neg)),
    }


def _accuracy(above: Column) -> Column:
    """Share of right labels from points, when label 1 is given where ``above``."""
    return F.try_divide(F.sum(F.when(above, F.col("pos")).otherwise(F.col("neg"))).cast("double"),
                        F.sum(F.col("pos") + F.col("neg")))


def auc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve per group, with ties counted half."""
    keys = keys or []
    return _ranked(rows, keys).groupBy(*keys).agg(_measures()["auc"].alias("auc"))


def evaluate_binary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, base rate, MAE, MSE, RMSE, accuracy at 0.5, AUC, accuracy minus base rate, nulls.

    One pass over the rows, which are first combined to counts per distinct probability.
    """
    keys = keys or []
    return _ranked(rows, keys).groupBy(*keys).agg(*[c.alias(n) for n, c in _measures().items()])


def error_metrics(rows: DataFrame) -> DataFrame:
    error = F.col("answer") - F.col("prob")
    return rows.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def confusion_matrix(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts per true and predicted label (label 1 above the threshold)."""
    return rows.filter(_known()).groupBy(
        F.col("answer").alias("y_true"), predicted_label("prob", threshold, True).alias("y_pred")).count() \
        .withColumnRenamed("count", "n")


def classification_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with plain and weighted averages."""
    label = predicted_label("prob", threshold, True)
    counted = rows.filter(_known()).agg(*[
        null_safe_sum(test).alias(name) for name, test in {
            "tp": (F.col("answer") == 1) & (label == 1), "fp": (F.col("answer") == 0) & (label == 1),
            "fn": (F.col("answer") == 1) & (label == 0), "tn": (F.col("answer") == 0) & (label == 0)}.items()])

    def measures(name, hit, wrong, missed):
        return F.struct(F.lit(name).alias("label"),
                        F.coalesce(F.try_divide(F.col(hit), F.col(hit) + F.col(wrong)), F.lit(0.0)).alias("precision"),
                        F.coalesce(F.try_divide(F.col(hit), F.col(hit) + F.col(missed)), F.lit(0.0)).alias("recall"),
                        F.coalesce(F.try_divide(2.0 * F.col(hit), 2 * F.col(hit) + F.col(wrong) + F.col(missed)),
                                   F.lit(0.0)).alias("f1"),
                        (F.col(hit) + F.col(missed)).alias("support"))

    def average(name, weight):
        parts = {m: lg.total([F.col(c)[m] * weight(c) for c in ("_c0", "_c1")])
                 for m in ("precision", "recall", "f1")}
        return F.struct(F.lit(name).alias("label"), *[v.alias(m) for m, v in parts.items()],
                        (F.col("_c0.support") + F.col("_c1.support")).alias("support"))

    classes = counted.select(measures("0", "tn", "fn", "fp").alias("_c0"), measures("1", "tp", "fp", "fn").alias("_c1"))
    whole = F.col("_c0.support") + F.col("_c1.support")
    rows_ = F.array(F.col("_c0"), F.col("_c1"), average("macro avg", lambda c: F.lit(0.5)),
                    average("weighted avg", lambda c: F.coalesce(F.try_divide(F.col(c)["support"], whole), F.lit(0.0))))
    return classes.select(F.explode(rows_).alias("_r")).select("_r.*")


def accuracy_at(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    right = predicted_label("prob", threshold, True) == F.col("answer")
    return rows.filter(_known()).agg(F.avg(right.cast("double")).alias("accuracy"))


def accuracy_sweep(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy at thresholds 0.0, 0.1, ..., 1.0: one pass with one sum per threshold."""
    keys = keys or []
    shares = rows.filter(_known()).groupBy(*keys).agg(*[
        F.avg((predicted_label("prob", t, True) == F.col("answer")).cast("double")).alias(f"_t{i}")
        for i, t in enumerate(THRESHOLDS)])
    return shares.select(*keys, F.explode(_by_threshold()).alias("_p")).select(*keys, "_p.threshold", "_p.accuracy")


def _by_threshold() -> Column:
    return F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("accuracy"))
                     for i, t in enumerate(THRESHOLDS)])


def precision_recall_curve(rows: DataFrame) -> DataFrame:
    """Precision and recall at every distinct probability, from the highest down."""
    points = _points(rows.filter(_known()), []).select(
        F.col("prob").alias("threshold"), (-F.col("prob")).alias("_down"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    ranked = running_totals(points, ["_down"], {"hits": "pos", "taken": "n"})
    one = F.lit(1).alias("_one")
    positives = ranked.agg(F.max("hits").alias("_all")).select("_all", one)
    return ranked.select("*", one).join(F.broadcast(positives), ["_one"]).select(
        "threshold", (F.col("hits") / F.col("taken")).alias("precision"),
        F.try_divide(F.col("hits"), F.col("_all")).alias("recall"))


def recall_accounting(tests: DataFrame, items: DataFrame, histories: DataFrame, models: DataFrame) -> DataFrame:
    """How many test rows can be predicted, and why the others cannot.

    ``tests`` holds skill, item_id, user_id; ``histories`` trace and grp; ``models`` trace, success.
    """
    known = skew_join(tests, items.select("item_id").distinct().withColumn("_item", F.lit(True)), ["item_id"])
    seen = histories.select(F.col("trace").alias("skill"), F.col("grp").alias("user_id"),
                            F.lit(True).alias("_seen")).distinct()
    known = skew_join(known, seen, ["skill", "user_id"])
    known = skew_join(known, models.select(F.col("trace").alias("skill"), "success"), ["skill"])
    reason = (F.when(F.col("skill").isNull(), "no skill").when(F.col("_item").isNull(), "unknown item")
              .when(F.col("_seen").isNull(), "no history")
              .when(~F.coalesce("success", F.lit(False)), "model failed").otherwise("predicted"))
    return known.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _means(train: DataFrame, key: str, name: str) -> DataFrame:
    return train.groupBy(key).agg(F.avg("answer").alias(name))


def _with_means(train: DataFrame, tests: DataFrame) -> DataFrame:
    result = tests
    for key, name in (("skill", "skill_mean"), ("user_id", "user_mean"), ("item_id", "item_mean")):
        result = skew_join(result, _means(train, key, name), [key]) \
            .withColumn(name, F.coalesce(name, F.lit(0.5)))
    return result


def fallback_predict(train: DataFrame, tests: DataFrame) -> DataFrame:
    """Fill missing predictions with the skill mean (0.5 for unknown skills) and name the source."""
    means = _means(train, "skill", "skill_mean")
    joined = skew_join(tests, means, ["skill"])
    source = (F.when(F.col("prob").isNotNull(), "model").when(F.col("skill_mean").isNotNull(), "skill_mean")
              .otherwise("default"))
    return joined.withColumn("source", source) \
        .withColumn("prob", F.coalesce("prob", "skill_mean", F.lit(0.5))).drop("skill_mean")


def fallback_errors(train: DataFrame, tests: DataFrame) -> DataFrame:
    """RMSE of skill, learner and item means on the rows without a model prediction."""
    missing = _with_means(train, tests.filter("prob is null"))
    return missing.agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sqrt(F.avg((F.col("answer") - F.col(m)) ** 2)), F.lit(0.0)).alias(f"rmse_{m[:-5]}")
        for m in ("skill_mean", "user_mean", "item_mean")])


def parameter_recovery(true: DataFrame, estimated: DataFrame, key: str, params: list[str],
                       label: Column | None = None) -> DataFrame:
    """MAE, MSE and RMSE of each parameter; array parameters count every dimension."""
    def as_array(df, c):
        return F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c))

    left = true.select(key, *[as_array(true, c).alias(f"_t_{c}") for c in params])
    right = estimated.select(key, *[as_array(estimated, c).alias(f"_e_{c}") for c in params])
    pairs = F.array(*[F.struct(F.lit(c).alias("param"), F.arrays_zip(
        F.col(f"_t_{c}").alias("t"), F.col(f"_e_{c}").alias("e")).alias("values")) for c in params])
    long = (left.join(right, [key]).select(F.explode(pairs).alias("_p"))
            .select(F.col("_p.param").alias("param"), F.explode("_p.values").alias("_v")))
    error = F.col("_v.t") - F.col("_v.e")
    measured = long.groupBy("param").agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"))
    return measured if label is None else measured.select(label.alias("run"), "*")


def simulation_report(recoveries: DataFrame, params: list[str]) -> DataFrame:
    """One row per run with the errors of every parameter side by side."""
    wide = recoveries.groupBy("run").pivot("param", params).agg(
        F.first("mae").alias("mae"), F.first("mse").alias("mse"), F.first("rmse").alias("rmse"))
    return wide


def compare_models(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model: measures and best threshold, train and test side by side.

    ``rows`` holds the keys, ``split`` ('train' / 'test'), answer and prob.
    """
    groups = [*keys, "split"]
    measures = _measures()
    prob = F.coalesce(F.nanvl("prob", F.lit(0.0)), F.lit(0.0))
    found = _ranked(rows, groups).groupBy(*groups).agg(
        *[measures[m].alias(m) for m in ("mae", "mse", "auc")],
        *[_accuracy(prob > t).alias(f"_t{i}") for i, t in enumerate(THRESHOLDS)])
    # The highest accuracy; the lowest threshold among equals.
    best = F.array_max(F.transform(_by_threshold(), lambda p: F.struct(p["accuracy"], -p["threshold"])))
    each = found.withColumn("_best", best).select(
        *groups, F.col(f"_t{THRESHOLDS.index(0.5)}").alias("acc"), F.abs(F.col("_best.col2")).alias("max_threshold"),
        F.col("_best.accuracy").alias("max_acc"), "mae", "mse", "auc")
    return each.groupBy(*keys).pivot("split", ["train", "test"]).agg(
        *[F.first(c).alias(c) for c in ("acc", "max_threshold", "max_acc", "mae", "mse", "auc")])


def final_report(rows: DataFrame) -> DataFrame:
    """Data set by model: n, base rate, RMSE, AUC, accuracy, gain."""
    return evaluate_binary(rows, ["dataset", "model"]).select(
        "dataset", "model", "n", "base_rate", "rmse", "auc", "accuracy", "gain")


def read_grid(lines: list[str], names: list[str]) -> list[dict[str, str]]:
    """Configurations of a tab-separated grid; blank lines and ``#`` comments are skipped."""
    rows = [line.strip() for line in lines]
    return [dict(zip(names, row.split("\t"))) for row in rows if row and not row.startswith("#")]


def grid_evaluate(spark: SparkSession, configs: list[dict], evaluate: Callable[[dict], DataFrame]) -> DataFrame:
    """Evaluate every configuration as its own Spark job set and stack the results."""
    result = None
    for config in configs:
        rows = evaluate(config).withColumn("config", F.lit(json.dumps(config, sort_keys=True)))
        result = rows if result is None else result.unionByName(rows)
    return result
