"""Evaluation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from marksheet.catalog.registry import VIEWS, query, r, with_views
from marksheet.catalog.scores import tables
from marksheet.catalog.tracing import log
from marksheet.operators import evaluation as ev
from marksheet.operators import responses as rs
from marksheet.operators import sequences as sq
from marksheet.operators import scoring
from marksheet.sources import views

VIEWS["pred"] = ("scored", "SELECT user_id, item_id, answer, round(prob, 6) AS prob FROM scored")


def predictions(spark, sf_dir):
    return scoring.score_records(*tables(spark, sf_dir)).select(
        "user_id", "item_id", "answer", F.round("prob", 6).alias("prob"))


def auc_sql(source: str, keys: str = "") -> str:
    """Rank-sum area with averaged ranks; ``keys`` is a column list or empty."""
    by, part = (f"GROUP BY {keys}", f"PARTITION BY {keys}") if keys else ("", "")
    pre = f"{keys}, " if keys else ""
    return f"""SELECT {pre}(sum(CASE WHEN answer = 1 THEN rk ELSE 0 END) - sum(answer) * (sum(answer) + 1) / 2)
        / (sum(answer) * sum(1 - answer)) AS auc FROM (SELECT {pre}answer,
        rank() OVER ({part} ORDER BY prob) + (count(*) OVER (PARTITION BY {pre}prob) - 1) / CAST(2 AS DOUBLE) AS rk FROM {source}) {by}"""


def hits(threshold, op=">="):
    return f"avg(CASE WHEN (prob {op} {threshold}) = (answer = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END)"


MEASURES = f"""count(*) AS n, {r('avg(answer)', 'base_rate')}, {r('avg(abs(answer - prob))', 'mae')},
    {r('avg((answer - prob) ** 2)', 'mse')}, {r('sqrt(avg((answer - prob) ** 2))', 'rmse')},
    {r(hits(0.5), 'accuracy')}, {r(hits(0.5) + ' - avg(answer)', 'gain')}"""


@query("evaluate_binary", with_views("pred", f"""SELECT {MEASURES}, 0::BIGINT AS n_null, (SELECT {r('auc', 'auc')} FROM u) AS auc FROM pred""",
                                     {"u": auc_sql("pred")}))
def evaluate_binary(spark, sf_dir):
    return ev.evaluate_binary(predictions(spark, sf_dir))


@query("error_metrics", with_views("pred", f"""SELECT {r('avg((answer - prob) ** 2)', 'mse')}, {r('avg(abs(answer - prob))', 'mae')} FROM pred"""))
def error_metrics(spark, sf_dir):
    return ev.error_metrics(predictions(spark, sf_dir))


@query("confusion_matrix", with_views("pred", """SELECT answer AS y_true, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS y_pred,
    count(*) AS n FROM pred GROUP BY 1, 2"""))
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(predictions(spark, sf_dir))


@query("classification_report", with_views("pred", f"""SELECT label, {r('precision', 'precision')}, {r('recall', 'recall')},
    {r('f1', 'f1')}, support FROM (SELECT label, precision, recall, f1, support FROM cls
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM cls
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM cls)""", {
    "lab": "SELECT answer, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS p FROM pred",
    "cls": """SELECT CAST(k AS VARCHAR) AS label,
        sum(CASE WHEN answer = k AND p = k THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN p = k THEN 1 ELSE 0 END) AS DOUBLE) AS precision,
        sum(CASE WHEN answer = k AND p = k THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN answer = k THEN 1 ELSE 0 END) AS DOUBLE) AS recall,
        2 * sum(CASE WHEN answer = k AND p = k THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN p = k THEN 1 ELSE 0 END) + sum(CASE WHEN answer = k THEN 1 ELSE 0 END) AS DOUBLE) AS f1,
        count(*) FILTER (WHERE answer = k) AS support FROM lab, range(0, 2) t(k) GROUP BY k"""}))
def classification_report(spark, sf_dir):
    return ev.classification_report(predictions(spark, sf_dir))


@query("accuracy_at", with_views("pred", f"SELECT {r(hits(0.6, '>'), 'accuracy')} FROM pred"))
def accuracy_at(spark, sf_dir):
    return ev.accuracy_at(predictions(spark, sf_dir), 0.6)


SWEEP = "SELECT i / CAST(10 AS DOUBLE) AS threshold FROM range(0, 11) t(i)"


@query("accuracy_sweep", with_views("pred", f"""SELECT threshold, {r(hits('threshold', '>'), 'accuracy')} FROM pred, th GROUP BY threshold""",
                                    {"th": SWEEP}))
def accuracy_sweep(spark, sf_dir):
    return ev.accuracy_sweep(predictions(spark, sf_dir))


@query("precision_recall_curve", with_views("pred", f"""SELECT prob AS threshold, {r('hits / CAST(taken AS DOUBLE)', 'precision')},
    {r('hits / CAST((SELECT sum(answer) FROM pred) AS DOUBLE)', 'recall')} FROM (
    SELECT prob, sum(sum(answer)) OVER (ORDER BY prob DESC) AS hits, sum(count(*)) OVER (ORDER BY prob DESC) AS taken
    FROM pred GROUP BY prob)"""))
def precision_recall_curve(spark, sf_dir):
    return ev.precision_recall_curve(predictions(spark, sf_dir))


@query("label_predictions", with_views("pred", """SELECT user_id, item_id, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred_label,
    (prob > 0.5) = (answer = 1) AS pred_result FROM pred"""))
def label_predictions(spark, sf_dir):
    return ev.label_predictions(predictions(spark, sf_dir), 0.5, strict=True).select(
        "user_id", "item_id", "prob", "pred_label", "pred_result")


def holey_test(spark, sf_dir):
    """Train and test sides; some test rows lack a skill."""
    marked = rs.leave_last_out(log(spark, sf_dir), ["skill", "user_id"], ["ts", "event_id"], "event_id")
    test = marked.filter("is_test").drop("is_test")
    test = test.withColumn("skill", F.when(F.col("event_id") % 19 != 0, F.col("skill")))
    return marked.filter("not is_test").drop("is_test"), test


HOLEY = "SELECT * REPLACE (CASE WHEN event_id % 19 <> 0 THEN skill END AS skill) FROM test"


@query("recall_accounting", with_views("train test", """SELECT reason, count(*) AS n FROM (SELECT CASE
    WHEN t.skill IS NULL THEN 'no skill' WHEN NOT i THEN 'unknown item' WHEN NOT h THEN 'no history'
    WHEN t.skill = 'error' THEN 'model failed' ELSE 'predicted' END AS reason FROM
    (SELECT *, item_id IN (SELECT item_id FROM train WHERE ts < TIMESTAMP '2024-01-15') AS i,
     (skill, user_id) IN (SELECT (skill, user_id) FROM train WHERE event_id % 3 = 0) AS h FROM holey) t) GROUP BY reason""",
                                       {"holey": HOLEY}))
def recall_accounting(spark, sf_dir):
    train, test = holey_test(spark, sf_dir)
    histories = train.filter("event_id % 3 = 0").select(
        F.col("skill").alias("trace"), F.col("user_id").alias("grp")).distinct()
    models = train.select(F.col("skill").alias("trace")).distinct().withColumn("success", F.col("trace") != "error")
    return ev.recall_accounting(test, train.filter("ts < timestamp_ntz'2024-01-15'"), histories, models)


TESTED = """SELECT *, CASE WHEN event_id % 3 = 0 THEN CAST(0.25 AS DOUBLE) + (event_id % 7) / CAST(10 AS DOUBLE) END AS prob FROM holey"""


def partly_predicted(spark, sf_dir):
    train, test = holey_test(spark, sf_dir)
    n = F.col("event_id")
    return train, test.withColumn("prob", F.when(n % 3 == 0, 0.25 + (n % 7) / 10.0))


@query("fallback_predict", with_views("train test", f"""SELECT event_id, {r("coalesce(prob, m, 0.5)", "prob")},
    CASE WHEN prob IS NOT NULL THEN 'model' WHEN m IS NOT NULL THEN 'skill_mean' ELSE 'default' END AS source
    FROM tested LEFT JOIN (SELECT skill, avg(answer) AS m FROM train GROUP BY skill) USING (skill)""",
                                      {"holey": HOLEY, "tested": TESTED}))
def fallback_predict(spark, sf_dir):
    train, test = partly_predicted(spark, sf_dir)
    return ev.fallback_predict(train, test).select("event_id", "prob", "source")


@query("fallback_errors", with_views("train test", f"""SELECT count(*) AS n, {', '.join(
    r(f"sqrt(avg((answer - coalesce({n}, 0.5)) ** 2))", f"rmse_{a}") for n, a in (("s", "skill"), ("u", "user"), ("i", "item")))}
    FROM tested LEFT JOIN (SELECT skill, avg(answer) AS s FROM train GROUP BY skill) USING (skill)
    LEFT JOIN (SELECT user_id, avg(answer) AS u FROM train GROUP BY user_id) USING (user_id)
    LEFT JOIN (SELECT item_id, avg(answer) AS i FROM train GROUP BY item_id) USING (item_id) WHERE prob IS NULL""",
                                     {"holey": HOLEY, "tested": TESTED}))
def fallback_errors(spark, sf_dir):
    return ev.fallback_errors(*partly_predicted(spark, sf_dir))


def recovered(spark, sf_dir, factor):
    """Item parameters against a shifted copy, with a two-dimensional slope."""
    _, _, items = tables(spark, sf_dir)
    true = items.select("item_id", F.array("a", F.col("a") / 2).alias("a"), "b", "c")
    shifted = items.select("item_id", F.array(F.col("a") * factor, F.col("a")).alias("a"),
                           (F.col("b") + 0.1 * factor).alias("b"), (F.col("c") * factor).alias("c"))
    return ev.parameter_recovery(true, shifted, "item_id", ["a", "b", "c"], F.lit(f"x{factor}"))


def recovery_sql(factor):
    f = f"CAST({factor} AS DOUBLE)"
    errors = [("a", f"a - a * {f}"), ("a", "a / 2 - a"), ("b", f"-CAST(0.1 AS DOUBLE) * {f}"), ("c", f"c - c * {f}")]
    union = " UNION ALL ".join(f"SELECT 'x{factor}' AS run, '{p}' AS param, {e} AS e FROM items" for p, e in errors)
    return f"""SELECT run, param, {r('avg(abs(e))', 'mae')}, {r('avg(e * e)', 'mse')}, {r('sqrt(avg(e * e))', 'rmse')}
        FROM ({union}) GROUP BY run, param"""


@query("parameter_recovery", with_views("items", recovery_sql(1.1)))
def parameter_recovery(spark, sf_dir):
    return recovered(spark, sf_dir, 1.1)


@query("simulation_report", with_views("items", "SELECT run, " + ", ".join(
    f"max(CASE WHEN param = '{p}' THEN {m} END) AS {p}_{m}" for p in "abc" for m in ("mae", "mse", "rmse"))
    + " FROM runs GROUP BY run", {"runs": f"{recovery_sql(1.1)} UNION ALL {recovery_sql(1.5)}"}))
def simulation_report(spark, sf_dir):
    runs = recovered(spark, sf_dir, 1.1).unionByName(recovered(spark, sf_dir, 1.5))
    return ev.simulation_report(runs, ["a", "b", "c"])


def two_models(spark, sf_dir):
    """Predictions with and without guessing, split into train and test learners."""
    answers, users, items = tables(spark, sf_dir)
    split = F.when(F.col("user_id") % 5 == 0, "test").otherwise("train")
    parts = []
    for model, bank in (("3PL", items), ("2PL", items.withColumn("c", F.lit(0.0)))):
        scored = scoring.score_records(answers, users, bank)
        parts.append(scored.select("user_id", F.lit(model).alias("model"), split.alias("split"), "answer",
                                   F.round("prob", 6).alias("prob")))
    return parts[0].unionByName(parts[1])


TWO = """SELECT user_id, model, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, answer,
    round(CASE WHEN model = '3PL' THEN prob ELSE 1 / (1 + exp(-(CAST(1.702 AS DOUBLE) * a * (theta - b)))) END, 6) AS prob
    FROM scored, (VALUES ('3PL'), ('2PL')) v(model)"""


def _side(split):
    parts = [f"max(CASE WHEN split = '{split}' THEN {c} END) AS {split}_{c}"
             for c in ("acc", "max_threshold", "max_acc", "mae", "mse", "auc")]
    return ", ".join(parts)


@query("compare_models", with_views("scored", f"SELECT model, {_side('train')}, {_side('test')} FROM flat GROUP BY model", {
    "two": TWO, "th": SWEEP,
    "sweep": f"SELECT model, split, threshold, {hits('threshold', '>')} AS acc FROM two, th GROUP BY 1, 2, 3",
    "areas": auc_sql("two", "model, split"),
    "best": """SELECT model, split, max(CASE WHEN threshold = 0.5 THEN acc END) AS acc, max(acc) AS max_acc,
        arg_max(threshold, (acc, -threshold)) AS max_threshold FROM sweep GROUP BY 1, 2""",
    "base": "SELECT model, split, avg(abs(answer - prob)) AS mae, avg((answer - prob) ** 2) AS mse FROM two GROUP BY 1, 2",
    "flat": f"""SELECT model, split, {r('acc', 'acc')}, max_threshold, {r('max_acc', 'max_acc')}, {r('mae', 'mae')},
        {r('mse', 'mse')}, {r('auc', 'auc')} FROM best JOIN base USING (model, split) JOIN areas USING (model, split)"""}))
def compare_models(spark, sf_dir):
    return ev.compare_models(two_models(spark, sf_dir), ["model"])


@query("final_report", with_views("scored", f"""SELECT dataset, model, n, base_rate, rmse, {r('auc', 'auc')}, accuracy, gain
    FROM (SELECT dataset, model, {MEASURES} FROM ds GROUP BY 1, 2) JOIN areas USING (dataset, model)""", {
    "two": TWO, "ds": "SELECT *, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM two",
    "areas": auc_sql("ds", "dataset, model")}))
def final_report(spark, sf_dir):
    dataset = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return ev.final_report(two_models(spark, sf_dir).withColumn("dataset", dataset))


GRID = ["# model and scale", "", "3PL\t1.702", "2PL\t1.702", "2PL\t1.0"]


@query("grid_evaluate", with_views("scored", f"""SELECT config, {r('avg((answer - p) ** 2)', 'mse')}, {r('avg(abs(answer - p))', 'mae')} FROM (
    SELECT config, answer, g * c + (1 - g * c) / (1 + exp(-(d * a * (theta - b)))) AS p FROM scored, (VALUES
    ('{{"D": "1.702", "model": "3PL"}}', CAST(1 AS DOUBLE), CAST(1.702 AS DOUBLE)), ('{{"D": "1.702", "model": "2PL"}}', CAST(0 AS DOUBLE), CAST(1.702 AS DOUBLE)),
    ('{{"D": "1.0", "model": "2PL"}}', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))) v(config, g, d)) GROUP BY config"""))
def grid_evaluate(spark, sf_dir):
    answers, users, items = tables(spark, sf_dir)

    def evaluate(config):
        bank = items if config["model"] == "3PL" else items.withColumn("c", F.lit(0.0))
        return ev.error_metrics(scoring.score_records(answers, users, bank, D=float(config["D"])))

    return ev.grid_evaluate(spark, ev.read_grid(GRID, ["model", "D"]), evaluate)
