"""Queries that score with given parameters, and item-bank queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.operators import bank, scoring
from marksheet.sources import views

D = "CAST(1.702 AS DOUBLE)"
GRID = [x / 2 for x in range(-6, 7)]


def tables(spark, sf_dir):
    """Answers, learners and items of the item-response views."""
    answers = views.answers(spark, sf_dir)
    return answers, views.users(answers), views.items(answers)


@query("score_records", with_views("scored", f"SELECT user_id, item_id, answer, {r('prob', 'prob')} FROM scored"))
def score_records(spark, sf_dir):
    return scoring.score_records(*tables(spark, sf_dir)).select("user_id", "item_id", "answer", "prob")


def _sigmoid(z):
    return f"(1 / (1 + exp(-({z}))))"


@query("score_matrix", with_views("users items", f"""SELECT user_id, item_id,
    {r("c + (1 - c) * " + _sigmoid(D + " * a * (theta - b)"), "prob")} FROM users, items"""))
def score_matrix(spark, sf_dir):
    _, users, items = tables(spark, sf_dir)
    return scoring.score_matrix(users, items)


def vectors(spark, sf_dir, compensatory):
    """Three-dimensional parameters built from the one-dimensional ones."""
    answers, users, items = tables(spark, sf_dir)
    users = users.select("user_id", F.array(F.col("theta"), F.col("theta") / 2, -F.col("theta")).alias("theta"))
    b = F.col("b") if compensatory else F.array(F.col("b"), F.col("b") / 2, -F.col("b"))
    items = items.select("item_id", F.array(F.col("a"), F.col("a") / 2, F.col("a") * 0.8).alias("a"),
                         b.alias("b"), "c")
    return answers, users, items


COMP = f"c + (1 - c) * {_sigmoid('theta * a + theta / 2 * a / 2 - theta * a * CAST(0.8 AS DOUBLE) - b')}"
NONCOMP = "c + (1 - c) * " + " * ".join([
    _sigmoid("a * (theta - b)"), _sigmoid("a / 2 * (theta / 2 - b / 2)"),
    _sigmoid("a * CAST(0.8 AS DOUBLE) * (b - theta)")])
for _key, _formula in (("mirt_score", COMP), ("mirt_nc_score", NONCOMP)):
    _comp = _formula is COMP

    @query(f"{_key}_records", with_views("scored", f"SELECT user_id, item_id, {r(_formula, 'prob')} FROM scored"))
    def _records(spark, sf_dir, comp=_comp):
        return scoring.mirt_score_records(*vectors(spark, sf_dir, comp), comp).select("user_id", "item_id", "prob")

    @query(f"{_key}_matrix", with_views("users items",
                                        f"SELECT user_id, item_id, {r(_formula, 'prob')} FROM users, items"))
    def _matrix(spark, sf_dir, comp=_comp):
        _, users, items = vectors(spark, sf_dir, comp)
        return scoring.mirt_score_matrix(users, items, comp)

ANSWER_LOG = "CASE WHEN answer = 1 THEN ln(prob) ELSE ln(1 - prob) END"


@query("log_likelihood", with_views("scored", f"SELECT count(*) AS n, {r(f'sum({ANSWER_LOG})', 'loglik')} FROM scored"))
def log_likelihood(spark, sf_dir):
    return scoring.log_likelihood(*tables(spark, sf_dir))


@query("log_likelihood_by_user", with_views("scored", f"""SELECT user_id, count(*) AS n,
    {r(f'sum({ANSWER_LOG})', 'loglik')} FROM scored GROUP BY user_id"""))
def log_likelihood_by_user(spark, sf_dir):
    return scoring.log_likelihood_by_user(*tables(spark, sf_dir))


@query("model_fit_stats", with_views("scored", f"""SELECT {r('sqrt(avg((answer - prob) ** 2))', 'rmse')},
    {r('avg(CASE WHEN round_even(prob, 0) = answer THEN CAST(1 AS DOUBLE) ELSE 0 END)', 'accuracy')} FROM scored"""))
def model_fit_stats(spark, sf_dir):
    return scoring.model_fit_stats(*tables(spark, sf_dir))


def item_bank(spark, sf_dir):
    """The items with an upper asymptote and a test number."""
    _, _, items = tables(spark, sf_dir)
    number = F.substring("item_id", 7, 10).cast("int")
    return items.withColumn("d", 1 - F.col("c") / 2).withColumn("test_id", number % 3)


BANK = {"bank": "SELECT *, 1 - c / 2 AS d, CAST(substr(item_id, 7) AS INT) % 3 AS test_id FROM items",
        "grid": "SELECT unnest(range(-6, 7)) / CAST(2 AS DOUBLE) AS theta",
        "curve": f"""SELECT *, c + (d - c) * {_sigmoid("a * (theta - b)")} AS p1,
            c + (d - c) * {_sigmoid(D + " * a * (theta - b)")} AS pd FROM bank, grid"""}
INFO = "a ** 2 * (p - c) ** 2 * (d - p) ** 2 / ((d - c) ** 2 * p * (1 - p))"


@query("item_characteristic_curve", with_views("items", f"SELECT item_id, theta, {r('p1', 'prob')} FROM curve", BANK))
def item_characteristic_curve(spark, sf_dir):
    return bank.item_characteristic_curve(item_bank(spark, sf_dir), GRID)


@query("item_information_curve", with_views("items", f"""SELECT item_id, theta,
    {r(INFO, 'information')} FROM (SELECT *, pd AS p FROM curve)""", BANK))
def item_information_curve(spark, sf_dir):
    return bank.item_information_curve(item_bank(spark, sf_dir), GRID, 1.702)


@query("test_information", with_views("items", f"""SELECT test_id, theta, {r('i', 'information')}, {r('1 / i', 'variance')},
    {r('sqrt(1 / i)', 'standard_error')}, {r('1 - 1 / i', 'reliability')}
    FROM (SELECT test_id, theta, sum({INFO}) AS i FROM (SELECT *, pd AS p FROM curve) GROUP BY 1, 2)""", BANK))
def test_information(spark, sf_dir):
    return bank.test_information(item_bank(spark, sf_dir), GRID)


@query("item_peak_information", with_views("items", f"""SELECT item_id, {r('b + ln((x - c) / (d - x)) / a', 'peak_theta')} FROM (
    SELECT *, 2 * sqrt(-u / 3) * cos(acos(-(v / 2) * sqrt(27 / -(u ** 3))) / 3 + 4 * pi() / 3) + CAST(0.5 AS DOUBLE) AS x
    FROM (SELECT *, (c + d - 2 * c * d) / 2 - CAST(0.75 AS DOUBLE) AS u, (c + d - 1) / 4 AS v FROM bank))""", BANK))
def item_peak_information(spark, sf_dir):
    return bank.item_peak_information(item_bank(spark, sf_dir))


@query("bank_log_likelihood", with_views("items users resp", f"""SELECT user_id, {r('ll', 'loglik')}, {r('-ll', 'neg_loglik')} FROM (
    SELECT user_id, sum(CASE WHEN answer = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM (
    SELECT user_id, answer, c + (d - c) * {_sigmoid(D + " * a * (theta - b)")} AS p
    FROM resp JOIN bank USING (item_id) JOIN users USING (user_id)) GROUP BY user_id)""",
                                         {"bank": BANK["bank"]}))
def bank_log_likelihood(spark, sf_dir):
    answers, users, _ = tables(spark, sf_dir)
    return bank.bank_log_likelihood(answers, users, item_bank(spark, sf_dir))


@query("normalize_item_bank", with_views("items", f"""SELECT item_id, CAST(1 AS DOUBLE) AS a, {r('b', 'b')},
    CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d FROM items"""))
def normalize_item_bank(spark, sf_dir):
    _, _, items = tables(spark, sf_dir)
    return bank.normalize_item_bank(items.select("item_id", "b"))


RULES = {"a < 0": "a < 0", "c < 0": "c < 0", "c > 1": "c > 1", "d < 0": "d < 0", "d > 1": "d > 1"}


@query("validate_item_bank", with_views("", " UNION ALL ".join(
    [f"SELECT '{rule}' AS rule, CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM bank"
     for rule, test in RULES.items()] + [f"SELECT 'no column {c}', 0::BIGINT" for c in "abcd"]),
    {"bank": """SELECT CAST(p_size - 3 AS DOUBLE) AS a, CAST(p_size AS DOUBLE) / 30 - CAST(0.1 AS DOUBLE) AS c,
        CAST(p_retailprice AS DOUBLE) / 1000 AS d FROM part"""}))
def validate_item_bank(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), (F.col("p_size") - 3.0).alias("a"), F.lit(0.0).alias("b"),
        (F.col("p_size") / 30.0 - 0.1).alias("c"), (F.col("p_retailprice") / 1000).alias("d"))
    return bank.validate_item_bank(parts)
