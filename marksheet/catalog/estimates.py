"""Queries that estimate abilities and item parameters.

The SQL checks write the iterations out, one common table expression per round.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from marksheet.catalog.registry import VIEWS, query, r, with_views
from marksheet.catalog.scores import tables
from marksheet.functions.grids import normal_grid
from marksheet.operators import ability, calibration, joint, scoring
from marksheet.sources import views

VIEWS["rated"] = ("items resp", "SELECT r.*, i.a, i.b, i.c FROM resp r JOIN items i USING (item_id)")
NODES, MASS = normal_grid()


def clip(x, low, high):
    return f"least(greatest({x}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE))"


def theta_rounds(rounds: int, prior: tuple[float, float] | None) -> dict[str, str]:
    """Ability Newton steps, difficulty form with D = 1."""
    parts = {"t0": "SELECT DISTINCT user_id, CAST(0 AS DOUBLE) AS theta FROM rated"}
    g, h = "sum(rise * (answer - p) / p)", "sum(rise * rise * (1 - p) / p)"
    if prior:
        mu, sigma = prior
        g = f"({g} - (any_value(theta) - {mu}) / CAST({sigma ** 2} AS DOUBLE))"
        h = f"({h} + 1 / CAST({sigma ** 2} AS DOUBLE))"
    for i in range(rounds):
        parts[f"t{i + 1}"] = f"""SELECT user_id, {clip("any_value(theta) + " + clip(f"{g} / {h}", -1, 1), -6, 6)} AS theta FROM (
            SELECT user_id, theta, answer, p, a * (p - c) / (1 - c) AS rise FROM (
            SELECT user_id, theta, answer, a, c, c + (1 - c) / (1 + exp(-a * (theta - b))) AS p
            FROM rated JOIN t{i} USING (user_id))) GROUP BY user_id"""
    return parts


def rated(spark, sf_dir):
    answers, _, items = tables(spark, sf_dir)
    return scoring.with_parameters(answers, None, items)


def theta_sql(prior: tuple[float, float] | None) -> str:
    last = ability.ROUNDS
    return with_views("rated", f"""SELECT user_id, {r('n.theta', 'theta')}, abs(n.theta - o.theta) <= {ability.TOL!r}::DOUBLE AS converged
    FROM t{last} n JOIN t{last - 1} o USING (user_id)""", theta_rounds(last, prior))


@query("theta_mle", theta_sql(None))
def theta_mle(spark, sf_dir):
    return ability.theta_mle(rated(spark, sf_dir))


@query("theta_map", theta_sql((0.5, 1.5)))
def theta_map(spark, sf_dir):
    return ability.theta_map(rated(spark, sf_dir), 0.5, 1.5)


@query("theta_gradient_information", with_views("users rated", f"""SELECT user_id, {r('sum(rise * (answer - p) / p)', 'gradient')},
    {r('sum(rise * rise * (1 - p) / p)', 'information')} FROM (
    SELECT user_id, answer, p, a * (p - c) / (1 - c) AS rise FROM (SELECT *, c + (1 - c) / (1 + exp(-a * (theta - b))) AS p
    FROM rated JOIN users USING (user_id))) GROUP BY user_id"""))
def theta_gradient_information(spark, sf_dir):
    return ability.theta_gradient_information(*tables(spark, sf_dir))


@query("item_gradient_information", with_views("users rated", f"""SELECT item_id, {r('sum((answer - p) * w * theta)', 'grad_a')},
    {r('sum((answer - p) * w)', 'grad_b')}, {r('-sum(w * w * p * (1 - p) * theta * theta)', 'hess_aa')},
    {r('-sum(w * w * p * (1 - p) * theta)', 'hess_ab')}, {r('-sum(w * w * p * (1 - p))', 'hess_bb')} FROM (
    SELECT item_id, answer, theta, p, (1 - c) * s * (1 - s) / (p * (1 - p)) AS w FROM (
    SELECT *, c + (1 - c) * s AS p FROM (SELECT *, 1 / (1 + exp(-(a * theta + b))) AS s
    FROM rated JOIN users USING (user_id)))) GROUP BY item_id"""))
def item_gradient_information(spark, sf_dir):
    return calibration.item_gradient_information(*tables(spark, sf_dir))


def node_table() -> str:
    pairs = ", ".join(f"({k}, CAST({t!r} AS DOUBLE), CAST({w!r} AS DOUBLE))"
                      for k, (t, w) in enumerate(zip(NODES, MASS)))
    return f"SELECT * FROM (VALUES {pairs}) v(k, node, mass)"


def estep(items: str, tag: str) -> dict[str, str]:
    """Posterior of each learner and node, in intercept form."""
    return {
        f"raw{tag}": f"""SELECT user_id, k, any_value(node) AS node, sum(CASE WHEN answer = 1 THEN ln(p) ELSE ln(1 - p) END)
            + ln(any_value(mass)) AS l FROM (SELECT resp.user_id, k, node, mass, answer,
            c + (1 - c) / (1 + exp(-(a * node + b))) AS p FROM resp JOIN {items} USING (item_id), nodes)
            GROUP BY user_id, k""",
        f"top{tag}": f"SELECT user_id, max(l) AS top FROM raw{tag} GROUP BY user_id",
        f"tot{tag}": f"SELECT user_id, any_value(top) + ln(sum(exp(l - top))) AS lse FROM raw{tag} JOIN top{tag} USING (user_id) GROUP BY user_id",
        f"post{tag}": f"SELECT user_id, k, node, exp(l - lse) AS p, lse FROM raw{tag} JOIN tot{tag} USING (user_id)",
        f"cnt{tag}": f"""SELECT item_id, k, any_value(node) AS node, sum(CASE WHEN answer = 1 THEN p ELSE 0 END) AS rr,
            sum(CASE WHEN answer = 0 THEN p ELSE 0 END) AS ww FROM resp JOIN post{tag} USING (user_id) GROUP BY item_id, k""",
    }


def mstep(items: str, tag: str, rounds: int) -> dict[str, str]:
    """Newton steps on slope and intercept; the last one is ``new{tag}``."""
    parts, current = {}, items
    for i in range(rounds):
        name = f"new{tag}" if i == rounds - 1 else f"m{tag}_{i}"
        det = "(haa * hbb - hab * hab)"
        parts[name] = f"""SELECT item_id, {clip("a + " + clip(f"(ga * hbb - gb * hab) / {det}", -1, 1), 0.25, 5)} AS a,
            {clip("b + " + clip(f"(haa * gb - hab * ga) / {det}", -1, 1), -6, 6)} AS b, c FROM (
            SELECT item_id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(e * d * node) AS ga, sum(e * d) AS gb,
            sum(n * v * d * d * node * node) AS haa, sum(n * v * d * d * node) AS hab, sum(n * v * d * d) AS hbb FROM (
            SELECT *, (rr - (rr + ww) * p) / (p * (1 - p)) AS e, rr + ww AS n, 1 / (p * (1 - p)) AS v, (1 - c) * s * (1 - s) AS d FROM (
            SELECT *, c + (1 - c) * s AS p FROM (SELECT item_id, node, rr, ww, a, b, c, 1 / (1 + exp(-(a * node + b))) AS s
            FROM cnt{tag} JOIN {current} USING (item_id)))) GROUP BY item_id)"""
        current = name
    return parts


NODE_VIEW = {"nodes": node_table()}


@query("estep_posterior", with_views("resp items", f"""SELECT user_id, k AS node, {r('p', 'mass')}, {r('lse', 'loglik')} FROM post0""",
                                     {**NODE_VIEW, **estep("items", "0")}))
def estep_posterior(spark, sf_dir):
    answers, _, items = tables(spark, sf_dir)
    return ability.estep_posterior(answers, items).select(
        "user_id", "loglik", F.posexplode("posterior").alias("node", "mass"))


@query("theta_eap", with_views("resp items", f"SELECT user_id, {r('sum(p * node)', 'theta')} FROM post0 GROUP BY user_id",
                               {**NODE_VIEW, **estep("items", "0")}))
def theta_eap(spark, sf_dir):
    answers, _, items = tables(spark, sf_dir)
    return ability.theta_eap(answers, items)


@query("expected_counts", with_views("resp items", f"SELECT item_id, k AS node, {r('rr', 'n_right')}, {r('ww', 'n_wrong')} FROM cnt0",
                                     {**NODE_VIEW, **estep("items", "0")}))
def expected_counts(spark, sf_dir):
    answers, _, items = tables(spark, sf_dir)
    counts = calibration.expected_counts(answers, ability.estep_posterior(answers, items))
    return counts.select("item_id", F.posexplode(F.arrays_zip("right", "wrong")).alias("node", "_c")).select(
        "item_id", "node", F.col("_c.right").alias("n_right"), F.col("_c.wrong").alias("n_wrong"))


PRINTED = f"SELECT item_id, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')} FROM "


@query("mstep_items", with_views("resp items", PRINTED + "new0",
                                 {**NODE_VIEW, **estep("items", "0"), **mstep("items", "0", 10)}))
def mstep_items(spark, sf_dir):
    answers, _, items = tables(spark, sf_dir)
    counts = calibration.expected_counts(answers, ability.estep_posterior(answers, items))
    return calibration.mstep_items(items, counts, NODES)


START = {"start": "SELECT DISTINCT item_id, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM resp"}


@query("fit_mml_two_rounds", with_views("resp", PRINTED + "new1", {
    **NODE_VIEW, **START, **estep("start", "0"), **mstep("start", "0", 3),
    **estep("new0", "1"), **mstep("new0", "1", 3)}))
def fit_mml_two_rounds(spark, sf_dir):
    items, _, _ = calibration.fit_mml(views.answers(spark, sf_dir), fixed_rounds=2, inner_rounds=3)
    return items


@query("fit_mml")
def fit_mml(spark, sf_dir):
    items, users, info = calibration.fit_mml(views.answers(spark, sf_dir))
    return _flat(items, users).withColumn("converged", F.lit(info["converged"]))


def item_rounds(rounds: int) -> dict[str, str]:
    parts, current = dict(START), "start"
    det = "(haa * hbb - hab * hab)"
    for i in range(rounds):
        parts[f"i{i}"] = f"""SELECT item_id, {clip("a + " + clip(f"(ga * hbb - gb * hab) / {det}", -1, 1), 0.25, 5)} AS a,
            {clip("b + " + clip(f"(haa * gb - hab * ga) / {det}", -1, 1), -6, 6)} AS b, c FROM (
            SELECT item_id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum((answer - p) * theta) AS ga,
            sum(answer - p) AS gb, sum(p * (1 - p) * theta * theta) AS haa, sum(p * (1 - p) * theta) AS hab,
            sum(p * (1 - p)) AS hbb FROM (SELECT item_id, answer, theta, a, b, c, 1 / (1 + exp(-(a * theta + b))) AS p
            FROM resp JOIN users USING (user_id) JOIN {current} USING (item_id)) GROUP BY item_id)"""
        current = f"i{i}"
    return parts


@query("item_mle", with_views("resp users", PRINTED + "i19", item_rounds(20)))
def item_mle(spark, sf_dir):
    answers, users, items = tables(spark, sf_dir)
    start = items.select("item_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    return calibration.item_mle(answers, users, start, "2PL")


def _flat(items, users, *more):
    """Estimated items and abilities in one table, with the columns ``more`` of both."""
    return items.select(F.col("item_id").alias("key"), F.lit("item").alias("kind"),
                        F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), *more).unionByName(
        users.select(F.col("user_id").cast("string").alias("key"), F.lit("learner").alias("kind"),
                     F.lit(None).cast("string").alias("a"), F.col("theta").cast("string").alias("b"), *more))


@query("fit_mhrm")
def fit_mhrm(spark, sf_dir):
    items, users = joint.fit_mhrm(views.answers(spark, sf_dir))
    return _flat(items.drop("converged"), users).join(F.broadcast(items.agg(F.min("converged").alias("converged"))))


@query("fit_mh_mle")
def fit_mh_mle(spark, sf_dir):
    items, users = joint.fit_mh_mle(views.answers(spark, sf_dir))
    return _flat(items.drop("converged"), users).join(F.broadcast(items.agg(F.min("converged").alias("converged"))))


@query("fit_bayes_modal")
def fit_bayes_modal(spark, sf_dir):
    items, users, _ = joint.fit_bayes_modal(views.answers(spark, sf_dir), "3PL")
    return _flat(items, users, "converged")


@query("fit_mirt_modal")
def fit_mirt_modal(spark, sf_dir):
    items, users, _ = joint.fit_mirt_modal(views.answers(spark, sf_dir), 2, "M2PL")
    return _flat(items, users, "converged")


@query("fit_mirt_nc_modal")
def fit_mirt_nc_modal(spark, sf_dir):
    items, users, _ = joint.fit_mirt_nc_modal(views.answers(spark, sf_dir), 2, "M3PLN")
    return _flat(items, users, "converged")
