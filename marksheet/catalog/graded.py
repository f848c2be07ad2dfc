"""Graded-response queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.functions.grids import hermite_grid
from marksheet.operators import graded
from marksheet.sources import views

NODES, MASS = hermite_grid()
PAIRS = ", ".join(f"({k}, CAST({t!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for k, (t, w) in enumerate(zip(NODES, MASS)))


def _reach(j: int) -> str:
    """P(score >= j) with slope 1 and thresholds 1, 0, -1."""
    return "1" if j == 0 else "0" if j == 4 else f"(1 / (1 + exp(-(theta + {2 - j}))))"


PROBS = " UNION ALL ".join(
    f"SELECT node, theta, mass, {j} AS category, {_reach(j)} - {_reach(j + 1)} AS prob FROM nodes" for j in range(4))
GRM = {"nodes": f"SELECT * FROM (VALUES {PAIRS}) v(node, theta, mass)", "probs": PROBS}


POSTERIOR = {
    "lik": """SELECT user_id, node, exp(sum(ln(prob)) + ln(any_value(mass))) AS l FROM scores JOIN probs ON score = category
        GROUP BY user_id, node""",
    "post": "SELECT user_id, node, l / sum(l) OVER (PARTITION BY user_id) AS p FROM lik"}


@query("score_patterns", with_views("scores", """SELECT user_id, item_id, c AS category,
    CASE WHEN score = c THEN 1 ELSE 0 END AS hit FROM scores, range(0, 4) t(c)"""))
def score_patterns(spark, sf_dir):
    return graded.score_patterns(views.scores(spark, sf_dir))


@query("grm_category_probs", with_views("scores", f"""SELECT item_id, node, {r('theta', 'theta')}, category, {r('prob', 'prob')}
    FROM (SELECT DISTINCT item_id FROM scores), probs""", GRM))
def grm_category_probs(spark, sf_dir):
    return graded.grm_category_probs(graded.start_items(views.scores(spark, sf_dir), 4))


@query("grm_estep", with_views("scores", f"""SELECT item_id, score, node, {r('sum(p)', 'n')} FROM scores JOIN post USING (user_id)
    GROUP BY 1, 2, 3""", {**GRM, **POSTERIOR}))
def grm_estep(spark, sf_dir):
    scores = views.scores(spark, sf_dir)
    counts = graded.grm_estep(scores, graded.start_items(scores, 4), 0)
    return counts.select("item_id", "score", F.posexplode("counts").alias("node", "n"))


def _elimination(size: int) -> dict[str, str]:
    """Solve the symmetric system a, b of every item (table system) by elimination: table solved, x0, x1, ..."""
    tables, name = {}, "system"
    for k in range(size - 1):
        kept = [f"a{i}{j}" for i in range(size) for j in range(i, size) if i <= k] + [f"b{i}" for i in range(k + 1)]
        left = [f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, size) for j in range(i, size)]
        right = [f"b{i} - a{k}{i} / a{k}{k} * b{k} AS b{i}" for i in range(k + 1, size)]
        tables[f"cleared{k}"] = f"SELECT item_id, {', '.join(kept + left + right)} FROM {name}"
        name = f"cleared{k}"
    for i in reversed(range(size)):
        known = "".join(f" - a{i}{j} * x{j}" for j in range(i + 1, size))
        tables[f"known{i}"] = f"SELECT *, (b{i}{known}) / a{i}{i} AS x{i} FROM {name}"
        name = f"known{i}"
    return {**tables, "solved": f"SELECT * FROM {name}"}


# One Fisher step from slope 1 and thresholds 1, 0, -1: parameters 0 to 2 are the thresholds, 3 is the slope.
_RISE = [f"({_reach(j)} * (1 - {_reach(j)}))" for j in range(5)]
_SLOPES = " UNION ALL ".join(
    f"SELECT node, {c} AS category, greatest({_reach(c)} - {_reach(c + 1)}, 1e-12) AS chance, "
    + ", ".join(f"{_RISE[q + 1] if c == q + 1 else '-' + _RISE[q + 1] if c == q else 'CAST(0 AS DOUBLE)'} AS d{q}" for q in range(3))
    + f", theta * ({_RISE[c]} - {_RISE[c + 1]}) AS d3 FROM nodes" for c in range(4))
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_UPTO = [f"1 / (1 + exp(-((1 + s3) * theta + {1 - j} + s{j})))" for j in range(3)]
_CHANCE = f"CASE category WHEN 0 THEN 1 - {_UPTO[0]} WHEN 1 THEN {_UPTO[0]} - {_UPTO[1]} WHEN 2 THEN {_UPTO[1]} - {_UPTO[2]} ELSE {_UPTO[2]} END"
MSTEP = {**GRM, **POSTERIOR,
    "cnt": "SELECT item_id, score AS category, node, sum(p) AS n FROM scores JOIN post USING (user_id) GROUP BY 1, 2, 3",
    "slopes": _SLOPES,
    "gradient": f"SELECT item_id, {', '.join(f'sum(n / chance * d{i}) AS b{i}' for i in range(4))} FROM cnt JOIN slopes USING (node, category) GROUP BY item_id",
    "held": "SELECT item_id, node, sum(n) AS n FROM cnt GROUP BY 1, 2",
    "information": f"""SELECT item_id, {', '.join(f"sum(n * d{i} * d{j} / chance){' + 1e-9' if i == j else ''} AS a{i}{j}" for i, j in _PAIRS)}
        FROM held JOIN slopes USING (node) GROUP BY item_id""",
    "system": "SELECT * FROM gradient JOIN information USING (item_id)",
    **_elimination(4),
    # The step, and its halves; the start comes as a step of nothing.
    "steps": f"""SELECT item_id, h, {', '.join(f'greatest(-1, least(1, x{i})) * scale AS s{i}' for i in range(4))}
        FROM solved, (SELECT h, CASE WHEN h < 0 THEN 0 ELSE CAST(0.5 AS DOUBLE) ** h END AS scale FROM range(-1, 31) t(h))""",
    "gains": f"""SELECT item_id, h, CASE WHEN any_value(1 + s0 > s1 AND s1 > s2 - 1) THEN sum(n * ln(greatest({_CHANCE}, 1e-300)))
        ELSE CAST('-infinity' AS DOUBLE) END AS value FROM steps JOIN cnt USING (item_id) JOIN nodes USING (node) GROUP BY 1, 2""",
    "taken": """SELECT item_id, min(g.h) AS h FROM gains g JOIN (SELECT item_id, value AS start FROM gains WHERE h < 0) USING (item_id)
        WHERE g.h >= 0 AND (g.h = 30 OR value >= start) GROUP BY item_id"""}


@query("grm_mstep", with_views("scores", f"""SELECT item_id, {r('1 + s3', 'slope')}, {r('1 + s0', 'threshold_1')},
    {r('s1', 'threshold_2')}, {r('s2 - 1', 'threshold_3')}, {r('greatest(abs(s0), abs(s1), abs(s2), abs(s3))', 'moved')}
    FROM steps JOIN taken USING (item_id, h)""", MSTEP))
def grm_mstep(spark, sf_dir):
    scores = views.scores(spark, sf_dir)
    items = graded.start_items(scores, 4)
    found = graded.grm_mstep(items, graded.grm_estep(scores, items, 0), 0, 3)
    return found.select("item_id", "slope", *[F.col("thresholds")[j].alias(f"threshold_{j + 1}") for j in range(3)], "moved")


@query("fit_grm")
def fit_grm(spark, sf_dir):
    items, _ = graded.fit_grm(views.scores(spark, sf_dir))
    return items
