"""The table of registered queries and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.plans.skew import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded, so that both engines print the same value."""
    return df.select(*[F.round(f"`{f.name}`", DIGITS).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def query(key: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return rounded(function(spark, sf_dir))

        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


def r(expression: str, alias: str) -> str:
    """A rounded SQL column without negative zero."""
    return f"round({expression}, {DIGITS}) + CAST(0 AS DOUBLE) AS {alias}"


# The answer-log views in SQL, as chained common table expressions.
VIEWS = {
    "kt": ("", """SELECT user_id, event_type AS skill,
        concat(event_type, ',', CAST(CAST(props->>'$.k' AS INT) % 20 AS VARCHAR)) AS item_id,
        CASE WHEN value >= 35 THEN 1 ELSE 0 END AS answer, ts, event_id FROM events"""),
    "buys": ("", """SELECT o_custkey AS user_id, p_brand AS item_id, avg(l_quantity) AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "resp": ("buys", "SELECT user_id, item_id, CASE WHEN q >= 25.5 THEN 1 ELSE 0 END AS answer FROM buys"),
    "scores": ("buys", """SELECT user_id, item_id,
        CAST(least(3, floor((q - 1) / CAST(12.5 AS DOUBLE))) AS INT) AS score FROM buys"""),
    "items": ("resp", """SELECT item_id,
        CAST(0.75 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (CAST(substr(item_id, 7) AS INT) % 10) AS a,
        (1 - (sum(answer) + CAST(1 AS DOUBLE)) / (count(answer) + 2)) * 5 - CAST(2.5 AS DOUBLE) AS b,
        CAST(0.01 AS DOUBLE) * (CAST(substr(item_id, 7) AS INT) % 10) AS c
        FROM resp GROUP BY item_id"""),
    "users": ("resp", "SELECT user_id, avg(answer) * 4 - 2 AS theta FROM resp GROUP BY user_id"),
    # Chance of a right answer in difficulty form with the scaling constant.
    "scored": ("items users", """SELECT r.user_id, r.item_id, r.answer, i.a, i.b, i.c, u.theta,
        i.c + (1 - i.c) / (1 + exp(-(CAST(1.702 AS DOUBLE) * i.a * (u.theta - i.b)))) AS prob
        FROM resp r JOIN items i USING (item_id) JOIN users u USING (user_id)"""),
    # Last answer of each (skill, learner) with five answers or more.
    "marked": ("kt", """SELECT *, count(*) OVER g >= 5 AND row_number() OVER
        (PARTITION BY skill, user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_test
        FROM kt WINDOW g AS (PARTITION BY skill, user_id)"""),
    "train": ("marked", "SELECT * EXCLUDE (is_test) FROM marked WHERE NOT is_test"),
    "test": ("marked", "SELECT * EXCLUDE (is_test) FROM marked WHERE is_test"),
}


def with_views(names: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` the named views (and what they need) and further expressions, then ``body``."""
    needed: list[str] = []

    def add(name):
        for parent in VIEWS[name][0].split():
            add(parent)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in needed]
    parts += [f"{n} AS MATERIALIZED ({text})" for n, text in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
