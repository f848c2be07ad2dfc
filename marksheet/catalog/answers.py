"""Queries on the answer table, its sequences and classical statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.catalog.sources import SKILLS
from marksheet.operators import classical as ct
from marksheet.operators import responses as rs
from marksheet.operators import sequences as sq
from marksheet.sources import views

ORDER = ["ts", "event_id"]


def _kt(spark, sf_dir):
    return views.tracing_answers(spark, sf_dir)


def _flawed(rows):
    """Answers with some nulls and some codes that are not 0 or 1."""
    return rows.withColumn("answer", F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 13 == 0, 2)
                           .otherwise(F.col("answer")))


@query("validate_responses", with_views("kt", """, f AS (SELECT CASE WHEN event_id % 17 = 0 THEN NULL
    WHEN event_id % 13 = 0 THEN 2 ELSE answer END AS answer FROM kt)
    SELECT count(*) AS n_rows, 0::BIGINT AS n_null_key, CAST(sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_answer,
    CAST(sum(CASE WHEN answer NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_answer FROM f"""))
def validate_responses(spark, sf_dir):
    return rs.validate_responses(_flawed(_kt(spark, sf_dir)))


MATRIX = ", ".join(f"max(CASE WHEN skill = '{s}' THEN answer END) AS {s}" for s in SKILLS)


@query("matrix_to_records", with_views("kt", f""", m AS (SELECT user_id, day, {MATRIX} FROM
    (SELECT *, CAST(ts AS DATE) AS day FROM kt) GROUP BY 1, 2)
    """ + " UNION ALL ".join(f"SELECT user_id * 10000 + dayofyear(day) AS user_id, '{s}' AS item_id, {s} AS answer FROM m WHERE {s} IS NOT NULL"
                             for s in SKILLS)))
def matrix_to_records(spark, sf_dir):
    day = F.col("user_id") * 10000 + F.dayofyear("ts")
    matrix = _kt(spark, sf_dir).groupBy(day.alias("user_id")).agg(*[
        F.max(F.when(F.col("skill") == s, F.col("answer"))).alias(s) for s in SKILLS])
    return rs.matrix_to_records(matrix, SKILLS)


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("records_to_matrix", with_views("resp", "SELECT user_id, " + ", ".join(
    f"max(CASE WHEN item_id = '{b}' THEN answer END) AS {b.lower().replace('#', '_')}" for b in BRANDS)
    + " FROM resp GROUP BY user_id"))
def records_to_matrix(spark, sf_dir):
    wide = rs.records_to_matrix(views.answers(spark, sf_dir), BRANDS)
    return wide.toDF("user_id", *[b.lower().replace("#", "_") for b in BRANDS])


def _with_params(spark, sf_dir):
    """Answers that carry changing, partly missing parameters."""
    n = F.col("event_id")
    return _kt(spark, sf_dir).withColumns({
        "a": F.when(n % 3 == 0, 0.5 + (n % 7) / 10.0), "b": F.when(n % 2 == 0, (n % 11) / 4.0),
        "c": F.when(n % 97 == 0, (n % 5) / 10.0), "theta": F.when(n % 37 == 0, (n % 13) / 3.0 - 2)})


PARAMS_SQL = """, p AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN CAST(0.5 AS DOUBLE) + (event_id % 7) / CAST(10 AS DOUBLE) END AS a,
    CASE WHEN event_id % 2 = 0 THEN (event_id % 11) / CAST(4 AS DOUBLE) END AS b,
    CASE WHEN event_id % 97 = 0 THEN (event_id % 5) / CAST(10 AS DOUBLE) END AS c,
    CASE WHEN event_id % 37 = 0 THEN (event_id % 13) / CAST(3 AS DOUBLE) - 2 END AS theta FROM kt)
    """


def _first(column, default):
    return f"coalesce(arg_min({column}, event_id) FILTER (WHERE {column} IS NOT NULL), CAST({default} AS DOUBLE))"


@query("extract_items", (with_views("kt", PARAMS_SQL) + f"""SELECT item_id, {r(_first("a", 1), "a")},
    {r(_first("b", 0), "b")}, {r(_first("c", 0), "c")} FROM p GROUP BY item_id"""))
def extract_items(spark, sf_dir):
    return rs.extract_items(_with_params(spark, sf_dir), "event_id")


@query("extract_users", (with_views("kt", PARAMS_SQL) + f"""SELECT user_id, {r(_first("theta", 0), "theta")}
    FROM p GROUP BY user_id"""))
def extract_users(spark, sf_dir):
    return rs.extract_users(_with_params(spark, sf_dir), "event_id")


@query("attach_dense_index", with_views("resp", """SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS user_iloc,
    dense_rank() OVER (ORDER BY item_id) - 1 AS item_iloc FROM resp"""))
def attach_dense_index(spark, sf_dir):
    return rs.attach_dense_index(views.answers(spark, sf_dir)).select(
        "user_id", "item_id", "answer", "user_iloc", "item_iloc")


@query("user_stats", with_views("resp", f"""SELECT c_custkey AS user_id, count(answer) AS n,
    CAST(coalesce(sum(answer), 0) AS BIGINT) AS n_right, {r("coalesce(avg(answer), 0)", "accuracy")}
    FROM customer LEFT JOIN resp ON c_custkey = user_id GROUP BY c_custkey"""))
def user_stats(spark, sf_dir):
    users = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return rs.user_stats(users, views.answers(spark, sf_dir))


@query("item_stats", with_views("resp", f"""SELECT item_id, count(answer) AS n, CAST(sum(answer) AS BIGINT) AS n_right,
    {r("avg(answer)", "accuracy")} FROM resp GROUP BY item_id"""))
def item_stats(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    return rs.item_stats(answers.select("item_id").distinct(), answers)


@query("set_theta", with_views("users", f"""SELECT c_custkey AS user_id, {r("coalesce(theta, c_acctbal / 10000)", "theta")}
    FROM customer LEFT JOIN users ON c_custkey = user_id"""))
def set_theta(spark, sf_dir):
    users = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 10000).alias("theta"))
    return rs.set_theta(users, views.users(views.answers(spark, sf_dir)))


@query("set_abc", with_views("items", f"""SELECT p_partkey AS part, p_brand AS item_id, {r("i.a", "a")},
    {r("i.b", "b")}, {r("CAST(p_size AS DOUBLE) / 100", "c")} FROM part JOIN items i ON i.item_id = p_brand"""))
def set_abc(spark, sf_dir):
    table = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_brand").alias("item_id"), F.lit(1.0).alias("a"),
        (F.col("p_size") / 100.0).alias("c"))
    values = views.items(views.answers(spark, sf_dir))
    return rs.set_abc(table, values, ["a", "b"]).select("part", "item_id", "a", "b", "c")


@query("response_summary", with_views("resp", f"""SELECT count(DISTINCT user_id) AS n_users,
    count(DISTINCT item_id) AS n_items, count(answer) AS n_rows,
    CAST(sum(answer) AS BIGINT) AS n_right, CAST(sum(1 - answer) AS BIGINT) AS n_wrong,
    {r("avg(answer) * 100", "percent_right")} FROM resp"""))
def response_summary(spark, sf_dir):
    return rs.response_summary(views.answers(spark, sf_dir))


@query("encode_first_seen", with_views("kt", """, f AS (SELECT item_id, min((ts, event_id)) AS t FROM kt GROUP BY item_id),
    c AS (SELECT item_id, row_number() OVER (ORDER BY t) - 1 AS code FROM f)
    SELECT event_id, item_id, code FROM kt JOIN c USING (item_id)"""))
def encode_first_seen(spark, sf_dir):
    return rs.encode_first_seen(_kt(spark, sf_dir), "item_id", ORDER, "code").select("event_id", "item_id", "code")


@query("pad_responses", with_views("resp", """SELECT CAST(user_id AS VARCHAR) AS user_id, item_id, answer FROM resp
    UNION ALL SELECT u, item_id, 0 FROM (SELECT DISTINCT item_id FROM resp), (VALUES ('_u_0'), ('_u_1')) v(u)
    UNION ALL SELECT CAST(user_id AS VARCHAR), i, 0 FROM (SELECT DISTINCT user_id FROM resp), (VALUES ('_i_0'), ('_i_1')) v(i)"""))
def pad_responses(spark, sf_dir):
    return rs.pad_responses(views.answers(spark, sf_dir), 2, 2, seed=1)


@query("quota_split", with_views("resp", """, s AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT item_id) AS i FROM resp),
    k AS (SELECT *, ceil(round(count(*) OVER (PARTITION BY user_id) - CAST(0.9 AS DOUBLE) * i, 6)) AS uq,
          floor(round(count(*) OVER (PARTITION BY item_id) - CAST(0.8 AS DOUBLE) * u, 6)) + 1 AS iq FROM resp, s),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS ur FROM k WHERE uq > 0 AND iq > 0),
    h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY user_id) AS ir FROM w WHERE ur <= uq)
    SELECT user_id, item_id, answer, (user_id, item_id) IN (SELECT (user_id, item_id) FROM h WHERE ir <= iq) AS is_test FROM resp"""))
def quota_split(spark, sf_dir):
    return rs.quota_split(views.answers(spark, sf_dir), ["item_id", "user_id"])


@query("leave_last_out", with_views("marked", "SELECT event_id, skill, user_id, answer, is_test FROM marked"))
def leave_last_out(spark, sf_dir):
    return rs.leave_last_out(_kt(spark, sf_dir), ["skill", "user_id"], ORDER, "event_id").select(
        "event_id", "skill", "user_id", "answer", "is_test")


SEQ_SQL = """SELECT skill AS trace, user_id AS grp, count(*) AS n,
    string_agg(CAST(answer AS VARCHAR), '' ORDER BY ts, event_id) AS answers,
    string_agg(item_id, '|' ORDER BY ts, event_id) AS item_list FROM kt GROUP BY 1, 2"""


def _printed(seqs):
    """Sequences as text: answers and items in order."""
    return seqs.select("trace", "grp", F.size("seq").cast("long").alias("n"),
                       F.array_join(F.transform("seq", lambda x: x["obs"].cast("string")), "").alias("answers"),
                       F.array_join(F.transform("seq", lambda x: x["item_id"]), "|").alias("item_list"))


VALUES = {"obs": "answer", "item_id": "item_id"}


@query("build_sequences", with_views("kt", SEQ_SQL))
def build_sequences(spark, sf_dir):
    return _printed(sq.build_sequences(_kt(spark, sf_dir), ["skill"], ["user_id"], ORDER, VALUES))


@query("build_sequences_generic", with_views("kt", """, k AS (SELECT item_id || '_' || (user_id % 10) AS trace, *,
    count(*) OVER (PARTITION BY item_id, user_id % 10, user_id) AS len FROM kt),
    m AS (SELECT *, max(len) OVER (PARTITION BY trace) AS longest FROM k)
    SELECT trace, user_id AS grp, count(*) AS n, string_agg(CAST(answer AS VARCHAR), '' ORDER BY ts, event_id) AS answers,
    string_agg(item_id, '|' ORDER BY ts, event_id) AS item_list FROM m WHERE longest > 3 GROUP BY 1, 2"""))
def build_sequences_generic(spark, sf_dir):
    rows = _kt(spark, sf_dir).withColumn("cohort", F.col("user_id") % 10)
    return _printed(sq.build_sequences_generic(rows, ["item_id", "cohort"], ["user_id"], ORDER, VALUES))


@query("drop_short_sequences", with_views("kt", f"SELECT * FROM ({SEQ_SQL}) WHERE n >= 10"))
def drop_short_sequences(spark, sf_dir):
    seqs = sq.build_sequences(_kt(spark, sf_dir), ["skill"], ["user_id"], ORDER, VALUES)
    return _printed(sq.drop_short_sequences(seqs, 10))


@query("join_history", with_views("train test", f""", s AS ({SEQ_SQL.replace("FROM kt", "FROM train")})
    SELECT event_id, skill, user_id, n, answers, item_list FROM test
    LEFT JOIN s ON skill = trace AND user_id = grp"""))
def join_history(spark, sf_dir):
    marked = rs.leave_last_out(_kt(spark, sf_dir), ["skill", "user_id"], ORDER, "event_id")
    seqs = _printed(sq.build_sequences(marked.filter("not is_test"), ["skill"], ["user_id"], ORDER, VALUES))
    test = marked.filter("is_test").select("event_id", "skill", "user_id")
    return sq.join_history(test, seqs, "skill", "user_id").select(
        "event_id", "skill", "user_id", "n", "answers", "item_list")


CTT_SQL = f"""SELECT item_id, n, n_right, {r("(n_right + 1) / CAST(n + 2 AS DOUBLE)", "accuracy")},
    {r("(1 - (n_right + 1) / CAST(n + 2 AS DOUBLE)) * 5", "difficulty")}, CAST(1 AS DOUBLE) AS slope,
    CAST(0 AS DOUBLE) AS guess
    FROM (SELECT item_id, count(answer) AS n, CAST(sum(answer) AS BIGINT) AS n_right FROM kt GROUP BY item_id)"""


@query("item_calibration_ctt", with_views("kt", CTT_SQL))
def item_calibration_ctt(spark, sf_dir):
    return ct.item_calibration(_kt(spark, sf_dir))


@query("attach_item_info", with_views("test train", f""", i AS ({CTT_SQL.replace("FROM kt", "FROM train")})
    SELECT event_id, user_id AS "user", skill AS knowledge, item_id, answer, n, n_right, accuracy, difficulty, slope, guess
    FROM test LEFT JOIN i USING (item_id)"""))
def attach_item_info(spark, sf_dir):
    marked = rs.leave_last_out(_kt(spark, sf_dir), ["skill", "user_id"], ORDER, "event_id")
    items = ct.item_calibration(marked.filter("not is_test"))
    test = marked.filter("is_test").select("event_id", "user_id", "skill", "item_id", "answer")
    return ct.attach_item_info(test, items, "item_id", {"user_id": "user", "skill": "knowledge"}).select(
        "event_id", "user", "knowledge", "item_id", "answer", "n", "n_right", "accuracy", "difficulty", "slope", "guess")


@query("mean_accuracy_by", with_views("kt", " UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS key, count(answer) AS n, {r("avg(answer)", "accuracy")}
    FROM kt GROUP BY {c}""" for c in ("skill", "user_id", "item_id"))))
def mean_accuracy_by(spark, sf_dir):
    return ct.mean_accuracy_by(_kt(spark, sf_dir), ["skill", "user_id", "item_id"])


@query("difficulty_unsmoothed", with_views("kt", f"""SELECT item_id, {r("(1 - avg(answer)) * 5", "difficulty")}
    FROM kt GROUP BY item_id"""))
def difficulty_unsmoothed(spark, sf_dir):
    return ct.difficulty_unsmoothed(_kt(spark, sf_dir))
