"""Queries for readers, writers and answer-log joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.operators.evaluation import label_predictions
from marksheet.operators.scoring import score_records
from marksheet.plans.lineage import scratch_path
from marksheet.sources import logs, tables, views


def k_value():
    """The number inside an event's JSON."""
    return F.get_json_object("props", "$.k").cast("int")


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a tutor step log."""
    K, right = k_value(), F.col("value") >= 35
    answer = F.when(right, 1).otherwise(0)
    columns = [
        F.col("event_id").cast("int"), F.concat(F.lit("S"), F.col("user_id").cast("string")),
        F.col("event_type"), F.concat(F.lit("P"), (K % 20).cast("string")), K % 3 + 1,
        F.when(K % 11 != 0, F.concat(F.lit("step"), (K % 7).cast("string"))), F.col("value"),
        F.when(right, F.col("value") / 2), F.when(~right, F.col("value") / 4), answer, 1 - answer, K % 2,
        F.lit(1), F.when(K % 5 != 0, F.col("event_type")), (K % 9).cast("string"),
    ]
    return views.table(spark, sf_dir, "events").select(
        *[c.alias(f.name) for c, f in zip(columns, logs.STEP_LOG.fields)])


STEP_NAMES = ["row", "student", "hierarchy", "problem", "view", "step", "duration", "correct_duration",
              "error_duration", "cfa", "incorrects", "hints", "corrects", "kc", "opportunity"]
STEP_SQL = f"""SELECT CAST(event_id AS INT) AS row, 'S' || user_id AS student, event_type AS hierarchy,
    'P' || (k % 20) AS problem, k % 3 + 1 AS view, CASE WHEN k % 11 <> 0 THEN 'step' || (k % 7) END AS step,
    {r("value", "duration")}, {r("CASE WHEN value >= 35 THEN value / 2 END", "correct_duration")},
    {r("CASE WHEN value < 35 THEN value / 4 END", "error_duration")},
    CASE WHEN value >= 35 THEN 1 ELSE 0 END AS cfa, CASE WHEN value >= 35 THEN 0 ELSE 1 END AS incorrects,
    k % 2 AS hints, 1 AS corrects, CASE WHEN k % 5 <> 0 THEN event_type END AS kc,
    CAST(k % 9 AS VARCHAR) AS opportunity
    FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)"""


def write_step_log(spark: SparkSession, sf_dir: str, path: str) -> None:
    step_rows(spark, sf_dir).write.csv(path, sep="\t", header=True, escape='"')


@query("read_step_log", STEP_SQL)
def read_step_log(spark, sf_dir):
    path = scratch_path(spark, "steps")
    write_step_log(spark, sf_dir, path)
    return logs.read_step_log(spark, path).toDF(*STEP_NAMES)


@query("read_step_log_test", f"SELECT row, student, hierarchy, cfa, problem, step FROM ({STEP_SQL})")
def read_step_log_test(spark, sf_dir):
    path = scratch_path(spark, "steps")
    write_step_log(spark, sf_dir, path)
    return logs.read_step_log_test(spark, path).toDF("row", "student", "hierarchy", "cfa", "problem", "step")


@query("load_dataset", f"SELECT row, student, hierarchy, cfa, problem, step, problem || ',' || step AS item_name FROM ({STEP_SQL})")
def load_dataset(spark, sf_dir):
    root = scratch_path(spark, "datasets")
    write_step_log(spark, sf_dir, f"{root}/{logs.DATASETS['a89', 'train']}")
    return logs.load_dataset(spark, root, "a89", "train").toDF(
        "row", "student", "hierarchy", "cfa", "problem", "step", "item_name")


@query("derive_item_name", f"SELECT row, problem || ',' || step AS item_name FROM ({STEP_SQL})")
def derive_item_name(spark, sf_dir):
    return logs.derive_item_name(step_rows(spark, sf_dir)).select(F.col("Row").alias("row"), "item_name")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw lines: base columns and a JSON object with two answers."""
    K = k_value()
    month = F.concat(F.lit("2024_0"), (K % 3 + 1).cast("string"))
    base = [F.col("event_id"), F.col("user_id"), F.col("event_type"), K % 4,
            F.lit("2024-01-01"), F.concat(F.lit("city"), (K % 6).cast("string")),
            F.when(F.col("event_type") == "error", 1).otherwise(0), F.lit("2024-01-02"), F.lit("2024-01-03")]
    first = F.struct((K % 2).alias("answerStatus"), F.col("event_type").alias("answerContent"),
                     F.concat(F.lit("q"), (K % 20).cast("string")).alias("levelQuestionId"))
    second = F.struct((K % 3).alias("answerStatus"), F.lit("b").alias("answerContent"),
                      F.concat(F.lit("r"), (K % 10).cast("string")).alias("levelQuestionId"))
    answers = F.to_json(F.struct(first.alias("x1"), second.alias("x2")))
    return views.table(spark, sf_dir, "events").select(
        F.concat_ws(logs.RAW_SEPARATOR, *[c.cast("string") for c in base], answers).alias("value"),
        month.alias("p_month"))


RAW_SQL = """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS student_id, event_type AS course_id,
    CAST(k % 4 AS VARCHAR) AS course_level_id, '2024-01-01' AS start_time, 'city' || (k % 6) AS city_code,
    0 AS isdeleted, '2024-01-02' AS create_time, '2024-01-03' AS modify_time,
    CASE WHEN n = 1 THEN k % 2 ELSE k % 3 END AS "answerStatus",
    CASE WHEN n = 1 THEN event_type ELSE 'b' END AS "answerContent",
    CASE WHEN n = 1 THEN 'q' || (k % 20) ELSE 'r' || (k % 10) END AS "levelQuestionId",
    '2024_0' || (k % 3 + 1) AS p_month
    FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k, unnest([1, 2]) AS n FROM events WHERE event_type <> 'error')"""


@query("explode_answer_json", RAW_SQL)
def explode_answer_json(spark, sf_dir):
    return logs.explode_answer_json(raw_lines(spark, sf_dir))


@query("write_answers_partitioned", RAW_SQL)
def write_answers_partitioned(spark, sf_dir):
    path = scratch_path(spark, "answers")
    tables.write_answers_partitioned(logs.explode_answer_json(raw_lines(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query("insert_json_into_table", RAW_SQL)
def insert_json_into_table(spark, sf_dir):
    rows = logs.explode_answer_json(raw_lines(spark, sf_dir))
    path = scratch_path(spark, "json")
    rows.write.json(path)
    location = scratch_path(spark, "table")
    name = "answers_" + location.rsplit("-", 1)[1]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (p_month) LOCATION '{location}'")
    return tables.insert_json_into_table(spark, path, name)


@query("raw_to_table", RAW_SQL)
def raw_to_table(spark, sf_dir):
    root = scratch_path(spark, "raw")
    raw_lines(spark, sf_dir).write.partitionBy("p_month").text(root)
    return tables.raw_to_table(spark, root, scratch_path(spark, "answers"))


@query("star_join_responses", """SELECT l_orderkey AS record_id, o_custkey AS user_id, l_partkey AS item_id,
    p_brand AS brand, n_name AS city, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS answer
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderstatus = 'F' AND p_type = 'ECONOMY'""")
def star_join_responses(spark, sf_dir):
    t = lambda name: views.table(spark, sf_dir, name)
    return tables.star_join_responses(
        t("lineitem"),
        [(t("orders"), "l_orderkey", "o_orderkey"), (t("part"), "l_partkey", "p_partkey"),
         (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"),
         (t("region"), "n_regionkey", "r_regionkey")],
        F.col("r_name").isin("ASIA", "EUROPE") & (F.col("o_orderstatus") == "F") & (F.col("p_type") == "ECONOMY"),
        F.when(F.col("l_quantity") >= 25, 1).otherwise(0),
        {"record_id": "l_orderkey", "user_id": "o_custkey", "item_id": "l_partkey", "brand": "p_brand",
         "city": "n_name"})


@query("slice_responses", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber IN (1, 2, 3)""")
def slice_responses(spark, sf_dir):
    return tables.slice_responses(views.table(spark, sf_dir, "lineitem"),
                                  {"l_returnflag": "R", "l_linestatus": "F", "l_linenumber": [1, 2, 3]},
                                  ["l_orderkey", "l_partkey", "l_quantity"])


@query("recode_answers", """SELECT l_orderkey AS user_id, l_partkey AS item_id, l_discount AS difficulty,
    CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS answer FROM lineitem""")
def recode_answers(spark, sf_dir):
    return tables.recode_answers(views.table(spark, sf_dir, "lineitem"), {
        "l_orderkey": "user_id", "l_partkey": "item_id", "l_discount": "difficulty", "l_linenumber": "answer"})


@query("read_with_fallback", with_views("kt", """, p AS (SELECT * FROM kt WHERE skill = 'click'),
    s AS (SELECT * FROM kt WHERE skill <> 'click')
    SELECT user_id, answer, event_id FROM p UNION ALL SELECT user_id, answer, event_id FROM s
    WHERE (user_id, answer) NOT IN (SELECT user_id, answer FROM p)"""))
def read_with_fallback(spark, sf_dir):
    rows = views.tracing_answers(spark, sf_dir)
    primary, secondary = rows.filter("skill = 'click'"), rows.filter("skill <> 'click'")
    keep = ["user_id", "answer", "event_id"]
    return tables.read_with_fallback(primary.select(*keep), secondary.select(*keep), ["user_id", "answer"])


@query("candidate_items", """SELECT p_partkey, p_name, p_size, CAST(1 AS DOUBLE) AS a FROM part
    WHERE p_type = 'ECONOMY' AND p_size IN (1, 5, 9, 11, 20, 28) AND p_name LIKE '%ring%'""")
def candidate_items(spark, sf_dir):
    return tables.candidate_items(views.table(spark, sf_dir, "part"), {"p_type": "ECONOMY"},
                                  {"p_size": [1, 5, 9, 11, 20, 28]}, {"p_name": "%ring%"}) \
        .select("p_partkey", "p_name", "p_size", "a")


@query("save_load_params", with_views("items users", f"""SELECT item_id AS key, {r("a", "x")}, {r("b", "y")} FROM items
    UNION ALL SELECT CAST(user_id AS VARCHAR), {r("theta", "x")}, NULL FROM users"""))
def save_load_params(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    path = scratch_path(spark, "params")
    tables.save_params(views.items(answers), views.users(answers), path)
    items, users = tables.load_params(spark, path)
    return items.select(F.col("item_id").alias("key"), F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        users.select(F.col("user_id").cast("string").alias("key"), F.col("theta").alias("x"),
                     F.lit(None).cast("double").alias("y")))


def record_id():
    """One id per (learner, brand): the learner number and the brand number."""
    return F.col("user_id") * 100 + F.substring("item_id", 7, 10).cast("int")


@query("write_submission", with_views("scored", f"""SELECT user_id * 100 + CAST(substr(item_id, 7) AS INT) AS row_id,
    {r("prob", "prob")} FROM scored"""))
def write_submission(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    rows = score_records(answers, views.users(answers), views.items(answers)).withColumn("row_id", record_id())
    path = scratch_path(spark, "submission")
    tables.write_submission(rows, path)
    return spark.read.schema("row_id bigint, prob double").csv(path, sep="\t", header=True)


@query("badcase_report", with_views("scored", f"""SELECT user_id, item_id, answer, {r("prob", "prob")},
    CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred_label FROM scored
    WHERE (CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) <> answer"""))
def badcase_report(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    rows = score_records(answers, views.users(answers), views.items(answers))
    path = scratch_path(spark, "badcase")
    tables.write_badcase(label_predictions(rows), path)
    return spark.read.parquet(path).select("user_id", "item_id", "answer", "prob", "pred_label")


@query("read_skill_log", with_views("kt", """SELECT answer, CAST(user_id AS VARCHAR) AS user, item_id AS item,
    skill AS knowledge FROM kt"""))
def read_skill_log(spark, sf_dir):
    path = scratch_path(spark, "skill_log")
    views.tracing_answers(spark, sf_dir).select(F.col("answer") + 1, "user_id", "item_id", "skill") \
        .write.csv(path, sep="\t")
    return logs.read_skill_log(spark, path)


SKILLS = ["click", "error", "purchase", "signup", "view"]
PATTERN_SQL = ", ".join(f"max(CASE WHEN skill = '{s}' THEN answer ELSE 0 END)" for s in SKILLS)


@query("expand_pattern_counts", with_views("kt", f""", d AS (SELECT user_id, CAST(ts AS DATE) AS day, [{PATTERN_SQL}] AS p
    FROM kt GROUP BY 1, 2), c AS (SELECT p, count(*) AS n FROM d GROUP BY p),
    e AS (SELECT p, unnest(range(1, n + 1)) AS respondent FROM c)
    SELECT array_to_string(p, '') AS pattern, respondent, unnest({SKILLS}) AS item_id, unnest(p) AS answer FROM e"""))
def expand_pattern_counts(spark, sf_dir):
    rows = views.tracing_answers(spark, sf_dir)
    pattern = F.array(*[F.max(F.when(F.col("skill") == s, F.col("answer")).otherwise(0)) for s in SKILLS])
    daily = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(pattern.alias("pattern"))
    counts = daily.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return logs.expand_pattern_counts(counts, "pattern", "n", SKILLS).withColumn(
        "pattern", F.array_join(F.transform("pattern", lambda x: x.cast("string")), ""))
