"""Readers, writers, checks on input, plans."""
import pytest
from pyspark.sql import functions as F

from marksheet.catalog import QUERIES
from marksheet.catalog.sources import raw_lines, step_rows, write_step_log
from marksheet.operators import responses
from marksheet.plans import lineage
from marksheet.plans.lineage import RoundTable, cut_lineage, scratch_path
from marksheet.sources import logs, tables, views
from marksheet.streaming.ingest import stream_to_table


def test_ten_answer_log(spark):
    path = scratch_path(spark, "skill")
    # One learner, one skill, ten answers of code 1.
    spark.createDataFrame([(f"1\tu\ti{n}\tk",) for n in range(10)], "value string").coalesce(1).write.text(path)
    rows = logs.read_skill_log(spark, path).collect()
    assert len(rows) == 10 and {r.answer for r in rows} == {0} and {r.user for r in rows} == {"u"}


def test_broken_step_log_fails(spark):
    path = scratch_path(spark, "steps")
    spark.createDataFrame([("\t".join(["x"] * 15),), ("\t".join(["y"] * 15),)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        logs.read_step_log(spark, path).collect()


def test_unknown_and_missing_datasets(spark):
    with pytest.raises(ValueError):
        logs.load_dataset(spark, "/tmp", "nope", "train")
    with pytest.raises(FileNotFoundError):
        logs.load_dataset(spark, scratch_path(spark, "none"), "a56", "train")


@pytest.mark.parametrize("name,split,columns", [("a56", "train", 16), ("a67", "test", 7), ("a89", "test", 7),
                                                ("ba67", "train", 16), ("ba89", "train", 5), ("ba89", "test", 5)])
def test_dataset_columns(spark, sf_dir, name, split, columns):
    root = scratch_path(spark, "data")
    write_step_log(spark, sf_dir, f"{root}/{logs.DATASETS[name, split]}")
    found = logs.load_dataset(spark, root, name, split)
    assert len(found.columns) == columns and found.columns[-1] == "item_name"
    assert found.count() == step_rows(spark, sf_dir).count()


def test_insert_replaces_only_touched_months(spark):
    name = "months_" + scratch_path(spark, "x").rsplit("-", 1)[1]
    location = scratch_path(spark, "months")
    spark.sql(f"CREATE TABLE {name} (v INT, p_month STRING) USING parquet PARTITIONED BY (p_month) LOCATION '{location}'")
    tables.insert_overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p_month string"), name)
    tables.insert_overwrite(spark.createDataFrame([("b", 3)], "p_month string, v int"), name)
    assert {(r.v, r.p_month) for r in spark.table(name).collect()} == {(1, "a"), (3, "b")}


def test_month_filter_prunes_partitions(spark, sf_dir):
    path = scratch_path(spark, "answers")
    tables.write_answers_partitioned(logs.explode_answer_json(raw_lines(spark, sf_dir)), path)
    plan = spark.read.parquet(path).filter("p_month = '2024_01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p_month" in plan


def test_stream_load_equals_batch_load(spark, sf_dir):
    root, path, checkpoint = (scratch_path(spark, n) for n in ("raw", "stream", "checkpoint"))
    lines = raw_lines(spark, sf_dir)
    lines.filter("p_month = '2024_01'").write.partitionBy("p_month").text(root)
    stream_to_table(spark, root, path, checkpoint).awaitTermination()
    lines.filter("p_month <> '2024_01'").write.mode("append").partitionBy("p_month").text(root)
    stream_to_table(spark, root, path, checkpoint).awaitTermination()
    batch = logs.explode_answer_json(lines)
    stream = spark.read.parquet(path).select(*batch.columns)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).isEmpty()


def test_input_is_checked(spark):
    with pytest.raises(ValueError):
        responses.normalize_responses(spark.createDataFrame([(1, 2)], "user_id int, item_id int"))
    found = responses.normalize_responses(spark.createDataFrame(
        [(1, 2, 1, 0.5, "x")], "user_id int, item_id int, answer int, difficulty double, other string"))
    assert found.columns == ["user_id", "item_id", "answer", "a", "b"]


def test_repeated_answers_are_an_error(spark):
    rows = spark.createDataFrame([(1, "x", 1), (1, "x", 0)], "user_id int, item_id string, answer int")
    with pytest.raises(Exception, match="twice"):
        responses.records_to_matrix(rows, ["x", "y"]).collect()


def test_quotas_hold(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    marked = responses.quota_split(answers, ["item_id", "user_id"])
    users, items = answers.agg(F.count_distinct("user_id"), F.count_distinct("item_id")).first()
    kept = marked.filter("not is_test")
    left = lambda key: marked.groupBy(key).agg(
        F.sum(F.when(F.col("is_test"), 1).otherwise(0)).alias("out"), F.count("*").alias("n")).filter("out > 0")
    assert left("user_id").filter(F.col("n") - F.col("out") + 1 <= 0.9 * items).isEmpty()
    assert left("item_id").filter(F.col("n") - F.col("out") + 1 < 0.8 * users - 1e-9).isEmpty()
    assert 0 < marked.filter("is_test").count() < kept.count()


def test_round_table_keeps_the_last_round(spark):
    state = RoundTable(spark, "rounds")
    table = state.put(spark.range(5))
    for _ in range(3):
        table = state.put(table.withColumn("id", F.col("id") + 1))
    assert sorted(r.id for r in table.collect()) == [3, 4, 5, 6, 7]


def test_cut_lineage_reads_a_file(spark):
    plan = cut_lineage(spark.range(5).repartition(3))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "parquet" in plan.lower()


class FakeSession:
    """A session on a cluster, with or without a shared folder."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "app"})


def test_shared_folder_comes_from_the_session():
    assert lineage.scratch_dir(FakeSession("hdfs://shared/dir/")) == "hdfs://shared/dir"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.scratch_dir(FakeSession(None))


def test_slice_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["slice_responses"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("key", ["score_matrix", "mirt_score_matrix", "item_characteristic_curve", "accuracy_sweep",
                                 "pad_responses", "quota_split", "evaluate_binary", "kt_standard_eval"])
def test_no_cartesian_product(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
