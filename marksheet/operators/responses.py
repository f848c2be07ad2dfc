"""Operators on the answer table: checks, reshaping, parameter tables, splits."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.plans.lineage import cut_lineage
from marksheet.plans.skew import dense_rank_of, null_safe_sum, row_number_by, skew_join

REQUIRED = ("user_id", "item_id", "answer")
OPTIONAL = ("a", "b", "c", "theta")


def normalize_responses(df: DataFrame) -> DataFrame:
    """Check the required columns, read ``difficulty`` as ``b``, default ``a`` to 1, drop the rest."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"answer table lacks {', '.join(missing)}")
    if "difficulty" in df.columns and "b" not in df.columns:
        df = df.withColumnRenamed("difficulty", "b")
    if "a" not in df.columns:
        df = df.withColumn("a", F.lit(1.0))
    return df.select(*REQUIRED, *[c for c in OPTIONAL if c in df.columns])


def validate_responses(df: DataFrame) -> DataFrame:
    """One row of counts: rows, null keys, null answers, answers that are not 0 or 1."""
    checked = normalize_responses(df)
    return checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        null_safe_sum(F.col("user_id").isNull() | F.col("item_id").isNull()).alias("n_null_key"),
        null_safe_sum(F.col("answer").isNull()).alias("n_null_answer"),
        null_safe_sum(~F.col("answer").isin(0, 1)).alias("n_bad_answer"))


def matrix_to_records(matrix: DataFrame, items: list[str]) -> DataFrame:
    """Wide answers (one column per item) to one row per given answer."""
    return (matrix.unpivot("user_id", items, "item_id", "answer")
            .filter("answer is not null"))


def records_to_matrix(responses: DataFrame, items: list) -> DataFrame:
    """One row per learner, one column per item; a repeated (learner, item) is an error.

    Repeats are caught inside the same aggregation, so no second pass is needed.
    """
    once = F.when(F.count("answer") <= 1, F.max("answer")).otherwise(
        F.raise_error(F.lit("a learner answered an item twice")).cast("int"))
    return responses.groupBy("user_id").pivot("item_id", items).agg(once.alias("answer"))


def extract_items(responses: DataFrame, order: str, model: str = "3PL") -> DataFrame:
    """Distinct items with their first-seen parameters, defaults, and the model's restrictions."""
    found = responses.groupBy("item_id").agg(*[
        F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))), F.lit(default)).alias(c)
        if c in responses.columns else F.lit(default).alias(c)
        for c, default in (("a", 1.0), ("b", 0.0), ("c", 0.0))])
    if model == "1PL":
        found = found.withColumn("a", F.lit(1.0))
    if model in ("1PL", "2PL"):
        found = found.withColumn("c", F.lit(0.0))
    return found


def extract_users(responses: DataFrame, order: str) -> DataFrame:
    """Distinct learners with their first-seen ability, default 0."""
    if "theta" not in responses.columns:
        return responses.select("user_id").distinct().withColumn("theta", F.lit(0.0))
    first = F.min_by("theta", F.when(F.col("theta").isNotNull(), F.col(order)))
    return responses.groupBy("user_id").agg(F.coalesce(first, F.lit(0.0)).alias("theta"))


def attach_dense_index(responses: DataFrame) -> DataFrame:
    """Number learners and items 0..n-1 in key order and join both numbers to every answer."""
    result = responses
    for key, index in (("user_id", "user_iloc"), ("item_id", "item_iloc")):
        numbered = dense_rank_of(responses.select(key).distinct(), [key], index)
        result = skew_join(result, numbered, [key], "left")
    return result


def _counts(responses: DataFrame, key: str) -> DataFrame:
    return responses.groupBy(key).agg(F.count("answer").alias("n"),
                                      F.coalesce(F.sum("answer"), F.lit(0)).cast("long").alias("n_right"))


def user_stats(users: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers, right answers and accuracy of every learner; 0 for learners without answers."""
    return _with_counts(users, responses, "user_id")


def item_stats(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers, right answers and accuracy of every item; 0 for items without answers."""
    return _with_counts(items, responses, "item_id")


def _with_counts(entities: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    joined = entities.join(_counts(responses, key), [key], "left")
    return (joined.withColumn("n", F.coalesce("n", zero)).withColumn("n_right", F.coalesce("n_right", zero))
            .withColumn("accuracy", F.coalesce(F.try_divide("n_right", "n"), F.lit(0.0))))


def set_theta(users: DataFrame, values: DataFrame) -> DataFrame:
    """Replace abilities by the given ones where there are any."""
    return _overwrite(users, values, "user_id", ["theta"])


def set_abc(items: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the named item parameters by the given ones where there are any."""
    return _overwrite(items, values, "item_id", columns)


def _overwrite(table: DataFrame | None, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    if table is None:
        return values.select(key, *columns)
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, [key], "left")
    kept = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns]
    added = [F.col(f"_new_{c}").alias(c) for c in columns if c not in table.columns]
    return joined.select(*kept, *added)


def response_summary(responses: DataFrame, approximate: bool = False) -> DataFrame:
    """Learners, items, rows, right, wrong, percent right."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return responses.agg(
        distinct("user_id").alias("n_users"), distinct("item_id").alias("n_items"),
        F.count("answer").alias("n_rows"),
        null_safe_sum(F.col("answer") == 1).alias("n_right"),
        null_safe_sum(F.col("answer") == 0).alias("n_wrong"),
        (F.avg("answer") * 100).alias("percent_right"))


def encode_first_seen(rows: DataFrame, value: str, order: list[str], alias: str) -> DataFrame:
    """Number the values of a column in order of first appearance and join the number back."""
    names = [f"_first_{i}" for i in range(len(order))]
    seen = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_first")).select(
        value, *[F.col(f"_first.{c}").alias(n) for c, n in zip(order, names)])
    codes = dense_rank_of(seen, names, alias).select(value, alias)
    return skew_join(rows, codes, [value], "left")


def pad_responses(responses: DataFrame, user_count: int = 2, item_count: int = 2,
                  seed: int | None = None) -> DataFrame:
    """Add learners who answer every item wrong and items every learner answers wrong."""
    key_type = "string"
    base = responses.select(F.col("user_id").cast(key_type), F.col("item_id").cast(key_type), "answer")

    def names(prefix, n):
        return F.explode(F.array(*[F.lit(f"{prefix}{i}") for i in range(n)]))

    wrong = F.lit(0).cast(responses.schema["answer"].dataType).alias("answer")
    parts = [base]
    if user_count:
        parts.append(base.select("item_id").distinct()
                     .select(names("_u_", user_count).alias("user_id"), "item_id", wrong))
    if item_count:
        parts.append(base.select("user_id").distinct()
                     .select("user_id", names("_i_", item_count).alias("item_id"), wrong))
    padded = parts[0]
    for part in parts[1:]:
        padded = padded.unionByName(part)
    return padded if seed is None else padded.orderBy(F.rand(seed))


def quota_split(responses: DataFrame, order: list[str], hot_rows: int | None = None) -> DataFrame:
    """Mark answers as held out while learner and item both keep enough answers.

    A learner may lose answers down to 90 % of all items, an item down to 80 % of all learners.
    Only answers whose learner and item both have a quota compete: first for the learner's, the
    winners then for the item's, in ``order``.  The result does not depend on the order rows
    arrive in, and both guarantees hold.
    """
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    responses = cut_lineage(responses, "responses")
    all_users, all_items = responses.agg(F.count_distinct("user_id"), F.count_distinct("item_id")).first()
    users = _counts(responses, "user_id").select("user_id", F.ceil(
        F.round(F.col("n") - 0.9 * all_items, 6)).cast("long").alias("_user_quota")).filter("_user_quota > 0")
    items = _counts(responses, "item_id").select("item_id", (F.floor(
        F.round(F.col("n") - 0.8 * all_users, 6)) + 1).cast("long").alias("_item_quota")).filter("_item_quota > 0")
    keys = list(dict.fromkeys(["user_id", "item_id", *order]))
    open_rows = skew_join(skew_join(responses.select(*keys), users, ["user_id"], "inner"),
                          items, ["item_id"], "inner")
    ranked = row_number_by(open_rows, ["user_id"], order, "_user_rank", **extra)
    winners = ranked.filter("_user_rank <= _user_quota").drop("_user_rank")
    ranked = row_number_by(winners, ["item_id"], order, "_item_rank", **extra)
    held = ranked.filter("_item_rank <= _item_quota").select(*keys, F.lit(True).alias("_held"))
    return responses.join(held, keys, "left").select(
        *responses.columns, F.coalesce("_held", F.lit(False)).alias("is_test"))


def leave_last_out(rows: DataFrame, keys: list[str], order: list[str], row_id: str,
                   minimum: int = 5) -> DataFrame:
    """Mark the last answer of every group with at least ``minimum`` answers as held out.

    The last row comes from a combinable maximum, the flag from a join on the unique row id, so
    no group is sorted in one task.
    """
    last = (rows.groupBy(*keys)
            .agg(F.max(F.struct(*dict.fromkeys([*order, row_id]))).alias("_last"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= minimum)
            .select(F.col(f"_last.{row_id}").alias(row_id), F.lit(True).alias("_test")))
    return (rows.join(last, [row_id], "left")
            .withColumn("is_test", F.coalesce("_test", F.lit(False))).select(*rows.columns, "is_test"))
