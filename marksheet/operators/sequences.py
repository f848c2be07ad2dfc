"""Answer sequences: one row per (trace, group), with the ordered answers in an array.

A row never holds more than ``max_len`` answers.  When some sequence is longer, its answers are
range-sorted over the cluster and cut into consecutive pieces; the table then has a ``seg`` column
(null for whole sequences), and the tracing jobs chain the pieces with an associative scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.plans.lineage import cut_lineage
from marksheet.plans.skew import skew_join

MAX_LEN = 8192   # answers per row; a power of two


def key_of(columns: list[str]) -> Column:
    """One key column from one or more columns, different for different values: parts are joined by "_".

    A backslash or underscore inside a part is escaped, and a null part is a backslash and "N".
    """
    if len(columns) == 1:
        return F.col(columns[0])
    escaped = [F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")) for c in columns]
    return F.concat_ws("_", *[F.coalesce(e, F.lit("\\N")) for e in escaped])


def build_sequences(rows: DataFrame, trace_by: list[str], group_by: list[str], order: list[str],
                    values: dict[str, str], max_len: int = MAX_LEN) -> DataFrame:
    """Ordered answer arrays per trace and group: trace, grp, [seg], seq.

    ``values`` maps field names of an array element to columns.  ``order`` must be unique.
    """
    flat = rows.select(key_of(trace_by).alias("trace"), key_of(group_by).alias("grp"), *order,
                       *[F.col(c).alias(f"_v_{n}") for n, c in values.items()])
    element = F.struct(*[F.col(c) for c in order], *[F.col(f"_v_{n}").alias(n) for n in values])
    listed = F.array_sort(F.collect_list(element)).alias("seq")
    keys = ["trace", "grp"]
    counts = flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    longest = counts.agg(F.max("_n")).first()[0]
    if longest is None or longest <= max_len:
        return flat.groupBy(*keys).agg(listed)

    long_keys = counts.filter(F.col("_n") > max_len).select(*keys, F.lit(True).alias("_long"))
    flagged = skew_join(flat, long_keys, keys, "left")
    whole = (flagged.filter("_long is null").groupBy(*keys).agg(listed)
             .withColumn("seg", F.lit(None).cast("long")))
    bits = max_len.bit_length() - 1
    ranged = (flagged.filter("_long").drop("_long")
              .repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn("seg", F.shiftright(F.monotonically_increasing_id(), bits)))
    pieces = cut_lineage(ranged, "pieces").groupBy(*keys, "seg").agg(listed)
    return whole.unionByName(pieces).select(*keys, "seg", "seq")


def build_sequences_generic(rows: DataFrame, trace_by: list[str], group_by: list[str], sorted_by: list[str],
                            values: dict[str, str], longer_than: int = 3, max_len: int = MAX_LEN) -> DataFrame:
    """Sequences of every trace whose longest sequence has more than ``longer_than`` answers."""
    keyed = rows.withColumn("_trace", key_of(trace_by)).withColumn("_grp", key_of(group_by))
    kept = (keyed.groupBy("_trace", "_grp").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("_trace").agg(F.max("_n").alias("_longest"))
            .filter(F.col("_longest") > longer_than).select("_trace"))
    return build_sequences(skew_join(keyed, kept, ["_trace"], "left_semi"), ["_trace"], ["_grp"],
                           sorted_by, values, max_len)


def is_split(seqs: DataFrame) -> bool:
    """Whether the table may hold sequences cut into pieces."""
    return "seg" in seqs.columns


def drop_short_sequences(seqs: DataFrame, minimum_obs: int = 3) -> DataFrame:
    """Sequences with at least ``minimum_obs`` answers, those of all their pieces together."""
    if not is_split(seqs):
        return seqs.filter(F.size("seq") >= minimum_obs)
    answers = F.sum(F.size("seq")).over(Window.partitionBy("trace", "grp"))
    return seqs.withColumn("_answers", answers).filter(F.col("_answers") >= minimum_obs).drop("_answers")


def join_history(test: DataFrame, seqs: DataFrame, trace: str, grp: str) -> DataFrame:
    """Each held-out answer with the learner's earlier answers on the same skill (null if none).

    A history that was cut into pieces gives one row per piece.
    """
    history = seqs.select(F.col("trace").alias(trace), F.col("grp").alias(grp),
                          *[c for c in seqs.columns if c not in ("trace", "grp")])
    return test.join(history, [trace, grp], "left")
