"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its share of all words, by weight, but at most ``MOST_EPOCHS`` times its
size; what is cut off is shared among the others by weight.  A source is taken whole as often as
its target holds it; for the rest, documents get exponential keys divided by their quality weight,
are sorted by key within the source, and are taken while the running total of their sizes stays
nearest to the budget.  Sorting and running totals go by ranges of (source, key), so a source with
a third of all rows is spread over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.llm.common import WORD, Scratch, matching_rows, quoted, text_key
from marksheet.plans.skew import dense_rank_of, running_totals

WEIGHTS = (1, 2, 3)     # of the sources in order, repeating
MOST_EPOCHS = 3
SEED = "mix"
NOISE = "#*$%&|<>0123456789"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: mostly the share of characters that are neither digits nor markup symbols."""
    clean = F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(0.05) + F.lit(0.95) * clean, F.lit(0.05))


def exponential_key(id_: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with a uniform u from a hash of the id: the smallest keys are the sample."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (missing, source, source_size) with weight and target, all targets summing to all sizes.

    A target is min(most * size, level * weight); the level follows from the running totals over
    the sources in the order in which they reach their limit.
    """
    ranks = dense_rank_of(sources.select("missing", "source"), ["missing", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    known = scratch.keep(sources.join(ranks, ["missing", "source"]).select(
        "*", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit")), "sources")
    total, heavy = known.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return known.withColumn("target", F.lit(0.0))
    order = known.withColumn("ratio", F.col("limit") / F.col("weight"))
    sums = running_totals(order, ["ratio", "rank"], {"limits": "limit", "heavy": "weight"})
    level = (F.lit(total) - (F.col("limits") - F.col("limit"))) / (F.lit(heavy) - (F.col("heavy") - F.col("weight")))
    first = sums.withColumn("level", level).filter("ratio >= level") \
        .agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    if first is None:   # all are at their limit, up to rounding
        return known.withColumn("target", F.col("limit").cast("double"))
    return known.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(first)))


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: int, seed: str) -> DataFrame:
    """id, missing, source, text_key, size, source_size, target, copies: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    text = quoted(text_col)
    sized = scratch.keep(docs.select(
        quoted(id_col).alias("id"), *_source(quoted(source_col)), text_key(text).alias("text_key"), word_count(text).alias("size"),
        exponential_key(quoted(id_col), quality_weight(text), seed).alias("key")), "sizes")
    sources = scratch.keep(sized.groupBy("missing", "source").agg(F.sum("size").alias("source_size")), "source_sizes")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = scratch.keep(targets(sources, scratch, weights, most).withColumn("epochs", epochs.cast("long"))
                        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
                        .select("missing", "source", "rank", "source_size", "target", "epochs", "budget"), "plan")
    planned = sized.join(plan, ["missing", "source"])
    sums = running_totals(planned, ["key", "id", "size", "text_key"], {"through": "size"}, ["rank"])
    taken = F.when((F.col("size") > 0) & (2 * F.col("through") - F.col("size") <= 2 * F.col("budget")), 1).otherwise(0)
    scratch.only(sized, plan)
    return sums.select("id", "missing", "source", "text_key", "size", "source_size", "target", (F.col("epochs") + taken).alias("copies"))


def _source(source: Column) -> list[Column]:
    return [source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("source")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies.

    size is the number of words (null text: 0), taken = size * copies.  Null sources are one source,
    the last.  Documents without words are taken as often as their source is whole.  Rows that
    repeat an id and text have equal keys and are interchangeable.  A mix without words takes nothing.
    An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    found = _taken(docs, id_col, text_col, source_col, weights, most, seed)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Rows are told apart by id, source and text.  Of rows that repeat all three any one comes as often as
    all of them are taken.  Nulls, ties and empty tables are as for ``mix``.
    """
    scratch = Scratch(docs.sparkSession)
    keys = {"id": quoted(id_col), **dict(zip(("missing", "source"), _source(quoted(source_col)))), "text_key": text_key(quoted(text_col))}
    taken = scratch.keep(_taken(docs, id_col, text_col, source_col, weights, most, seed).groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 0"), "copies")
    rows = matching_rows(docs, taken, keys, ["copies"])
    carry = rows.columns[0]
    again = F.explode(F.sequence(F.lit(1), F.col(f"{carry}.copies").cast("int"))).alias(f"{carry}_again")
    return rows.select(again, *[quoted(c) for c in docs.columns]).drop(f"{carry}_again")
