"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a sentence end or a line break beyond a least
size), so that equal texts have equal chunks.  A chunk is known by its 64-bit digest; the digests
are verified once against the distinct chunks, and where different chunks share a digest they get
different numbers.  A document is then its recipe, the ordered list of chunk identifiers, and two
documents are equal exactly when their recipes are.  Chunk texts are shuffled once, after copies
within a task have been merged; everything later moves only recipes of a few bytes a kilobyte.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.common import Scratch, fold, matching_rows, quoted

#: A chunk ends at the first sentence end or line break after LEAST characters, or at MOST.
LEAST, MOST = 1024, 8192


def chunk(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; their concatenation is the text."""
    cut = rf"(?s)(?:.{{{least},{most}}}?[.!?\n]|.{{1,{most}}})"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _recipes(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    folded = docs.select(F.col(id_col).alias("id"), fold(F.coalesce(text_col, F.lit(""))).alias("folded"))
    return folded.select(
        "id", F.sha2(F.col("folded").cast("binary"), 256).alias("sha"),
        F.transform(chunk(F.col("folded")), lambda c: F.struct(
            digest(c).alias("digest"), F.lit(0).alias("number"))).alias("recipe"))


def _shared_digests(docs: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The distinct chunks, and the digests that several of them have."""
    chunks = (docs.select(F.explode(chunk(fold(F.col(text_col)))).alias("chunk"))
              .select(digest(F.col("chunk")).alias("digest"), "chunk").distinct())
    shared = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return chunks, shared


def _resolved(docs: DataFrame, id_col: str, text_col: str, digest, numbered: DataFrame) -> DataFrame:
    """Recipes with the numbers of those chunks whose digest is not theirs alone."""
    folded = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                         fold(F.coalesce(text_col, F.lit(""))).alias("folded"))
    parts = folded.select("id", "row", F.sha2(F.col("folded").cast("binary"), 256).alias("sha"),
                          F.posexplode_outer(chunk(F.col("folded"))).alias("pos", "chunk")) \
        .withColumn("digest", digest(F.col("chunk")))
    step = F.struct("pos", "digest", F.coalesce("number", F.lit(0)).alias("number"))
    return (parts.join(numbered, ["digest", "chunk"], "left").groupBy("row", "id", "sha")
            .agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), step))).alias("steps"))
            .select("id", "sha", F.transform("steps", lambda s: F.struct(
                s["digest"].alias("digest"), s["number"].alias("number"))).alias("recipe")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; of equal texts the largest id stays.
    A null text counts as empty, and all empty texts are equal.  Rows that repeat an id and a text
    count in group_size, and ``kept`` holds for each of them or for none.  A null id is below all
    others.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    recipes = scratch.keep(_recipes(docs, id_col, text_col, digest), "recipes")
    chunks, shared = _shared_digests(docs, text_col, digest)
    shared = scratch.keep(shared, "shared_digests")
    if not shared.isEmpty():
        by_text = Window.partitionBy("digest").orderBy("chunk")   # few chunks: those of one digest
        numbered = chunks.join(shared, "digest").withColumn("number", F.row_number().over(by_text))
        plain, recipes = recipes, scratch.keep(_resolved(docs, id_col, text_col, digest, numbered), "recipes")
        scratch.drop(plain)
    # Written, so that both sides of the join are plain exchanges and a hot recipe can be split.
    groups = scratch.keep(recipes.groupBy("recipe").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    scratch.only(recipes, groups)
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of repeated rows one stays.

    Null and empty texts are copies of each other.  Null ids stay only where a group has no other.  An
    empty table gives an empty table.  Texts are shuffled once.
    """
    scratch = Scratch(docs.sparkSession)
    stay = scratch.keep(mark_copies(docs, id_col, text_col).filter("kept").groupBy(
        quoted(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n")), "staying")
    folded = fold(F.coalesce(quoted(text_col), F.lit("")))
    return matching_rows(docs, stay, {"id": quoted(id_col), "sha": F.sha2(folded.cast("binary"), 256)})
