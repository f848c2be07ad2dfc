"""Near duplicates by SimHash fingerprints and pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference fingerprints, the pivots.  By
the triangle inequality two fingerprints within ``BITS`` of each other differ by at most ``BITS`` in
every one of these distances, so a pair with a larger coordinate difference is discarded and only the
survivors are compared bit by bit.

The table also chooses the candidates.  A pivot comes with partners that are its complement outside
one block of the 64 bits; the sum of the two distances depends on that block alone.  Of four blocks,
two bits leave two untouched, so the pairs to look at have equal sums in two blocks: an equi-join.
Where more than ``CROWD`` fingerprints share such a key, their table is refined instead of paired: what
is left of the bits is cut into four smaller blocks, and again two of them are untouched.  After the last
level eight bits are left, so a key holds few fingerprints however large the crowd is.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import Scratch, map_texts, matching_rows, quoted, text_key
from marksheet.llm.components import components

SHINGLE, BITS = 3, 2
PIVOTS = 8          # reference fingerprints; each has a partner for every block
WIDTHS = (16, 8, 4)     # bits of a block at each level
CROWD = 32          # fingerprints that share a key; more of them are refined
BLOCK = 1 << 16     # shingles counted at a time


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash over the n-word shingles of a text with A-Z in lower case; 0 without words."""
    words = text.encode().lower().split() if text else []   # both touch ASCII bytes only
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(n)))] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        hashes = np.array([digest(s, 42) for s in shingles[at:at + BLOCK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """id, text_key, fp (the 64 bits as a signed long), one row per row of ``docs``, whatever it repeats.

    A null text, an empty one and one of white space have fingerprint zero.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def batch(columns):
        found = np.fromiter((fingerprint(t.as_py(), n) for t in columns["text"]), np.uint64)
        yield {"id": columns["id"], "text_key": columns["text_key"], "fp": pa.array(found.view(np.int64))}

    text = quoted(text_col)
    return map_texts(docs.select(quoted(id_col).alias("id"), text_key(text).alias("text_key"), text.alias("text")),
                     ["id", "text_key", "text"], schema, batch)


def _distances(fp: Column, flipped: Column) -> Column:
    """Distances to the pivots with the bits of ``flipped`` turned over, a byte each."""
    packed = F.lit(0).cast("long")
    for i in range(PIVOTS):
        pivot = F.xxhash64(F.lit(i)).bitwiseXOR(flipped)
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(pivot)).cast("long"), 8 * i))
    return packed


def _outside(width: int, at: Column) -> Column:
    """All bits but the ``width`` from ``at`` on."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit((1 << width) - 1).cast("long"), at))


TABLE = [f"t{i}" for i in range(5)]


def pivot_table(rows: DataFrame) -> DataFrame:
    """``rows`` with the distances of fp to all pivots (t0) and to their partners for the four blocks (t1..t4)."""
    partners = [_distances(F.col("fp"), _outside(WIDTHS[0], F.lit(WIDTHS[0] * i))) for i in range(4)]
    return rows.withColumns(dict(zip(TABLE, [_distances(F.col("fp"), F.lit(0).cast("long")), *partners])))


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """fp, key and at (first bits of the four blocks of the next level) for every two blocks that may be untouched."""
    width, half = WIDTHS[level], WIDTHS[level] // 2
    at = [F.lit(width * i) if level == 0 else F.col("at")[i] for i in range(4)]
    # The bytes of a sum stay below 256: eight distances of 64 at most, twice.
    sums = [F.col("t0") + (F.col(f"t{i + 1}") if level == 0 else _distances(F.col("fp"), _outside(width, at[i]))) for i in range(4)]
    before = F.lit(0).cast("long") if level == 0 else F.col("key")
    found = []
    for number, (i, j) in enumerate(combinations(range(4), 2)):
        others = [at[k] for k in range(4) if k not in (i, j)]
        found.append(F.struct(F.xxhash64(before, F.lit(number), sums[i], sums[j]).alias("key"),
                              F.array(*[start for o in others for start in (o, o + half)]).alias("at")))
    return rows.withColumn("next", F.explode(F.array(*found))).select("fp", "next.*")


def _no_farther(bits: int) -> Column:
    """No coordinate of the two tables differs by more than ``bits``."""
    test = F.lit(True)
    for t in TABLE:
        for i in range(PIVOTS):
            x, y = (F.shiftrightunsigned(F.col(f"{s}.{t}"), 8 * i).bitwiseAND(F.lit(255)) for s in "xy")
            test = test & (F.abs(x - y) <= bits)
    return test


def _pairs(few: DataFrame, *tests: Column) -> DataFrame:
    """Pairs (a, b) of one key that pass the tests."""
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    for test in tests:
        met = met & test
    return few.alias("x").join(few.alias("y"), met).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def links(distinct: DataFrame, scratch: Scratch, crowd: int = CROWD, counts: list | None = None) -> DataFrame:
    """All links (a < b) between distinct fingerprints that differ in two bits or fewer.

    A fingerprint has six keys at a level, and meets ``crowd`` others at most at a key, or the few that
    differ in its last eight bits.  ``counts`` gets (pairs met, pairs that the tables left, links) of every level.
    """
    level, rows, parts = 0, pivot_table(distinct.select("fp")), []
    survive, near = _no_farther(BITS), F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= BITS
    while rows is not None:
        keyed = scratch.keep(_keyed(rows, level), "keyed")
        sizes = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key_sizes")
        last = level == len(WIDTHS) - 1
        small = sizes if last else sizes.filter(F.col("n") <= crowd)
        few = scratch.keep(pivot_table(keyed.join(small, "key").select("key", "fp")), "few")
        parts.append(scratch.keep(_pairs(few, survive, near).distinct(), "links"))
        if counts is not None:
            counts.append(tuple(_pairs(few, *tests).count() for tests in ((), (survive,), (survive, near))))
        crowded = sizes.filter(F.col("n") > crowd).select("key")
        rows = None if last or crowded.isEmpty() else keyed.join(crowded, "key").withColumn("t0", _distances(F.col("fp"), F.lit(0).cast("long")))
        level += 1
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.distinct()


def _classes(distinct: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, root and component_id, the least first_id that links reach, of every row of ``distinct``."""
    member = components(found, scratch).withColumnRenamed("node", "fp")
    rooted = scratch.keep(distinct.select("fp", "first_id").join(member, "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return scratch.keep(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def _marked(docs: DataFrame, id_col: str, text_col: str, crowd: int, n: int) -> DataFrame:
    """id, text_key, fp, root, component_id: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    classes = _classes(distinct, links(distinct, scratch, crowd), scratch)
    scratch.only(prints, classes)
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
                    n: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among all documents that links of at most two bits reach,
    the document itself included; null only if all their ids are null.  A null text, an empty one
    and one of white space have fingerprint zero and are linked like any other.  Repeated rows give
    a row each.  An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    return _marked(docs, id_col, text_col, crowd, n).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
                         n: int = SHINGLE) -> DataFrame:
    """One row of every component, that of its smallest id, with all columns of ``docs``, whatever their names.

    Of rows with that id the one whose text has the smallest digest stays, of repeated rows any one.  A
    null id stays only where a component has no other.  Null and blank texts are one component.  An empty
    table gives an empty table.  Texts are shuffled once.
    """
    scratch = Scratch(docs.sparkSession)
    marked = _marked(docs, id_col, text_col, crowd, n)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    stay = scratch.keep(marked.groupBy("root", first.alias("row")).agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(
        F.min(F.struct("row", "n")).alias("least")).select("least.row.id", "least.row.text_key", "least.n"), "staying")
    return matching_rows(docs, stay, {"id": quoted(id_col), "text_key": text_key(quoted(text_col))})
