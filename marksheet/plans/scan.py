"""Scans over the ordered pieces of long sequences, as a tree.

Every piece has a value and stands at a node numbered by ``seg``.  Going up, the values of sibling
nodes (those whose numbers differ in the next few bits only) are combined into their parent's.
Going down, a parent's context, what reaches it from outside, is spread over its children.  A task
holds the siblings of one node at a time, 2^FAN_BITS values at most, however long a sequence is, and
the number of levels grows with the logarithm of the number of pieces.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.plans.lineage import cut_lineage

FAN_BITS = 6


def level_shifts(varying: int, fan_bits: int = FAN_BITS) -> list[int]:
    """How far node numbers are shifted at every level, so that a level adds ``fan_bits`` varying bits."""
    bits = [b for b in range(varying.bit_length()) if varying >> b & 1]
    return [0] + [part[-1] + 1 for part in (bits[i:i + fan_bits] for i in range(0, len(bits), fan_bits))]


def tree_scan(pieces: DataFrame, tops: DataFrame, keys: list[str], width: int,
              combine: Callable[[np.ndarray], np.ndarray],
              spread: Callable[[np.ndarray, np.ndarray], list], fan_bits: int = FAN_BITS) -> DataFrame:
    """keys, seg, context (array of doubles) of every piece.

    ``pieces`` has the keys, ``seg`` (not negative, one row each) and ``value``, an array of ``width`` doubles;
    ``tops`` the keys and ``context``, that of a whole sequence.  ``combine`` turns the values of
    consecutive nodes (a row each) into one, and must be associative.  ``spread`` gives each of them its
    context, given their values and their parent's context.  No pieces give no rows; sequences without
    a row in ``tops`` are left out.  Null keys are a key of their own.
    """
    doubles = T.ArrayType(T.DoubleType())
    fields = [pieces.schema[k] for k in keys] + [T.StructField("node", T.LongType())]
    nodes = cut_lineage(pieces.select(*keys, F.col("seg").cast("long").alias("node"), "value"), "pieces")
    varying = nodes.groupBy(*keys).agg(F.expr("bit_or(node) ^ bit_and(node)").alias("bits")) \
        .agg(F.bit_or("bits")).first()[0]
    shifts = level_shifts(varying or 0, fan_bits)

    def up(frames):
        for frame in frames:
            values = [combine(np.asarray(v).reshape(-1, width)) for v in frame["values"]]
            yield frame[[*keys, "node"]].assign(value=pd.Series(values, dtype=object, index=frame.index))

    def down(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                contexts = spread(np.asarray(row["values"]).reshape(-1, width), np.asarray(row["context"]))
                yield pd.DataFrame({**{k: pd.Series([row[k]] * len(contexts), dtype=frame[k].dtype) for k in keys},
                                    "node": row["nodes"], "context": contexts})

    levels = []
    for low, high in zip(shifts, shifts[1:]):
        if levels:
            nodes = levels[-1].select(*keys, "node", "values").mapInPandas(
                up, T.StructType([*fields, T.StructField("value", doubles)]))
        levels.append(cut_lineage(_siblings(nodes, keys, high - low), "level"))
    contexts = (levels[-1] if levels else nodes).select(*keys, "node")
    contexts = _beside(contexts, tops, keys)
    for level in reversed(levels):
        contexts = _beside(level, contexts, [*keys, "node"]).mapInPandas(
            down, T.StructType([*fields, T.StructField("context", doubles)]))
    return contexts.select(*keys, F.col("node").alias("seg"), "context")


def _siblings(nodes: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """A row per parent: keys, node, its children's numbers and, one after the other, their values."""
    children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "value")))
    return nodes.groupBy(*keys, F.shiftright("node", bits).alias("_parent")).agg(children.alias("_children")).select(
        *keys, F.col("_parent").alias("node"), F.transform("_children", lambda c: c["child"]).alias("nodes"),
        F.flatten(F.transform("_children", lambda c: c["value"])).alias("values"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of the matching row of ``right``; a null key matches a null key."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def attach(pieces: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` with their ``context``; both have the keys and ``seg``."""
    return _beside(pieces, contexts, [*keys, "seg"])
