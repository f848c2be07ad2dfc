"""Centroid clustering with distance bounds from a PCA rotation.

Vectors become integers once.  The second moments of all vectors, summed on Spark, give a rotation;
each vector keeps its leading rotated coordinates and the norm of the rest.  In every round the
distance of the leading coordinates plus the squared difference of the two rest norms is a lower
bound on the squared distance to a centroid, so only centroids whose bound does not exceed the exact
distance to one likely centroid are verified, in integers.  What moves is one sum for each cluster and component of a
task; centroids and moments are the only things on the driver and in every task, and their size does
not depend on the number of vectors.
"""
from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import Scratch, map_texts

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2"
LEADING = 12            # rotated coordinates that are kept
LARGEST = 1 << 27       # of an integer component: squared distances then fit in a long
ROWS = 4096             # vectors that meet the centroids at a time
SLACK = 1e-6            # relative, for the rounding of bounds and of rest norms


class Clustering(NamedTuple):
    """vectors: id, cluster, distance, one row per kept vector; centroids: (k, size) integers;
    verified: share of the (vector, centroid) pairs whose exact distance was needed."""
    vectors: DataFrame
    centroids: np.ndarray
    verified: float


def integers(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless there are ``size``, none null or non-finite."""
    doubles = vector.cast("array<double>")
    fine = lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)
    small = lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit(f"vector component of {LARGEST // scale} or more: squared distances would not fit in a long")).cast("long"))
    kept = (F.size(doubles) == size) & F.forall(doubles, fine)
    return F.when(F.coalesce(kept, F.lit(False)), F.transform(doubles, small))


def _matrix(column: pa.Array, size: int, dtype=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, size)


def _rotation(vectors: DataFrame, size: int, leading: int) -> np.ndarray:
    """The leading principal directions, (size, leading), from sums over all vectors."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def batch(columns):
        x = _matrix(columns["x"], size, np.float64)
        sums = np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
        yield {"cell": np.arange(len(sums), dtype=np.int32), "total": sums}

    cells = map_texts(vectors, ["x"], schema, batch).groupBy("cell").agg(F.sum("total").alias("total"))
    totals = np.array([total for _, total in sorted(cells.collect())])     # size * (size + 1) + 1 numbers
    if not len(totals):
        return np.eye(size)[:, :leading]
    n, mean = totals[-1], totals[size * size:-1] / totals[-1]
    spread = totals[:size * size].reshape(size, size) / n - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def _rotated(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of what they leave."""
    lead = x @ rotation
    return lead, np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of every row of ``x``, the smaller number
    on ties; and how many distances were verified."""
    c_lead, c_rest = _rotated(centroids.astype(np.float64), rotation)
    gap = (lead * lead).sum(1)[:, None] + (c_lead * c_lead).sum(1) - 2 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2
    size = 1 + (lead * lead).sum(1) + rest ** 2
    exact = lambda r, c: ((x[r] - centroids[c]) ** 2).sum(1)
    rows = np.arange(len(x))
    likely = exact(rows, gap.argmin(1))
    slack = SLACK * (size[:, None] + (c_lead * c_lead).sum(1) + c_rest ** 2)
    r, c = np.nonzero(gap - slack <= likely[:, None])
    found = np.full(gap.shape, np.iinfo(np.int64).max)
    found[r, c] = exact(r, c)
    best = found.argmin(1)      # the first of equal ones
    return best.astype(np.int32), found[rows, best], len(r) + len(x)


def _assigned(vectors: DataFrame, centroids: np.ndarray, rotation: np.ndarray, size: int):
    """A function from an Arrow batch's columns to its integer vectors, clusters, distances and verified pairs, part by part."""
    def parts(columns):
        for at in range(0, len(columns["x"]), ROWS):
            x = _matrix(columns["x"][at:at + ROWS], size)
            lead = _matrix(columns["lead"][at:at + ROWS], rotation.shape[1], np.float64)
            yield (at, x, *nearest(x, lead, columns["rest"][at:at + ROWS].to_numpy(), centroids, rotation))

    return parts


def _moved(vectors: DataFrame, centroids: np.ndarray, rotation: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Centroids after one round, and how many distances it verified."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("cluster", "cell")] + [T.StructField("total", T.LongType())])
    parts, k = _assigned(vectors, centroids, rotation, size), len(centroids)

    def run(batches):
        sums, most = np.zeros((k, size + 2), np.int64), 0
        for batch in batches:
            for _, x, cluster, _, verified in parts(dict(zip(["x", "lead", "rest"], batch.columns))):
                order = np.argsort(cluster, kind="stable")
                held, first = np.unique(cluster[order], return_index=True)
                sums[held, :size] += np.add.reduceat(x[order], first)
                sums[:, size] += np.bincount(cluster, minlength=k)
                sums[0, size + 1] += verified
            most = np.abs(sums).max()
            if most > 1 << 61:
                yield out(sums)
                sums[:] = 0
        if sums.any():
            yield out(sums)

    def out(sums):
        cluster, cell = np.nonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(sums[cluster, cell])],
                                          names=["cluster", "cell", "total"])

    totals = vectors.select("x", "lead", "rest").mapInArrow(run, schema).groupBy("cluster", "cell").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()   # k * (size + 2) rows at most
    table = [[0] * (size + 2) for _ in range(k)]
    for cluster, cell, total in totals:
        table[cluster][cell] = int(total)
    new = [[v // row[size] for v in row[:size]] if row[size] else old for row, old in zip(table, centroids.tolist())]
    return np.array(new, np.int64), table[0][size + 1]


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            size: int = SIZE, scale: int = SCALE, leading: int = LEADING, seed: str = SEED) -> Clustering:
    """Cluster the integer vectors of ``table``: the ``k`` with the smallest sha256 of "seed:id" are the
    first centroids, each of ``rounds`` rounds moves every non-empty centroid to the floor of its mean.

    Vectors that are null, of another length, or hold a null or non-finite component are not kept.
    A null id counts as an empty one; of rows with one id the smaller vector comes first; equal vectors
    may both be centroids, and the first gets all members.  With fewer than ``k`` vectors there are as
    many centroids; an empty table gives an empty result.  Components must stay below LARGEST / scale.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession)
    kept = scratch.keep(table.select(F.col(id_col).alias("id"), integers(F.col(vector_col), size, scale).alias("x")).filter("x is not null"), "integers")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), size)
    kind = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(first):
        return Clustering(spark.createDataFrame([], kind), centroids, 0.0)
    rotation = _rotation(kept, size, leading)
    schema = T.StructType([*kept.schema, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])

    def rotate(columns):
        lead, rest = _rotated(_matrix(columns["x"], size, np.float64), rotation)
        ends = np.arange(len(lead) + 1, dtype=np.int32) * rotation.shape[1]
        yield {"id": columns["id"], "x": columns["x"], "lead": pa.ListArray.from_arrays(ends, lead.ravel()), "rest": rest}

    vectors = scratch.keep(map_texts(kept, ["id", "x"], schema, rotate), "rotated")
    scratch.drop(kept)
    verified = 0
    for _ in range(rounds):
        centroids, n = _moved(vectors, centroids, rotation, size)
        verified += n
    parts = _assigned(vectors, centroids, rotation, size)

    def assign(columns):
        for at, x, number, distance, _ in parts(columns):
            yield {"id": columns["id"][at:at + len(x)], "cluster": number, "distance": distance}

    found = scratch.keep(map_texts(vectors, ["id", "x", "lead", "rest"], kind, assign), "clusters")
    pairs = rounds * found.count() * len(centroids)
    scratch.only(found)
    return Clustering(found, centroids, verified / pairs if pairs else 0.0)


def summary(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector."""
    spark = found.vectors.sparkSession
    sums = dict(found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())   # a row for each centroid
    whole = int(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    known = [(i, int(sums[i]), whole, digest(c)) for i, c in enumerate(found.centroids.tolist()) if i in sums]
    small = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.join(F.broadcast(small), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
