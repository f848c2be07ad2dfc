"""Quality classifier by Bradley-Terry ranking.

Preference pairs (a good document, a poor one) are learned by logistic loss on the difference of
their features, which gives every document a strength.  The threshold is a quantile of the
strengths of the training rows: as large a share lies below it as poor rows were labelled.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import Scratch, id_field, map_texts, quoted

SAMPLE = 20_000         # labelled rows that the fit reads at most, about; the smallest hashes of the ids
BINS, FEW = 1024, 10_000  # bins of a count, and values that are looked at, when a rank is sought
PAIRS = 4               # opponents for each row of the larger class
RIDGE = 1e-3
STEPS, TOLERANCE = 50, 1e-8
CUT = 0.7               # the score that a strength at the threshold gets
FEATURES = ("log_words", "word_length", "symbols", "digits", "capitals", "marks", "bars", "doubled", "distinct_words",
            "short_words", "stops", "lines_repeated", "line_length", "letters")
ALONE = re.compile(r"(?<!\S)\W(?!\S)")


def features(text: str | None) -> np.ndarray:
    """The numbers of FEATURES for a text; zeros for one without a word."""
    words = (text or "").split()
    if not words:
        return np.zeros(len(FEATURES), np.float32)
    n, chars = len(words), sum(map(len, words))
    lines = [line for line in text.split("\n") if line.strip()]
    count = lambda marks: sum(map(text.count, marks))
    distinct = set(words)
    alpha = sum(map(str.isalpha, words))
    return np.array([
        np.log1p(n), chars / n, count("#*$%&|<>") / n, count("0123456789") / chars, sum(map(str.isupper, words)) / n,
        count("!?") / n, len(ALONE.findall(text)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(distinct) / n ** 0.8, sum(len(w) < 3 for w in words) / n, count(".,;:") / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), alpha / n], np.float32)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, features (array of float), one row per row of ``docs``."""
    schema = T.StructType([id_field(docs, id_col), T.StructField("features", T.ArrayType(T.FloatType(), False))])

    def batch(columns):
        yield {id_col: columns[id_col], "features": [features(t.as_py()) for t in columns[text_col]]}

    return map_texts(docs, [id_col, text_col], schema, batch)


@dataclass(frozen=True)
class Ranking:
    """Strength of a document: weights on standardised features; ``threshold`` is the strength that scores CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        above = np.clip(self.strength(rows) - self.threshold + np.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-above))


def preference_pairs(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> np.ndarray:
    """Differences of features: every row of the larger class meets ``pairs`` rows of the other."""
    n = pairs * max(len(good), len(poor))
    draw = np.random.default_rng(seed)
    deal = lambda rows: np.concatenate([draw.permutation(len(rows)) for _ in range(-(-n // len(rows)))])[:n]
    return good[deal(good)] - poor[deal(poor)]


def fit(rows: np.ndarray, good: np.ndarray, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> Ranking:
    """Newton steps on the ridge-penalised logistic loss of the differences; ``mean`` and ``scale`` standardise.

    Without rows of both kinds there is no preference: all strengths are 0 and all scores CUT when
    every row is good or there is none, and below CUT when every row is poor.
    """
    width = len(FEATURES)
    if good.all() or not good.any():
        below = len(good) > 0 and not good.any()
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if below else 0.0)
    mean, scale = (rows.mean(axis=0), rows.std(axis=0) + 1e-6) if mean is None else (mean, scale)
    standard = (rows - mean) / scale
    differences = preference_pairs(standard[good], standard[~good])
    weights = np.zeros(width)
    for _ in range(STEPS):
        lose = 1 / (1 + np.exp(np.clip(differences @ weights, -40, 40)))
        gradient = differences.T @ lose / len(differences) - RIDGE * weights
        curved = (differences * (lose * (1 - lose))[:, None]).T @ differences / len(differences)
        step = np.linalg.solve(curved + RIDGE * np.eye(width), gradient)
        weights = weights + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < TOLERANCE:
            break
    strengths = standard @ weights
    # Between the two rows around the quantile, so that neither sits on the threshold.
    threshold = float(np.quantile(strengths, 1 - good.mean(), method="midpoint"))
    return Ranking(mean, scale, weights, threshold)


def nth_smallest(table: DataFrame, column: str, n: int) -> float:
    """The value of rank ``n`` (from 0) of a column without nulls, by counting bins and looking into the one it is in."""
    low, high = table.agg(F.min(column), F.max(column)).first()
    while True:
        inside = table.filter(F.col(column).between(low, high))
        if low == high:
            return low
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in counts.orderBy("low").collect():       # BINS rows at most
            if n < r.n:
                break
            n -= r.n
        if r.n <= FEW:
            return sorted(x[0] for x in inside.filter(F.col(column).between(r.low, r.high)).select(column).collect())[n]
        if (r.low, r.high) == (low, high):
            return low      # neighbouring numbers
        low, high = r.low, r.high


def _labelled(docs: DataFrame, known: DataFrame, few: bool, id_col: str, text_col: str) -> DataFrame:
    """key, good and features of the labelled documents.  Texts are not shuffled, however many labels there are."""
    schema = T.StructType([T.StructField("_id", known.schema["_id"].dataType), T.StructField("features", T.ArrayType(T.FloatType(), False))])

    def batch(columns):
        yield {"_id": columns["_id"], "features": [features(t.as_py()) for t in columns["_text"]]}

    named = docs.select(quoted(id_col).cast(known.schema["_id"].dataType).alias("_id"), quoted(text_col).alias("_text"))
    if few:
        named = named.join(F.broadcast(known.select("_id")), "_id", "left_semi")
    return map_texts(named, ["_id", "_text"], schema, batch).join(known, "_id").select(F.col("_id").alias("key"), F.col("_good").alias("good"), "features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Ranking:
    """Fit on the labelled documents, at most about ``sample`` of them, chosen by a hash of the id.

    Only the fit's weights come from the sample: means and deviations of the features, the share of good
    rows and the quantile that is the threshold cover all labelled documents.  Rows without an id or a label
    are left out; an id with several labels counts by their mean (a tie is good).
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(labels.select(quoted(id_col).alias("_id"), quoted(label_col).alias("_label")).dropna()
                         .groupBy("_id").agg((F.avg("_label") >= 0.5).alias("_good")), "labels")
    rows = scratch.keep(_labelled(docs, known, known.count() <= sample, id_col, text_col), "features")
    width = range(len(FEATURES))
    value = lambda k: F.col("features")[k].cast("double")
    totals = rows.agg(F.count(F.lit(1)), F.avg(F.col("good").cast("double")), F.array(*[F.avg(value(k)) for k in width]),
                      F.array(*[F.stddev_pop(value(k)) for k in width])).first()
    n, share = totals[0], totals[1]
    ring = F.pmod(F.xxhash64(F.lit("ranking"), "key"), F.lit(1 << 20))
    chosen = rows if n <= sample else rows.filter(ring < int((1 << 20) * sample / n))
    # Ordered by value: the fit does not depend on the order of partitions.
    found = sorted((tuple(r.features), r.good) for r in chosen.select("features", "good").collect())
    data, good = np.array([f for f, _ in found], float).reshape(-1, len(FEATURES)), np.array([g for _, g in found], bool)
    if good.all() or not good.any():
        ranking = fit(data, good)
    else:
        # Sums come in any order: so many digits do not depend on it.
        ranking = fit(data, good, *(np.round(np.array(x), 9) + extra for x, extra in ((totals[2], 0.0), (totals[3], 1e-6))))
        parts = [(value(k) - float(ranking.mean[k])) / float(ranking.scale[k]) * float(ranking.weights[k]) for k in width]
        strengths = scratch.keep(rows.select(sum(parts[1:], parts[0]).alias("strength")), "strengths")
        place = round((n - 1) * (1 - share), 6)
        around = [nth_smallest(strengths, "strength", int(k)) for k in (np.floor(place), np.ceil(place))]
        ranking = replace(ranking, threshold=float(sum(around) / 2))
    scratch.only()
    return ranking


def rank(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, strength, score, predicted (1 from CUT on), one row per row of ``docs``.

    Null and empty texts have all features zero and are scored like any other.  Repeated rows give a
    row each; an empty table an empty table.
    """
    schema = T.StructType([id_field(docs, id_col), T.StructField("strength", T.DoubleType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def batch(columns):
        rows = np.array([features(t.as_py()) for t in columns[text_col]], float).reshape(-1, len(FEATURES))
        score = ranking.score(rows)
        yield {id_col: columns[id_col], "strength": ranking.strength(rows), "score": score, "predicted": score >= CUT}

    return map_texts(docs, [id_col, text_col], schema, batch)
