"""Language identification as inference of a mixture.

A language is a distribution over character trigrams (hashed to a fixed number of bins), counted
over all training documents.  A document is a mixture of languages: expectation-maximisation finds
the proportions that make its trigrams likeliest.  Each further language must raise the
log-likelihood by more than a penalty that grows with the logarithm of the number of trigrams; the
set with the best penalised likelihood is the document's language set.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import id_field, map_texts, quoted

BINS = 1 << 14
BLOCK = 1 << 20         # characters hashed at a time
MOST_LANGUAGES = 512    # the driver holds BINS numbers for each; more are an error, not cut off
SMOOTH = 0.5
PENALTY = 3.0
ROUNDS, TOLERANCE = 60, 1e-3
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed trigrams of a text, letters in lower case and all else as one blank; None without a letter."""
    if not text:
        return None
    letters, total, any_letter = _letters(), np.zeros(BINS, np.int64), False
    text = text.lower()
    carry = np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters[codes]
        any_letter |= bool(is_letter.any())
        codes = np.concatenate([carry, np.where(is_letter, codes, 32).astype(np.uint32)])
        if at + BLOCK >= len(text):
            codes = np.append(codes, np.uint32(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if len(codes) > 2:
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(18), minlength=BINS)
        carry = codes[-2:]
    return total if any_letter else None


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bin, n over all rows with a language and a letter; sums within a batch come before the shuffle."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def batch(columns):
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(columns[text_col], columns[lang_col]):
            counts = trigrams(text.as_py())
            if counts is not None:
                name = lang.as_py()
                sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            bins = np.flatnonzero(counts)
            yield {"lang": [name] * len(bins), "bin": bins, "n": counts[bins]}

    rows = docs.filter(F.col(lang_col).isNotNull())
    return map_texts(rows, [text_col, lang_col], schema, batch).groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and the log probabilities (languages x bins)."""
    counts = count_trigrams(docs, text_col, lang_col).toPandas()   # languages x BINS rows at most
    names = sorted(counts["lang"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the limit is {MOST_LANGUAGES}")
    table = np.full((len(names), BINS), SMOOTH)
    place = {name: k for k, name in enumerate(names)}
    table[counts["lang"].map(place).to_numpy(int), counts["bin"].to_numpy(int)] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def proportions(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of ``likelihood`` by EM, and the log-likelihood."""
    total = counts.sum()
    weights = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(ROUNDS if len(weights) > 1 else 0):
        new = weights * (likelihood.T @ (counts / (likelihood @ weights))) / total
        moved, weights = np.abs(new - weights).max(), new
        if moved < TOLERANCE:
            break
    return weights, float(counts @ np.log(likelihood @ weights))


def mixture(counts: np.ndarray, log_table: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """The languages of a document and their proportions.

    Languages enter in the order of their weight in the mixture of all; the set grows while the
    penalised likelihood does, and the likelihood of all of them says early when it cannot.
    """
    bins = np.flatnonzero(counts)
    n = counts[bins].astype(float)
    logs = log_table[:, bins]
    likelihood = np.exp(logs - logs.max(axis=0)).T
    weights, most = proportions(likelihood, n)
    order, price = np.argsort(-weights, kind="stable"), penalty * np.log1p(n.sum())
    chosen = order[:1]
    best = float(n @ np.log(likelihood[:, chosen[0]]))
    shares = np.ones(1)
    while len(chosen) < len(order) and most - best > price:
        wider = order[:len(chosen) + 1]
        wider_shares, value = proportions(likelihood[:, wider], n)
        if value - best <= price:
            break
        chosen, shares, best = wider, wider_shares, value
    return {int(k): float(s) for k, s in zip(chosen, shares)}


def main_language(text: Column, names: list[str], log_table: np.ndarray, penalty: float = PENALTY) -> Column:
    """The language with the largest proportion, as in ``predict``, as a column: rows need not be joined again."""

    @F.arrow_udf(T.StringType())
    def top(texts: pa.Array) -> pa.Array:
        found = []
        for value in texts:
            counts = trigrams(value.as_py()) if names else None
            shares = {} if counts is None else {names[k]: s for k, s in mixture(counts, log_table, penalty).items()}
            found.append(min(shares, key=lambda name: (-shares[name], name), default=NONE))
        return pa.array(found, pa.string())

    return top(text)


def with_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, learned from the labels that ``docs`` holds.

    A text without a letter has none.  If no label is there to learn from, all texts with a letter stay.
    All columns stay, whatever their names; repeated rows and null ids are rows like any other, and an
    empty table gives an empty table.  Texts are not shuffled.
    """
    text = quoted(text_col)
    names, log_table = train(docs, text_col, lang_col)
    if not names:
        return docs.filter(text.rlike(r"\p{L}"))
    return docs.filter(main_language(text, names, log_table) != NONE)


def predict(docs: DataFrame, names: list[str], log_table: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """id, lang_pred, score, languages (map of language to proportion), one row per row of ``docs``.

    lang_pred is the language with the largest proportion (of equal ones the first by name) and
    score its proportion; texts that are null, empty or without a letter, and any text when no
    language was learned, give ``und`` with score 0 and an empty map.
    """
    schema = T.StructType([id_field(docs, id_col), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])

    def batch(columns):
        found = []
        for text in columns[text_col]:
            counts = trigrams(text.as_py()) if names else None
            shares = {} if counts is None else {names[k]: s for k, s in mixture(counts, log_table, penalty).items()}
            top = min(shares, key=lambda name: (-shares[name], name), default=NONE)
            found.append((top, min(1.0, shares.get(top, 0.0)), list(shares.items())))
        yield {id_col: columns[id_col], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
               "languages": pa.array([f[2] for f in found], pa.map_(pa.string(), pa.float64()))}

    return map_texts(docs, [id_col, text_col], schema, batch)
