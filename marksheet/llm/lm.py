"""Language-model scores of whole documents.

The vocabulary is counted over all training documents.  A gated recurrent model (``gru``) is
trained side by side on their parts and the parameters are averaged, weighted by tokens; words
outside its head share one token, and divide its probability by their smoothed counts.  The counts
of common words travel to the tasks as a table of bounded size (found by a histogram of frequencies); the others meet the vocabulary in
a join, after each document's copies of a word have been merged.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm import gru
from marksheet.llm.common import Scratch, id_field, map_texts

END = b""               # no word is empty
COMMON = 1 << 16        # words whose counts are sent to the tasks, of COMMON_BYTES at most each: 4 MB
COMMON_BYTES = 64
TRAINERS = 4096         # parts that are trained side by side, at most
TRAINER_TOKENS = 1_000_000      # that a part should have, at least
GROUP = 1 << 21         # tokens held as numbers at a time, about


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and the end."""
    return [*text.encode().lower().split(), END] if text else [END]     # both touch ASCII bytes only


@dataclass(frozen=True)
class Vocabulary:
    """Counts over the training documents: ``table`` (word, c) has all words, the rest fits the driver."""

    table: DataFrame
    n: int                      # tokens
    size: int                   # distinct ones
    common: dict[bytes, int]    # the most frequent, in the order of frequency

    @property
    def head(self) -> list[bytes]:
        return list(self.common)[:gru.HEAD]

    @property
    def rest(self) -> int:
        """Sum of c + 1 over the words outside the head, and 1 for an unknown word."""
        own = self.head
        return self.n + self.size - sum(self.common[w] + 1 for w in own) + 1


def count_words(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> Vocabulary:
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])

    def batch(columns):
        sums: Counter = Counter()
        for value in columns[text_col]:
            sums.update(tokens(value.as_py()))
            if len(sums) > COMMON * 8:
                yield {"word": list(sums.keys()), "c": list(sums.values())}
                sums = Counter()
        yield {"word": list(sums.keys()), "c": list(sums.values())}

    table = scratch.keep(map_texts(docs, [text_col], schema, batch).groupBy("word").agg(F.sum("c").alias("c"))
                         .withColumn("step", F.floor(F.log2("c") * 16)), "vocabulary")
    n, size = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The lowest step of frequency from which on there are COMMON words at most.
    short = table.filter(F.length("word") <= COMMON_BYTES)
    steps = short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()   # 1,000 at most
    enough = [r.step for r, sum_ in zip(steps, np.cumsum([r.n for r in steps])) if sum_ <= COMMON]
    top = short.filter(F.col("step") >= enough[-1]).collect() if enough else []
    common = sorted(((bytes(r.word), r.c) for r in top), key=lambda pair: (-pair[1], pair[0]))
    return Vocabulary(table.drop("step"), n, size, dict(common))


def _numbers(text: str | None, ids: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    own = tokens(text)
    return np.fromiter((ids.get(w, gru.HEAD) for w in own), np.int32, len(own)), own


def _first_parameters(vocabulary: Vocabulary) -> np.ndarray:
    counts = np.zeros(gru.HEAD + 1)
    own = [vocabulary.common[w] for w in vocabulary.head]
    counts[:len(own)] = own
    counts[gru.HEAD] = vocabulary.n - sum(own)
    return gru.start(counts)


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> np.ndarray:
    """The averaged parameters after one pass over all of ``docs``."""
    start = _first_parameters(vocabulary)
    ids = {w: i for i, w in enumerate(vocabulary.head)}
    end = ids.get(END, gru.HEAD)

    def run(batches):
        trainer, held, n = gru.Trainer(start), [], 0
        for part in batches:
            for value in part.column(0):
                held.append(_numbers(value.as_py(), ids)[0])
                n += len(held[-1])
                if n >= GROUP:
                    trainer.learn(held, end)
                    held, n = [], 0
        if held:
            trainer.learn(held, end)
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(gru.SIZE, dtype=np.int32)), pa.array(trainer.flat.astype(np.float64) * trainer.tokens),
                pa.array(np.full(gru.SIZE, trainer.tokens, np.int64))], names=["k", "value", "n"])

    parts = int(np.clip(vocabulary.n // TRAINER_TOKENS, 1, TRAINERS))
    sums = docs.select(text_col).coalesce(parts).mapInArrow(run, "k int, value double, n long") \
        .groupBy("k").agg((F.sum("value") / F.sum("n")).alias("value"))
    found = sums.toPandas().sort_values("k")["value"].to_numpy()     # gru.SIZE numbers
    return found.astype(np.float32) if len(found) else start


def score(docs: DataFrame, vocabulary: Vocabulary, parameters: np.ndarray, scratch: Scratch,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``docs``.

    base_score is the smoothed unigram log10 probability, score that of the recurrent model.  Null and
    empty texts have one token, the end.  Without training documents every word is unknown.  Repeated
    rows give a row each; an empty table an empty table.
    """
    common = {w: float(np.log10(c + 1)) for w, c in vocabulary.common.items()}
    ids = {w: i for i, w in enumerate(vocabulary.head)}
    end = ids.get(END, gru.HEAD)
    tail_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))
    schema = T.StructType([id_field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("n_common", T.LongType()),
                           T.StructField("n_rest", T.LongType()), T.StructField("common_log", T.DoubleType()),
                           T.StructField("common_rest_log", T.DoubleType()), T.StructField("model", T.DoubleType()),
                           T.StructField("tail", tail_type)])

    def batch(columns):
        held, rows, n = [], [], 0

        def full():
            logs = gru.score(parameters, held, end) / np.log(10)
            names, *others, tails = zip(*rows)
            out = dict(zip(["n_tokens", "n_common", "n_rest", "common_log", "common_rest_log"], others))
            pairs = pa.StructArray.from_arrays([pa.array([w for t in tails for w, _ in t], pa.binary()),
                                                pa.array([f for t in tails for _, f in t], pa.int64())], ["word", "tf"])
            ends = np.cumsum([0, *map(len, tails)], dtype=np.int32)
            return out | {id_col: pa.array(names, columns[id_col].type), "model": logs,
                          "tail": pa.ListArray.from_arrays(ends, pairs)}

        for name, value in zip(columns[id_col], columns[text_col]):
            numbers, own = _numbers(value.as_py(), ids)
            held.append(numbers)
            n += len(own)
            n_common, common_log, common_rest_log, tail = 0, 0.0, 0.0, []
            for word, tf in Counter(own).items():
                log = common.get(word)
                if log is None:
                    tail.append((word, tf))
                else:
                    n_common += tf
                    common_log += tf * log
                    common_rest_log += 0.0 if word in ids else tf * log
            rows.append((name.as_py(), len(own), n_common, int((numbers == gru.HEAD).sum()), common_log, common_rest_log, tail))
            if n >= GROUP:
                yield full()
                held, rows, n = [], [], 0
        if rows:
            yield full()

    scored = scratch.keep(map_texts(docs, [id_col, text_col], schema, batch)
                          .withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf") \
        .join(vocabulary.table, "word").groupBy("row").agg(
            F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_words = float(np.log10(vocabulary.n + vocabulary.size + 1))
    other_words = float(np.log10(vocabulary.rest))
    return scored.join(rare, "row", "left").select(
        id_col, "n_tokens", (F.col("n_common") + zero("n_rare")).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("common_log") + zero("rare_log") - F.col("n_tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("model") + F.col("common_rest_log") + zero("rare_log") - F.col("n_rest") * F.lit(other_words)).alias("score"))
