"""Passages that repeat across documents, by content-defined chunks.

A gear rolling hash over the ``REACH`` bytes before a word tells where a text is cut: at the words whose
hash is the least among the ``BESIDE`` words on either side.  A cut depends on these few words only, so an
insertion moves the cuts around it alone, and a passage has the same inner chunks wherever it stands.
From every cut on, the chunks that hold ``SPAN`` words together are a window with one digest, so that a
shared window is a common stretch of text and no chance meeting of short phrases.  Windows that several
documents hold are found by digest; runs of overlapping shared windows are repeated passages.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import Scratch, free_prefix, id_field, map_texts, quoted

REACH = 8                   # bytes before a word that its hash depends on
BESIDE = 2                  # words on either side that a cut's hash is compared with; one word in five is a cut
MOST = 24                   # words of a chunk
PASSAGE = 50                # words: a run that cannot belong to a shared passage this long does not count
SPAN = 16                   # words of a window, at least
WORDS = 24                  # of a run; a passage loses a few words at either end, to its first and last cuts
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where a word begins that has something before it."""
    space = SPACE[data]
    return np.flatnonzero(~space[1:] & space[:-1]) + 1


def gear_hash(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rolling hash of the REACH bytes before each of ``ends`` (fewer at the start of a text)."""
    hashes = np.zeros(len(ends), np.uint32)
    for back in range(REACH):
        at = ends - 1 - back
        hashes += np.where(at >= 0, GEAR[data[np.maximum(at, 0)]] << np.uint32(back), np.uint32(0))
    return hashes


def least_places(hashes: np.ndarray) -> np.ndarray:
    """Indices of hashes below the BESIDE ones before them and not above the BESIDE ones after them."""
    least = np.ones(len(hashes), bool)
    for step in range(1, BESIDE + 1):
        least[step:] &= hashes[step:] < hashes[:-step]
        least[:-step] &= hashes[:-step] <= hashes[step:]
    return np.flatnonzero(least)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, in bytes: its cuts, and its own end.

    More than MOST words without a cut, as in a text that repeats a few words over and over, are cut at the
    least hash among the later half of the MOST words, of equal ones the last, so that all have one phase.
    """
    starts = word_starts(data)
    hashes = gear_hash(data, starts)
    places = least_places(hashes)
    gaps = np.diff(places, prepend=-1, append=len(starts))
    forced = []
    for i in np.flatnonzero(gaps > MOST).tolist():
        at, stop = (int(places[i - 1]) if i else -1), (int(places[i]) if i < len(places) else len(starts))
        while stop - at > MOST:
            low, high = at + MOST // 2, at + MOST + 1
            at = high - 1 - int(np.argmin(hashes[low:high][::-1]))
            forced.append(at)
    if forced:
        places = np.sort(np.concatenate([places, forced]))
    return [*starts[places].tolist(), len(data)] if len(data) else []


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per cut that SPAN words or more follow: the fewest whole chunks from there on that hold SPAN words.

    id, row, start and end (code points), first_word and end_word (numbers of words), before and after (words
    of the chunks beside the window), digest.  Null and shorter texts have none.  Rows that repeat an id or
    a text have windows of their own; null ids stay null.
    """
    schema = T.StructType([id_field(docs, id_col), *[T.StructField(n, T.LongType()) for n in ("row", "start", "end")],
                           *[T.StructField(n, T.IntegerType()) for n in ("first_word", "end_word", "before", "after")],
                           T.StructField("digest", T.LongType())])

    def batch(columns):
        for name, number, value in zip(columns[id_col], columns["row"], columns[text_col]):
            raw = (value.as_py() or "").encode()
            if not raw:
                continue
            data = np.frombuffer(raw, np.uint8)
            places = np.array([0, *chunk_ends(data)])
            # Words that begin before a place; only the first one may have no white space before it.
            words = np.searchsorted(word_starts(data), places) + (not SPACE[data[0]])
            words[0] = 0
            points = np.concatenate([[0], np.cumsum(np.add.reduceat((data & 0xC0) != 0x80, places[:-1], dtype=np.int64))])
            stop = np.searchsorted(words, words + SPAN)
            first = np.flatnonzero(stop < len(places))
            if not len(first):
                continue
            stop = stop[first]
            digests = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(places[first].tolist(), places[stop].tolist())], np.uint64)
            yield {id_col: pa.array([name.as_py()] * len(first), columns[id_col].type), "row": np.full(len(first), number.as_py()),
                   "start": points[first], "end": points[stop], "first_word": words[first], "end_word": words[stop],
                   "before": words[first] - words[np.maximum(first - 1, 0)],
                   "after": words[np.minimum(stop + 1, len(words) - 1)] - words[stop], "digest": digests.view(np.int64)}

    numbered = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("row"))
    return map_texts(numbered, [id_col, "row", text_col], schema, batch)


def _stretches(partition: list[str], name: str, held: DataFrame) -> DataFrame:
    """Number, as ``name``, the stretches of windows that overlap or touch."""
    ordered = Window.partitionBy(*partition).orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = held.withColumn("_begins", F.when(F.col("start") <= reached, 0).otherwise(1))
    return begins.withColumn(name, F.sum("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, start, end, n_words, run_words, n_copies, first_id, kept: passages that other rows hold too.

    Offsets are code points, ends exclusive.  A run of shared windows counts from ``words`` words on, unless it
    is certain to lie in no shared passage of PASSAGE words: such a passage ends within the chunks beside the
    run or so few words beyond them that their cuts could differ.  A run is given in pieces: windows whose
    first holder is this row (kept) and those to remove.  The first holder is the row with the smallest
    id, then the first row.  Pieces of one kind do not overlap; where a kept piece and one to remove do, the common
    part is to be removed, which always leaves the copy of a row before.  Rows that repeat an id and text repeat
    all of its passages.  Null, empty and unshared texts give no rows; a passage that repeats within one
    document only is not reported.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(windows(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "windows")
    shared = scratch.keep(found.groupBy("digest").agg(
        F.min(F.struct("id", "row")).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"),
        F.count(F.lit(1)).alias("n_copies")).filter("low < high").select("digest", "first", "n_copies"), "shared")
    held = found.join(shared, "digest").select(
        "id", "row", "start", "end", "first_word", "end_word", "before", "after", "n_copies",
        F.col("first.id").alias("first_id"), (F.col("first.row") == F.col("row")).alias("kept"))
    placed = _stretches(["row", "kept"], "piece", _stretches(["row"], "run", held))
    pieces = placed.groupBy("row", "run", "kept", "piece", "id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_word").alias("first_word"),
        F.max("end_word").alias("end_word"), F.min_by("before", "start").alias("before"),
        F.max_by("after", "end").alias("after"), F.min("n_copies").alias("n_copies"), F.min("first_id").alias("first_id"))
    of_run = Window.partitionBy("row", "run")
    whole = pieces.withColumns({
        "run_words": F.max("end_word").over(of_run) - F.min("first_word").over(of_run),
        "beside": F.min_by("before", "start").over(of_run) + F.max_by("after", "end").over(of_run)})
    scratch.only(found, shared)
    reaching = F.col("run_words") + F.col("beside") + F.lit(2 * BESIDE + REACH) >= PASSAGE
    return whole.filter((F.col("run_words") >= words) & reaching).select(
        F.col("id").alias(id_col), "start", "end", (F.col("end_word") - F.col("first_word")).cast("long").alias("n_words"),
        F.col("run_words").cast("long").alias("run_words"), "n_copies", "first_id", "kept")


def strip_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages that are not kept cut out of their texts, all columns as they are.

    Ids must be unique; more than one row with one id is an error.  Null ids and texts stay as they are.
    """
    prefix = free_prefix(docs)
    cuts = F.sort_array(F.collect_list(F.struct("start", "end"))).alias(f"{prefix}_cuts")
    spans = passages.filter("NOT kept").groupBy(F.col(id_col).alias(f"{prefix}_id")).agg(cuts)
    ids = docs.filter(quoted(id_col).isNotNull()).groupBy(quoted(id_col)).agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1").isEmpty():
        raise ValueError(f"{id_col} is not unique")

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), cuts.to_pylist()):
            for span in reversed(own or [] if text else []):
                text = text[:span["start"]] + text[span["end"]:]
            out.append(text)
        return pa.array(out, pa.string())

    joined = docs.join(spans, quoted(id_col) == F.col(f"{prefix}_id"), "left")
    cleaned = cut(quoted(text_col), F.col(f"{prefix}_cuts")).alias(text_col)
    return joined.select(*[cleaned if c == text_col else quoted(c) for c in docs.columns])
