"""Byte-level BPE with a local rank file: encoding, and decoding back to the raw bytes."""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import id_field, map_texts, small_batches

LONG = 1 << 16          # characters; longer texts are encoded block by block
OUT = 1 << 19           # ids in one Arrow batch, about
#: No match of the pattern spans the place between a word character or punctuation and a blank or
#: line break: a match holds white space only at its start, or nothing else.
SAFE = re.compile(r"(?<=[!-~\w])(?=[ \n])")
#: Runs of white space (as Unicode has it) that the pattern's engine would need a deep stack for.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; once for each Python worker."""
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def pieces(path: str) -> np.ndarray:
    """The bytes of every id of a rank file; all that a worker needs to decode."""
    ranks = _ranks(path)
    found = np.empty(max(ranks.values(), default=-1) + 1, object)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def blocks(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of about ``size`` characters whose tokens, joined, are those of the whole."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def to_ids(text: str, known: tiktoken.Encoding) -> list[np.ndarray]:
    """The ids of a text, in parts.

    In a run of white space all but the last character are one match of the pattern, or all at the end
    of the text, so a long run is merged as one piece and never meets the pattern.
    """
    found, at = [], 0
    for run in RUN.finditer(text) if len(text) >= 4096 else ():
        end = run.end() - (run.end() < len(text))
        found += [known.encode_ordinary(part) for part in blocks(text[at:run.start()])]
        found.append(known._core_bpe.encode_single_piece(run[0][:end - run.start()].encode()))
        at = end
    found += [known.encode_ordinary(part) for part in blocks(text[at:])]
    return [np.array(ids, np.int32) for ids in found]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), one row per row of ``docs``, without special tokens.

    Null and empty texts give an empty array, repeated rows and null ids a row each, an empty table an
    empty one; other columns are ignored.  A text of any length is encoded whole; one without a
    safe place to cut goes through the encoder in one piece.  The session's Arrow batches become small
    (``common.small_batches``), those of ``decode`` too.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([id_field(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def batch(columns):
        known = encoder(path, pattern)
        names, found, held = [], [], 0

        def full():
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            return {id_col: pa.array(names, columns[id_col].type), "ids": pa.ListArray.from_arrays(ends, flat)}

        for name, text in zip(columns[id_col], columns[text_col]):
            names.append(name.as_py())
            found.append(np.concatenate(to_ids(text.as_py() or "", known)))
            held += len(found[-1])
            if held >= OUT:
                yield full()
                names, found, held = [], [], 0
        if names:
            yield full()

    return map_texts(docs, [id_col, text_col], schema, batch)


def decode(ids: Column, path: str) -> Column:
    """The raw bytes of an array of ids (null: null).  An id that the rank file lacks is an error."""

    @F.arrow_udf(T.BinaryType())
    def to_bytes(column: pa.Array) -> pa.Array:
        known = pieces(path)
        out = []
        for ids in column:
            values = ids.values
            out.append(None if values is None else b"".join(known[values.to_numpy(zero_copy_only=False)]))
        return pa.array(out, pa.binary())

    return to_bytes(ids)
