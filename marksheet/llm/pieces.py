"""SentencePiece encoding with merge-type vocabularies, and decoding.

A text is normalised as its model says and starts as single characters.  An agenda holds all
adjacent pairs whose concatenation is a piece, ordered by score and then from the left; the best
pair is merged, its neighbours form new pairs, and entries whose symbols have changed meanwhile are
passed over.  Characters that no piece covers become their bytes.  No merge crosses a place whose
two characters stand together in no piece, so a text is cut there and equal parts are merged once
for each worker.  Every Arrow batch is encoded by the library as well, and each row tells whether
both agree.
"""
from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import id_field, map_texts

BLANK = "▁"        # what a space is in a piece
SHORT = 64              # longer parts are cut at every safe place and not remembered
REMEMBERED = 1 << 18    # words, and parts of words, whose ids a worker holds at a time
NEVER = 1 << 62
OUT = 1 << 19           # ids in one Arrow batch, about
LETTER = re.compile(r"[^\W\d_]")
_LATER = 40             # bits for a position in an agenda entry


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's processor of a model file; once for each Python worker."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Agenda:
    """The merges of one vocabulary."""

    def __init__(self, path: str):
        model = self.model = processor(path)
        ids = range(model.get_piece_size())
        if any(map(model.is_unused, ids)):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
        self.ids = {model.id_to_piece(i): i for i in ids if not special[i]}
        scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        rank = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: rank[score] << _LATER for piece, score in scores.items() if len(piece) > 1}
        self.packed = {piece: np.int32(i).tobytes() for piece, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(model.is_byte, ids)) else None
        self.unknown = model.unk_id()
        self.together = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        # A part is blanks and a run of letters, or blanks and a run of other characters.  It ends where
        # pieces do: before a blank, and between letters and others that no piece has next to a letter.
        apart = all(pair[1] != BLANK or pair[0] == BLANK for pair in self.together)
        # The few letters that do stand next to another character in some piece hold their surroundings together.
        glue = {c for x, y in self.together for c, other in ((x, y), (y, x))
                if LETTER.match(c) and other != BLANK and not LETTER.match(other)}
        glued = "".join(map(re.escape, sorted(glue)))
        alone = f"(?![{glued}])" if glue else ""
        self.parts = re.compile(f"{BLANK}*(?:[^\\W\\d_{glued}]++{alone}|(?:[^\\w{BLANK}]|[\\d_])++{alone}|[^{BLANK}]+)|{BLANK}+"
                                if apart else r"(?s).+")
        self.fill = "\n" if apart else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.unchecked: list[tuple[str, bytes]] = []

    def _merged(self, text: str) -> list[str]:
        """The symbols of a text after all merges, the agenda a heap with entries that may be outdated."""
        ranks, n, low = self.ranks, len(text), (1 << _LATER) - 1
        end = array("q", range(1, n + 1))       # where the symbol that starts here ends; 0: it was taken in
        start = array("q", range(-1, n - 1))    # where the symbol before this one starts
        agenda = [ranks[pair] | i for i in range(n - 1) if (pair := text[i:i + 2]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            at = entry & low
            middle = end[at]
            if not middle or middle >= n:
                continue
            stop = end[middle]
            if ranks.get(text[at:stop], -1) != entry - at:
                continue    # one of the two has grown since
            end[at], end[middle] = stop, 0
            if stop < n:
                start[stop] = at
                if (rank := ranks.get(text[at:end[stop]])) is not None:
                    heapq.heappush(agenda, rank | at)
            if (before := start[at]) >= 0 and (rank := ranks.get(text[before:stop])) is not None:
                heapq.heappush(agenda, rank | before)
        found, at = [], 0
        while at < n:
            found.append(text[at:end[at]])
            at = end[at]
        return found

    def _merged_short(self, text: str) -> list[str]:
        """The same with an agenda that is a plain list of the ranks of all neighbours."""
        ranks, symbols = self.ranks.get, list(text)
        agenda = [ranks(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            at = agenda.index(best)         # of equal ones the first
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = ranks(symbols[at - 1] + symbols[at], NEVER)
            if at < len(agenda):
                agenda[at] = ranks(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def _numbered(self, text: str) -> bytes:
        symbols = self._merged_short(text) if len(text) <= SHORT else self._merged(text)
        return b"".join([self.packed.get(symbol) or self._outside(symbol) for symbol in symbols])

    def _outside(self, symbol: str) -> bytes:
        """The ids of a character that is no piece."""
        return np.array([self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown], np.int32).tobytes()

    def _safe(self, text: str) -> list[str]:
        """The text cut at every place where two characters stand together in no piece."""
        cuts = [0, *(i + 1 for i in range(len(text) - 1) if text[i:i + 2] not in self.together), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _new(self, part: str) -> bytes:
        """The ids of a part that is not known; it is noted for the library."""
        found = self.known.get(part)
        if found is not None:       # it stood in the text before
            return found
        if len(part) > SHORT:
            found = b"".join(map(self._numbered, self._safe(part)))
        else:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[part] = self._numbered(part)
        self.unchecked.append((part, found))
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a blank and what stands up to the next one."""
        found = b"".join(self.known.get(part) or self._new(part) for part in self.parts.findall(BLANK + word))
        if len(word) < SHORT:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, normal: str) -> np.ndarray:
        """The ids of a normalised text."""
        if self.fill and normal[:1] == BLANK != normal[-1] and BLANK + BLANK not in normal:
            words = normal.split(BLANK)
            del words[0]
            found = list(map(self.words.get, words))
            if None in found:
                found = [self._word(word) if ids is None else ids for word, ids in zip(words, found)]
        else:
            found = [self.known.get(part) or self._new(part) for part in self.parts.findall(normal)]
        return self._one_unknown(np.frombuffer(b"".join(found), np.int32))

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """Neighbouring unknown symbols as one, where the vocabulary has no bytes for them."""
        if self.bytes or not len(ids):
            return ids
        return ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]

    def checked(self) -> bool:
        """Whether the library gives the same ids for all parts that were new since the last call, read as one text."""
        parts, self.unchecked = self.unchecked, []
        groups: dict[str, list[tuple[str, bytes]]] = {"": [], "letters": [], "others": [], "alone": []}
        for text, ids in parts:
            if text[0] == BLANK:        # blanks at the end of a text would run into the next part
                groups["alone" if text[-1] == BLANK else ""].append((text, ids))
            elif self.fill and all(map(LETTER.match, text)):
                groups["letters"].append((self.fill + text, self._numbered(self.fill) + ids))
            elif self.fill and not any(map(LETTER.match, text)):
                groups["others"].append(("x" + text, self._numbered("x") + ids))
            else:
                groups["alone"].append((text, ids))
        first = [(BLANK + "x", self._numbered(BLANK + "x"))]
        joined = [*groups[""], *first, *groups["letters"], *first, *groups["others"]]
        return all(self._agrees(*p) for p in [("".join(p for p, _ in joined), b"".join(ids for _, ids in joined)), *groups["alone"]])

    def _agrees(self, text: str, ids: bytes) -> bool:
        """The library puts a blank in front of a text; a part that begins otherwise is left to the check of whole texts."""
        if not text.startswith(BLANK):
            return not text
        found = self.model.encode_as_numpy(text[1:].replace(BLANK, " "))
        # One blank alone is no text to the library.
        return text == BLANK or np.array_equal(self._one_unknown(np.frombuffer(ids, np.int32)), found)


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and agrees, one row per row of ``docs``, without begin or end ids.

    ``agrees`` tells whether the library gives the same ids.  Null and empty texts give an empty
    array, texts of any length are encoded whole, repeated rows and null ids give a row each, an empty
    table an empty one; other columns are ignored, whatever their names.
    """
    schema = T.StructType([id_field(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("agrees", T.BooleanType())])

    def batch(columns):
        library, own = processor(path), agenda(path)
        names, texts, found, held = [], [], [], 0

        def full():
            # New parts are checked together; only if they differ, every text is.
            same = [True] * len(texts)
            if not own.checked():
                same = [library.encode(text) == ids.tolist() for text, ids in zip(texts, found)]
                own.known.clear()
                own.words.clear()
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            return {id_col: pa.array(names, columns[id_col].type), "ids": pa.ListArray.from_arrays(ends, flat), "agrees": same}

        for name, text in zip(columns[id_col], columns[text_col]):
            text = text.as_py() or ""
            ids = own.encode(library.normalize(text))
            names.append(name.as_py())
            texts.append(text)
            found.append(ids)
            held += len(ids)
            if held >= OUT:
                yield full()
                names, texts, found, held = [], [], [], 0
        if names:
            yield full()

    return map_texts(docs, [id_col, text_col], schema, batch)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids (null: null), as the library decodes it."""

    @F.arrow_udf(T.StringType())
    def to_text(column: pa.Array) -> pa.Array:
        known = processor(path)
        return pa.array([None if x.values is None else known.decode(x.values.to_numpy()) for x in column], pa.string())

    return to_text(ids)
