"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marksheet.llm.common import id_field, map_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed", "n_lost_words"]
ALONE = re.compile(r"(?<!\S)[|>»›•·/](?!\S)")        # a separator of a navigation bar
SEPARATORS = "|>»›•·/"
STOPS = ".,!?:;…、。！？"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "accept all cookies", "click here", "read more", "sign up", "log in to", "subscribe to", "subscribe now",
    "enable javascript", "licensed under", "released under", "copyright (c)", "back to top", "share on facebook",
    "share on twitter")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule."""

    symbols_per_word: float = 0.5       # of SYMBOLS; more is markup or noise
    navigation_share: float = 0.2       # separators standing alone, per word
    least_navigation: int = 2
    shouted: float = 0.3                # share of words that end in two exclamation marks or more
    capitals: float = 0.7               # share of words in upper case
    stutter: float = 0.5                # share of words equal to the one before
    least_words: int = 6                # for the three shares above
    run_on: int = 100                   # words without any punctuation
    lost_share: float = 0.5             # of the words: a document that loses more goes

    def failed(self, line: str, words: list[bytes]) -> str | None:
        """The first rule that a line with a word fails, or None."""
        n = len(words)
        if sum(map(line.count, SYMBOLS)) > self.symbols_per_word * n:
            return "symbols"
        if any(map(line.__contains__, SEPARATORS)):
            stops = len(ALONE.findall(line))
            if stops >= self.least_navigation and stops > self.navigation_share * n:
                return "navigation"
        low = line.lower()
        if any(map(low.__contains__, BOILERPLATE)):
            return "boilerplate"
        if n >= self.least_words:
            if line.count("!! ") + line.endswith("!!") > self.shouted * n:
                return "punctuation"
            if low != line and sum(map(str.isupper, line.split())) > self.capitals * n:
                return "punctuation"
            if sum(map(eq, words, words[1:])) > self.stutter * n:
                return "repetition"
        if n > self.run_on and not any(map(line.__contains__, STOPS)):
            return "punctuation"
        return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words inside windows of ``window`` words that occur twice or more, the first included.

    Windows with equal sums of word hashes are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for i in range(window):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    maybe = order[np.append(same, False) | np.append(False, same)].tolist()
    if not maybe:
        return 0
    found = [tuple(words[i:i + window]) for i in maybe]
    counts = Counter(found)
    starts = [i for i, w in zip(maybe, found) if counts[w] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts, np.int64) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge(text: str, rules: LineRules) -> tuple[str, list[int]]:
    """The text without its failing lines, and the counts in the order of COUNTS."""
    words, lines, stay, gone, lost = [], [], [], 0, 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            lines.append(line)
            words += own
            if rules.failed(line, own):
                gone += 1
                lost += len(own)
                continue
        stay.append(line)
    space = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return "\n".join(stay), [len(words), len(text) - space, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                             repeated_words(words), len(lines), gone, lost]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: id, clean_text, base counts, base_failed, n_lines, n_removed, n_lost_words, kept.

    kept is false where the base limits fail (fewer than 10 words, more than a fifth of the words in
    repeated windows) or more than ``rules.lost_share`` of the words stood in removed lines.  A null text
    counts as empty: no words, not kept.  Repeated rows give a row each; an empty table an empty table.
    """
    schema = T.StructType([id_field(docs, id_col), T.StructField("clean_text", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def batch(columns):
        out = {f.name: [] for f in schema}
        out[id_col] = columns[id_col]
        for value in columns[text_col]:
            cleaned, counts = judge(value.as_py() or "", rules)
            n_words, n_repeat_words, n_lost_words = counts[0], counts[4], counts[7]
            bad = n_words < 10 or 100 * n_repeat_words > 20 * n_words
            for name, number in zip(COUNTS, counts):
                out[name].append(number)
            out["clean_text"].append(cleaned)
            out["base_failed"].append(bad)
            out["kept"].append(not bad and n_lost_words <= rules.lost_share * n_words)
        yield out

    return map_texts(docs, [id_col, text_col], schema, batch)
