"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans, which stay.  Nodes of a document's field are its base spans (their
label is observed) and the other words that hold a digit or an at sign.  Neighbouring nodes share a
chain potential; nodes with the same key (the last digits of a number, the local part of an
address) share a skip potential with the base spans of that key, or with its first node if it has none.  Loopy sum-product makes labels consistent
over the document, and words that become likelier personal than not are added.

The factors are trained piecewise: each is a smoothed log-ratio of counts over the whole corpus,
with base spans as labels.  Words that share a key with a base span are left out of the counts of
"other": whether they are personal is what the field has to infer.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import id_field, map_texts

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)                  # the label of all else
LABELS = OTHER + 1
ROUNDS, TOLERANCE, DAMPING = 1000, 1e-4, 0.3    # rounds end at the tolerance; find tells where they do not
SMOOTH = 1.0
AGREE = 20.0                        # pseudo-count of each equal pair of labels on skip edges: copies agree
OBSERVED = 1e6                      # potential of an observed label
TAIL = 7                            # digits that two writings of a number share

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = "()[]{}<>\"'“”«»,;:!?."

Span = tuple[int, int, int]         # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From every at sign back over the local part: linear, however long a run without one is."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The pattern spans in the order of start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Field:
    """The nodes and edges of a document: start, end, feature and observed label (-1: none) of every node."""

    def __init__(self, text: str, base: list[Span]):
        nodes, reached, pending = [], 0, iter([*base, (len(text) + 1, 0, 0)])
        span = next(pending)
        words = [(m.start(), m.end()) for m in self._words(text)]
        for start, end in words:
            while span[0] < end:
                if span[0] >= reached:      # of base spans that overlap the first is the node
                    nodes.append((span[0], span[2], span[1]))
                    reached = span[2]
                span = next(pending)
            if start >= reached:
                left = len(text[start:end]) - len(text[start:end].lstrip(EDGE))
                core = text[start:end].strip(EDGE)
                if core and SIGN.search(core):
                    nodes.append((start + left, start + left + len(core), -1))
        self.nodes = sorted(nodes)
        self.features = [feature(text[s:e]) for s, e, _ in self.nodes]
        self.chain = [i for i in range(1, len(self.nodes))
                      if not text[self.nodes[i - 1][1]:self.nodes[i][0]].strip(EDGE + " \t\n\r\x0b\x0c")]
        self.skip, self.keys = [], [keys(text[s:e]) for s, e, _ in self.nodes]
        hubs: dict[tuple[str, str], dict[int, int]] = {}    # of a key: the first base span of each kind
        first: dict[tuple[str, str], int] = {}
        for i, own in enumerate(self.keys):
            for key in own:
                first.setdefault(key, i)
                if self.nodes[i][2] >= 0:
                    hubs.setdefault(key, {}).setdefault(self.nodes[i][2], i)
        for i, own in enumerate(self.keys):
            for key in own:                 # each occurrence to its hubs: linear in the copies, one step away
                at = hubs[key].values() if key in hubs else [first[key]]
                if self.nodes[i][2] >= 0:
                    at = list(at)[:1]
                self.skip += [(hub, i) for hub in at if hub != i]

    @staticmethod
    def _words(text: str) -> Iterator[re.Match]:
        """Words of the lines that hold a digit or an at sign."""
        at = 0
        while m := SIGN.search(text, at):
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            at = len(text) if end < 0 else end
            yield from WORD.finditer(text, begin, at)


def feature(core: str) -> int:
    """Digits (0 to 20), at sign, number of dots (0, 1 to 2, 3 and more), letters: 252 values."""
    digits = len(NOT_DIGIT.sub("", core))
    dots = core.count(".")
    return ((min(digits, 20) * 2 + ("@" in core)) * 3 + (dots > 0) + (dots > 2)) * 2 + any(map(str.isalpha, core))


def keys(core: str) -> list[tuple[str, str]]:
    if "@" in core:
        return [("@", core.split("@")[0].lower())]
    digits = NOT_DIGIT.sub("", core)
    if core.count(".") == 3:
        return [(".", core)]
    return [("#", digits[-TAIL:])] if len(digits) >= TAIL else []


def count_factors(text: str, base: list[Span], sums: Counter) -> None:
    """Add a document to the counts (factor, feature or first label, label)."""
    field = Field(text, base)
    labelled = {key for own, (_, _, seen) in zip(field.keys, field.nodes) if seen >= 0 for key in own}
    label = [seen if seen >= 0 else -1 if labelled.intersection(own) else OTHER
             for own, (_, _, seen) in zip(field.keys, field.nodes)]
    sums.update(("unary", f, y) for f, y in zip(field.features, label) if y >= 0)
    sums.update(("chain", label[i - 1], label[i]) for i in field.chain if label[i - 1] >= 0 and label[i] >= 0)
    sums.update(("skip", label[i], label[j]) for i, j in field.skip if label[i] >= 0 and label[j] >= 0)


def train(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Log potentials of the three factors, from counts over all of ``docs``."""
    schema = T.StructType([T.StructField("factor", T.StringType()), T.StructField("a", T.IntegerType()),
                           T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])

    def batch(columns):
        sums = Counter()
        for value in columns[text_col]:
            text = value.as_py()
            if text and SIGN.search(text):
                count_factors(text, base_spans(text), sums)
        yield {"factor": [k[0] for k in sums], "a": [k[1] for k in sums], "b": [k[2] for k in sums], "n": list(sums.values())}

    rows = map_texts(docs, [text_col], schema, batch).groupBy("factor", "a", "b").agg(F.sum("n").alias("n")).collect()
    return potentials({(r.factor, r.a, r.b): r.n for r in rows})    # 252 x 5 + 2 x 25 rows at most


def potentials(counts: dict[tuple[str, int, int], int]) -> dict[str, np.ndarray]:
    tables = {"unary": np.full((252, LABELS), SMOOTH), "chain": np.full((LABELS, LABELS), SMOOTH),
              "skip": np.full((LABELS, LABELS), SMOOTH) + AGREE * np.eye(LABELS)}
    for (factor, a, b), n in counts.items():
        tables[factor][a, b] += n
    out = {"unary": np.log(tables["unary"] / tables["unary"].sum(axis=1, keepdims=True))}
    for factor in ("chain", "skip"):
        joint = tables[factor] + tables[factor].T       # both directions: the factor is symmetric
        joint /= joint.sum()
        alone = joint.sum(axis=1)
        out[factor] = np.log(joint) - np.log(np.outer(alone, alone))
    return out


def marginals(field: Field, model: dict[str, np.ndarray]) -> np.ndarray:
    """Beliefs (nodes x labels) by damped loopy sum-product in logarithms, all messages at once.

    ``field.converged`` tells whether the messages settled.
    """
    field.converged = True
    unary = model["unary"][field.features]
    seen = np.array([s for _, _, s in field.nodes])
    unary[seen >= 0] = -OBSERVED
    unary[seen >= 0, seen[seen >= 0]] = 0
    pairs = [(i - 1, i) for i in field.chain] + field.skip
    if not pairs:
        return _normal(unary)
    a, b = np.array(pairs).T
    kinds = np.array([0] * len(field.chain) + [1] * len(field.skip))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    factor = np.stack([model["chain"], model["skip"]])[np.concatenate([kinds, kinds])]
    n = len(pairs)
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    messages = np.zeros((2 * n, LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        inner = (belief[source] - messages[back])[:, :, None] + factor
        top = inner.max(axis=1)
        new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
        new = DAMPING * messages + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
        moved, messages = np.abs(new - messages).max(), new
        if moved < TOLERANCE:
            break
    else:
        field.converged = False
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return _normal(belief)


def _normal(log_weights: np.ndarray) -> np.ndarray:
    weights = np.exp(log_weights - log_weights.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], model: dict[str, np.ndarray]) -> list[Span]:
    """Words that are likelier of one kind than of all other labels together."""
    return infer(text, base, model)[0]


def infer(text: str, base: list[Span], model: dict[str, np.ndarray]) -> tuple[list[Span], bool]:
    """The added spans, and whether the messages settled."""
    field = Field(text, base)
    if all(seen >= 0 for _, _, seen in field.nodes):
        return [], True
    beliefs = marginals(field, model)
    return [(start, int(row.argmax()), end) for (start, end, seen), row in zip(field.nodes, beliefs)
            if seen < 0 and row.argmax() != OTHER and row.max() > 0.5], field.converged


def find(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and all: arrays of (kind, start, end), and converged, one row per row of ``docs``.

    Offsets are code points, ends exclusive, in the order of start, then kind.  A null text counts as
    empty and has no spans.  Repeated rows give a row each; an empty table an empty table.
    converged is false where the messages of a document still moved after ``ROUNDS`` rounds.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([id_field(docs, id_col), T.StructField("base", span), T.StructField("all", span),
                           T.StructField("converged", T.BooleanType())])
    named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def batch(columns):
        base, both, settled = [], [], []
        for value in columns[text_col]:
            text = value.as_py() or ""
            own = base_spans(text) if SIGN.search(text) else []
            more, done = infer(text, own, model) if SIGN.search(text) else ([], True)
            base.append(named(own))
            both.append(named(sorted({*own, *more})))
            settled.append(done)
        yield {id_col: columns[id_col], "base": base, "all": both, "converged": settled}

    return map_texts(docs, [id_col, text_col], schema, batch)
