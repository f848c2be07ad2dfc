"""The text operators against SQL, brute force and round trips, on a small table and on awkward rows."""
import collections
import itertools
import glob
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from marksheet.llm import bpe, components, exact, gru, langid, lm, mix, near, passages, pii, queries, ranking, rules
from marksheet.llm.common import BATCH, Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, fp string, n string"


@pytest.fixture(scope="module")
def rows(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a long text, equal texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} and the {i}." for i in range(60_000))
    texts = [None, "", " \t\n", "Same text here, twice over and again.", "same TEXT here, twice over and again.", long,
             "Ö ß 你好 \U0001f600 x", "+1 (412) 555-2485 a.b@c.de 10.0.0.1", "aaaa" * 50_000, " " * 5_000 + "x", "the the"]
    data = [(i, t, ["en", None, "de"][i % 3], ["b", None, "a"][i % 3], None, 1, "k", "f", None) for i, t in enumerate(texts)]
    data += [data[3], data[3], (None, "Some text without an id.", "en", "b", 3, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


OPERATORS = {
    "rules": lambda d: rules.clean(d),
    "mix": lambda d: mix.mix(d),
    "mixed": lambda d: mix.mixed(d),
    "bpe": lambda d: queries.bpe_digests(bpe.encode(d, *RANKS), RANKS[0]),
    "pii": lambda d: pii.find(d, pii.train(d)),
    "langid": lambda d: langid.predict(d, *langid.train(d)),
    "lm": lambda d: _lm(d),
    "passages": lambda d: passages.repeated_passages(d),
    "near": lambda d: near.near_duplicates(d),
    "drop_near": lambda d: near.drop_near_duplicates(d),
    "ranking": lambda d: ranking.rank(d, ranking.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "exact": lambda d: exact.mark_copies(d),
    "drop_exact": lambda d: exact.drop_copies(d),
}
FILTERING = {"passages", "mixed", "drop_near", "drop_exact"}


def _lm(docs, learned=None):
    scratch = Scratch(docs.sparkSession)
    learned = docs if learned is None else learned
    vocabulary = lm.count_words(learned, scratch)
    return lm.score(docs, vocabulary, lm.train(learned, vocabulary), scratch)


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    found = OPERATORS[name](awkward).collect()
    if name not in FILTERING:
        assert len(found) == 14


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(awkward, name):
    assert OPERATORS[name](awkward.limit(0)).collect() == []


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_sql(spark, sf_dir, key):
    assert compare.differences(queries.QUERIES[key](spark, sf_dir), compare.connect(sf_dir), queries.ORACLE[key]) == []


# ---- rules

def test_line_rules_name_what_failed():
    failed = lambda line: rules.LineRules().failed(line, line.encode().split())
    assert failed("Home | News | Sport | About us") == "navigation"
    assert failed("Buy$$$ it&&& now###") == "symbols"
    assert failed("All rights reserved.") == "boilerplate"
    assert failed("THIS IS A LINE OF SHOUTED WORDS") == "punctuation"
    assert failed("go go go go now now now now") == "repetition"
    assert failed("A plain sentence, with a comma and an end.") is None


def test_repeated_words_by_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(50):
        words = [b"ab"[i:i + 1] for i in draw.integers(0, 2, draw.integers(0, 40))]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert rules.repeated_words(words) == len(twice)


def test_clean_removes_lines_and_rejects(spark):
    good = "A plain sentence of some length, with an end, and yet another few words."
    docs = spark.createDataFrame([(1, f"{good}\nHome | News | Sport"), (2, f"{good}\n" + " ".join(f"buy{i}$$$ now{i}###" for i in range(20))), (3, "Short.")],
                                 "doc_id long, text string")
    found = {r.doc_id: r for r in rules.clean(docs).collect()}
    assert found[1].clean_text == good and found[1].kept and found[1].n_removed == 1
    assert not found[2].kept and not found[2].base_failed
    assert found[3].base_failed and not found[3].kept


# ---- mix

def test_mix_reaches_its_targets(spark):
    data = [(i, "w " * (1 + i % 50), f"s{i % 7}") for i in range(3000)] + [(9999, "w " * 40, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    found = mix.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in found)
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert r.taken <= 3 * r["size"]
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
        assert v[0].target <= 3 * v[0].source_size
    assert sorted(mix.mix(docs).collect()) == sorted(mix.mix(docs.repartition(5)).collect())
    copies = {r.doc_id: r["count"] for r in mix.mixed(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in found if r.copies}


def test_limited_targets_share_the_excess_by_weight(spark):
    sources = spark.createDataFrame([(False, "a", 100), (False, "b", 10), (False, "c", 20), (True, "", 70)],
                                    "missing boolean, source string, source_size long")
    found = {r.source: r.target for r in mix.targets(sources, Scratch(spark)).collect()}
    # Weights 1, 2, 3, 1 of 200: b and c stop at 30 and 60; the other 110 go to a and null alike.
    assert found == {"a": 55.0, "b": 30.0, "c": 60.0, "": 55.0}


def test_heavy_documents_come_first_more_often(spark):
    docs = spark.createDataFrame([(i, "plain words here" if i % 2 else "## $$ %%", "s" + str(i % 3)) for i in range(2000)],
                                 "doc_id long, text string, source string")
    found = mix.mix(docs).join(docs, "doc_id").groupBy("text").agg(F.avg("copies").alias("c")).collect()
    mean = {r.text: r.c for r in found}
    assert mean["plain words here"] > mean["## $$ %%"]


# ---- byte BPE

def test_bpe_equals_the_library(spark, awkward, rows):
    encoder = bpe.encoder(*RANKS)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    for frame in (docs, awkward.filter("doc_id IS NOT NULL").select("doc_id", "text").distinct()):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        encoded = bpe.encode(frame, *RANKS)
        for r in encoded.withColumn("raw", bpe.decode(F.col("ids"), RANKS[0])).collect():
            assert list(r.ids) == encoder.encode_ordinary(texts[r.doc_id])
            assert bytes(r.raw) == texts[r.doc_id].encode()


def test_workers_get_texts_and_ids_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text"))

    def texts(batches):
        for part in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([part.nbytes], pa.int64())})

    @F.arrow_udf("long")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array([column.nbytes] * len(column), pa.int64())

    for stage in (lambda: bpe.encode(docs, *RANKS), lambda: corpus_pipeline.tokens(spark, docs, ""),
                  lambda: corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage()
        sizes = [r.size for r in docs.mapInArrow(texts, "size long").collect()]
        assert sum(sizes) > 15e6 and max(sizes) < 1.1 * BATCH
    encoded = bpe.encode(docs, *RANKS)
    most = encoded.select(ids("ids").alias("n"), F.size("ids").alias("size")).agg(F.max("n"), F.sum("size")).first()
    assert 4 * most[1] > 10e6 and most[0] < 1.1 * BATCH


def test_blocks_of_long_texts_have_the_tokens_of_the_whole():
    draw = np.random.default_rng(0)
    encoder = tiktoken.Encoding("t", pat_str=RANKS[1], mergeable_ranks=dict(bpe.encoder(*RANKS)._mergeable_ranks), special_tokens={})
    alphabet = list("ab1'sé  \n\t.!你 -") + ["'ll", "  ", "\n\n"]
    for _ in range(200):
        text = "".join(draw.choice(alphabet, 300))
        parts = list(bpe.blocks(text, 20))
        assert "".join(parts) == text
        assert sum((encoder.encode_ordinary(p) for p in parts), []) == encoder.encode_ordinary(text)


# ---- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0,
                  "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_by_plain_patterns(rows):
    draw = np.random.default_rng(5)
    pieces = list("0123456789.+-@ ab()") + ["a@b.c", "@x.y", "10.0.0.1", "4485275742308327", "+1 412 555 2485", "é", "256."]
    texts = [r["text"] for r in rows] + ["".join(draw.choice(pieces, draw.integers(1, 60))) for _ in range(2000)]
    for text in texts:
        assert pii.base_spans(text or "") == plain_spans(text or "")


def test_field_adds_copies_and_keeps_base():
    train = ["call +1 412 555 2485 now", "mail ann.lee@mail.org or 10.1.2.3", "pay 4485275742308327 in 2020", "see 12 and 3"] * 50
    sums = collections.Counter()
    for text in train:
        pii.count_factors(text, pii.base_spans(text), sums)
    model = pii.potentials(sums)
    text = "pay 4485275742308327 and then 4485 2757 4230 8327, +1 412 555 2485 4556737586899855 end 12"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, model)
    assert (text.index("4556737586899855"), 2, text.index("4556737586899855") + 16) in added
    assert not set(base) & set(added) and all(text[s:e] != "12" for s, _, e in added)
    far = "mail ann.lee@mail.org " + "word " * 200 + "ann.lee@mail"          # a distant copy without a domain's end
    assert (far.index("ann.lee@mail", 30), 0, len(far)) in pii.added_spans(far, pii.base_spans(far), model)


def test_marginals_by_enumeration():
    field = pii.Field("a@b.cd 11 22 33", pii.base_spans("a@b.cd 11 22 33"))
    draw = np.random.default_rng(1)
    pair = draw.normal(size=(5, 5))
    model = {"unary": draw.normal(size=(252, 5)), "chain": pair + pair.T, "skip": pair + pair.T}
    weights = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        if labels[0] == 0:                                      # observed
            total = sum(model["unary"][f, y] for f, y in zip(field.features[1:], labels[1:]))
            w = np.exp(total + sum(model["chain"][labels[i - 1], labels[i]] for i in field.chain))
            for i, y in enumerate(labels):
                weights[i, y] += w
    assert np.allclose(pii.marginals(field, model), weights / weights.sum(axis=1, keepdims=True), atol=1e-3)


# ---- language

def test_language_on_held_out_documents(spark, rows, sf_dir):
    found = queries.language_mixture(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_mixtures_are_told_apart(spark, rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r["text"])
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    names, table = langid.train(docs)
    both = max(by["en"], key=len)[:6000] + " " + max(by["de"], key=len)[:3000]
    shares = {names[k]: s for k, s in langid.mixture(langid.trigrams(both), table).items()}
    assert set(shares) == {"en", "de"} and shares["en"] == pytest.approx(2 / 3, abs=0.12)
    assert set(langid.mixture(langid.trigrams(max(by["fr"], key=len)), table)) == {names.index("fr")}
    assert langid.trigrams(None) is None and langid.trigrams("12 !?") is None


def test_language_sets_by_all_subsets(rows):
    """Documents of one, two and three languages: the set found is the best of all subsets by penalised likelihood."""
    by = collections.defaultdict(list)
    for r in rows:
        if r["lang"] and langid.trigrams(r["text"]) is not None:
            by[r["lang"]].append(r["text"])
    names = sorted(by)
    table = np.stack([1.0 + sum(langid.trigrams(t) for t in by[n][:40]) for n in names])
    log_table = np.log(table / table.sum(axis=1, keepdims=True))

    def best_subset(counts):
        bins = np.flatnonzero(counts)
        n, logs = counts[bins].astype(float), log_table[:, bins]
        likelihood, price = np.exp(logs - logs.max(axis=0)).T, langid.PENALTY * np.log1p(counts.sum())
        subsets = [list(c) for k in range(1, len(names) + 1) for c in itertools.combinations(range(len(names)), k)]
        return set(max(subsets, key=lambda c: langid.proportions(likelihood[:, c], n)[1] - price * (len(c) - 1)))

    draw = np.random.default_rng(0)
    sizes = collections.Counter()
    for i in range(45):
        chosen = draw.choice(len(names), min(1 + i // 15, len(names)), False)
        text = " ".join(by[names[k]][-1 - i % len(by[names[k]])][:int(draw.integers(80, 1500))] for k in chosen)
        found = langid.mixture(langid.trigrams(text), log_table)
        assert set(found) == best_subset(langid.trigrams(text)) and sum(found.values()) == pytest.approx(1)
        sizes[len(found)] += 1
    assert sizes[1] >= 10 and sizes[2] >= 5 and sizes[3] >= 5


# ---- language model

def test_base_scores_by_brute_force(spark, rows, sf_dir):
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = collections.Counter(w for r in learned for w in split(r["text"]))
    n, size = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in queries.recurrent_scores(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        own, got = split(r["text"]), found[r["doc_id"]]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + size + 1)) for w in own))
        assert got.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_come_by_the_join(spark, rows, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows[:60]], "doc_id long, text string")
    whole = {r.doc_id: r for r in _lm(docs).collect()}
    monkeypatch.setattr(lm, "COMMON", 600)          # the head stays, most other words leave the common table
    for r in _lm(docs).collect():
        assert (r.n_known, r.n_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].n_tokens)
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_model_is_a_distribution_and_state_is_carried():
    draw = np.random.default_rng(2)
    flat = gru.start(draw.integers(1, 90, gru.HEAD + 1).astype(float))
    prefix = draw.integers(0, gru.HEAD, 40).astype(np.int32)
    ends = [np.append(prefix, np.int32(t)) for t in range(gru.HEAD + 1)]
    given = gru.score(flat, ends, 0) - gru.score(flat, [prefix], 0)
    assert np.exp(given).sum() == pytest.approx(1, abs=1e-3)
    documents = [draw.integers(0, gru.HEAD + 1, n).astype(np.int32) for n in (1, 700, 33, 32, 2)]
    alone = [gru.score(flat, [d], 0)[0] for d in documents]
    assert np.allclose(gru.score(flat, documents, 0), alone, rtol=1e-4)


def test_gradients_by_differences():
    draw = np.random.default_rng(1)
    flat = gru.start(draw.integers(1, 100, gru.HEAD + 1).astype(float)).astype(np.float64)
    documents = [draw.integers(0, gru.HEAD + 1, n).astype(np.int32) for n in (7, 5, 3)]

    def loss(at):
        p, grad = gru.views(at), np.zeros_like(at)
        lanes = gru.Lanes.of(documents, 0, 2, 4)
        state, saved, states, real = np.zeros((gru.HIDDEN, lanes.inputs.shape[1])), [], [], lanes.owner >= 0
        for x, new in zip(gru.gate_inputs(p, lanes.inputs), lanes.first):
            state, kept = gru.step(p, state * ~new, x)
            saved.append(kept)
            states.append(state)
        states = np.stack(states, axis=1)
        logs, own = gru.log_probs(p, states[:, real], lanes.targets[real], gru.views(grad))
        down = np.zeros_like(states)
        down[:, real] = own
        gru.backward(p, gru.views(grad), saved, lanes.inputs, lanes.first, down.transpose(1, 0, 2))
        return -logs.sum(), grad

    grad = loss(flat)[1]
    for i in draw.choice(np.flatnonzero(grad), 40):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert (loss(flat + step)[0] - loss(flat - step)[0]) / 2e-5 == pytest.approx(grad[i], abs=1e-4)


# ---- passages

def test_passages_by_brute_force(spark, rows, sf_dir):
    where = collections.defaultdict(set)
    split = {r["doc_id"]: (r["text"] or "").split() for r in rows}
    holders = {n: set() for n in (50, 20)}
    for n in holders:
        where.clear()
        for i, words in split.items():
            for at in range(len(words) - n + 1):
                where[xxhash.xxh64_intdigest(" ".join(words[at:at + n]))].add(i)
        holders[n] = set().union(*[v for v in where.values() if len(v) > 1])
    found = queries.repeated_passages(spark, sf_dir).collect()
    flagged = {r.doc_id for r in found}
    assert holders[50] <= flagged <= holders[20]
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in found:
        if not r.kept:
            assert r.first_id != r.doc_id and len(text[r.doc_id][r.start:r.end].split()) >= r.n_words - 1


def test_chunks_cover_texts_and_resist_insertions():
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("abcdeé"), 5)) for _ in range(400)]
    text = " ".join(draw.choice(words, 3000))
    cuts = lambda t: {t.encode()[a:b] for a, b in zip([0, *e], e)} if (
        e := passages.chunk_ends(np.frombuffer(t.encode(), np.uint8))) else set()
    assert len(cuts(text) - cuts("a few words more " + text[:5000] + " inserted " + text[5000:])) < 10
    for sample in ("x", "é" * 1000, text, "Of " * 500, "ab"):
        data = sample.encode()
        ends = passages.chunk_ends(np.frombuffer(data, np.uint8))
        parts = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
        assert ends == sorted(set(ends)) and "".join(parts) == sample and max(len(p.split()) for p in parts) <= passages.MOST


def test_a_text_of_a_few_repeated_words_is_cut_in_one_phase():
    for period in (["the"], ["a", "bb"], ["x", "yy", "x", "zz"], ["same"] * 7 + ["other"]):
        cuts = lambda words: {d.encode()[a:b] for d in [" ".join(words)] for e in [
            passages.chunk_ends(np.frombuffer(d.encode(), np.uint8))] for a, b in zip([0, *e], e)}
        assert len(cuts(["Lead", "in"] + period * 300) - cuts(period * 500)) <= 4


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 4), (3, 8)])
def test_every_passage_of_51_words_is_found(spark, low, high):
    """400 passages, each in two documents, in words of one letter, too; documents that share 20 words are left alone."""
    draw = np.random.default_rng(low + 10 * high)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    prose = lambda n: " ".join("".join(draw.choice(letters, draw.integers(low, high + 1))) for _ in range(n))
    rows = []
    for k in range(420):
        shared = prose(51 if k < 400 else 20)
        rows += [(2 * k + i, f"{prose(draw.integers(0, 40))} {shared} {prose(draw.integers(0, 40))}".strip()) for i in (0, 1)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(800))
    text = dict(rows)
    for r in found:
        assert text[r.doc_id][r.start:r.end] in text[r.doc_id ^ 1] and len(text[r.doc_id][r.start:r.end].split()) == r.n_words


def test_windows_by_brute_force(spark):
    draw = np.random.default_rng(8)
    pick = ["é", "Ab", "你好", "\U0001f600", "x" * 300, " ", "\n", "\t\r", "  ", "\u00a0"]
    texts = ["".join(draw.choice(pick, draw.integers(0, 120))) for _ in range(300)] + [None, "", " ", "x", " x", "x " * 100, "x " * 16]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = collections.defaultdict(list)
    for r in passages.windows(docs).collect():
        of[r.doc_id].append((r.start, r.end, r.first_word, r.end_word, r.before, r.after))
    count = lambda t: len(t.encode().split())
    for i, text in enumerate(texts):
        data = (text or "").encode()
        cuts = [len(data[:e].decode()) for e in [0, *passages.chunk_ends(np.frombuffer(data, np.uint8))]]
        expected = []
        for k, start in enumerate(cuts):
            for j in range(k + 1, len(cuts)):
                if count(text[start:cuts[j]]) >= passages.SPAN:
                    beside = count(text[cuts[k - 1]:start]) if k else 0, count(text[cuts[j]:cuts[j + 1]]) if j + 1 < len(cuts) else 0
                    expected.append((start, cuts[j], count(text[:start]), count(text[:cuts[j]]), *beside))
                    break
        assert sorted(of[i]) == expected


def test_of_every_passage_one_copy_stays(spark):
    draw = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(draw.choice(list("abcdefghij"), 6)) for _ in range(n))
    shared = prose(80)
    docs = spark.createDataFrame([(i, f"{prose(30)} {shared} {prose(30)}") for i in range(5)] + [(9, prose(200)), (10, None)],
                                 "doc_id long, text string")
    found = passages.repeated_passages(docs)
    # Besides the passage itself, some of the rows may share the chunk at one of its ends.
    assert {r.doc_id for r in found.collect()} == set(range(5)) and found.filter("kept AND n_words > 40").count() == 1
    stripped = {r.doc_id: r.text for r in passages.strip_passages(docs, found).collect()}
    middle = " ".join(shared.split()[20:60])
    assert sum(middle in (t or "") for t in stripped.values()) == 1 and stripped[10] is None


# ---- SimHash

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_by_brute_force(spark, rows, sf_dir):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_components(prints, linked)
    for r in queries.simhash_pivots(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_links_by_brute_force_in_crowds_of_any_size(spark, crowd):
    draw = np.random.default_rng(7)
    centres = draw.integers(-2**63, 2**63, 12)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            flips = sum(1 << int(b) for b in draw.choice(63, draw.integers(1, 6), replace=False))
            prints.add(int(c) ^ flips)
    scratch, counts = Scratch(spark), []
    found = near.links(spark.createDataFrame([(p,) for p in prints], "fp long"), scratch, crowd, counts)
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
    # The tables discard pairs that share a key, and refining a crowd leaves fewer to look at.
    assert all(links <= left <= met for met, left, links in counts) and len(counts) == (1 if crowd == 1000 else 3)
    met, left = (sum(c[k] for c in counts) for k in (0, 1))
    assert left < met and left <= 3 * sum(c[2] for c in counts)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (41, 42), (42, 41)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 41: 41, 42: 41}


# ---- ranking

def test_quality_of_held_out_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    found = [r for r in queries.pairwise_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert found and np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_fit_prefers_the_better_of_a_pair():
    draw = np.random.default_rng(8)
    good = draw.random(400) < 0.8
    data = draw.normal(size=(400, len(ranking.FEATURES)))
    data[:, 2] += np.where(good, -2, 2)
    fitted = ranking.fit(data, good)
    assert fitted.weights[2] < 0 and np.mean((fitted.score(data) >= ranking.CUT) == good) > 0.95
    assert (ranking.fit(data, np.ones(400, bool)).score(data) >= ranking.CUT - 1e-12).all()
    assert (ranking.fit(data, np.zeros(400, bool)).score(data) < ranking.CUT).all()


# ---- exact copies

def test_recipes_by_brute_force(spark, awkward):
    texts = collections.defaultdict(list)
    for r in awkward.collect():
        texts[re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")].append(r.doc_id)
    own = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for weak in (F.xxhash64, lambda c: F.length(c).cast("long")):      # with shared digests as well
        for r in exact.mark_copies(awkward, digest=weak).collect():
            ids = own[r.text_sha256]
            keep = max((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep) and r.doc_id in ids


def test_drop_copies_leaves_one_of_each(awkward):
    left = exact.drop_copies(awkward)
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for r in left.collect()]
    assert left.columns == awkward.columns and len(folded) == len(set(folded)) == 10
