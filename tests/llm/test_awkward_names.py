"""Operators and stages on clashing column names, repeated ids, long runs and missing languages: values, not counts."""
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marksheet.llm import bpe, exact, langid, mix, near, passages, pieces, pii, prefixes, queries, ranking, rules
from test_text_operators import RANKS

#: Names that operators use inside.
INNER = ["_w", "_w_id", "_w_sha", "_ww_id", "_w_carry", "_w_row", "_w_cuts", "__w_id", "id", "sha", "fp", "root", "key", "keys", "row", "rows", "text_key",
         "missing", "copies", "n", "at", "level", "component_id", "kept", "keep_id", "recipe", "digest", "chunk", "number", "size", "taken", "target",
         "start", "end", "first", "lang_pred", "score", "languages", "features", "_id", "_good", "_text", "good", "ids", "agrees", "a b.c`d", "_stay_id",
         "_mixed_id", "_copies", "_cuts", "folded", "prob", "block", "conv", "pos", "turn", "node"]
TEXT = "A plain sentence with more than ten words in it, number {}, and an end of its own, which is {}."


def documents(spark, extra=()):
    rows = [(i, TEXT.format(i % 7, "x" * (i % 7)), ["en", "de", None][i % 3], ["b", "a", None][i % 3], 10) for i in range(20)]
    rows += [(3, "Another text under an id that is there before.", "en", "a", 5), (3, TEXT.format(3, "xxx"), "en", "b", 10),
             (None, "No id here, but words enough for a mixture of them.", "en", "a", 5), (21, None, None, None, None), (22, "", "en", "a", 0), (22, "", "en", "a", 0),
             (23, " 12 34 ", "de", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("clash").alias(name) for name in extra]).repartition(3)


def ranked(d):
    return ranking.rank(d, ranking.train(d, d.select("doc_id", (F.length("text") % 2).alias("quality"))))


ROWS = {
    "rules": rules.clean, "mix": mix.mix, "mixed": mix.mixed, "bpe": lambda d: bpe.encode(d, *RANKS), "pii": lambda d: pii.find(d, pii.train(d)),
    "langid": lambda d: langid.predict(d, *langid.train(d)), "with_language": langid.with_language, "near": near.near_duplicates,
    "drop_near": near.drop_near_duplicates, "ranking": ranked, "exact": exact.mark_copies, "drop_exact": exact.drop_copies,
    "passages": passages.repeated_passages, "pieces": lambda d: pieces.encode(d, queries.public_tokenizers.path("piece_bpe_32k.model")),
    **{f"stage_{name}": lambda d, stage=stage: stage(d.sparkSession, d, "") for name, stage in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", ROWS)
def test_other_columns_change_nothing(spark, name):
    plain, clashing = documents(spark), documents(spark, INNER)
    want, got = ROWS[name](plain), ROWS[name](clashing)
    added = [c for c in got.columns if c not in want.columns]
    assert added == (INNER if got.columns[:5] == clashing.columns[:5] else [])
    own = [F.col(c) for c in want.columns]
    key = lambda r: str(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    assert sorted(map(key, got.select(*own).collect())) == sorted(map(key, want.collect()))
    assert not added or all(r["a b.c`d"] == "clash" for r in got.collect())
    assert ROWS[name](clashing.limit(0)).collect() == []


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    same = spark.createDataFrame([(1, "one two three four five"), (1, "One two three four FIVE"), (0, "something else altogether, quite"), (1, None)],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in near.drop_near_duplicates(same).collect()) == [0, 1, 1]
    docs = spark.createDataFrame([(1, "one two three four five six seven eight", "s"), (1, "nine", "s")] + [(i, "w " * 40, "t") for i in range(2, 9)],
                                 "doc_id long, text string, source string")
    taken = {(r.doc_id, r.size): r.taken for r in mix.mix(docs).collect()}
    got = {}
    for r in mix.mixed(docs).collect():
        got[r.doc_id, len(r.text.split())] = got.get((r.doc_id, len(r.text.split())), 0) + len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == got
    twins = spark.createDataFrame([(5, "Same"), (5, "same"), (5, "same"), (4, "SAME"), (6, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.drop_copies(twins).collect()) == [5, 6]
    with pytest.raises(ValueError, match="unique"):
        passages.strip_passages(twins, passages.repeated_passages(twins))


def test_without_labels_every_text_with_a_letter_stays(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.language(spark, docs, "").collect()
    want = [r for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    assert sorted(map(str, left)) == sorted(map(str, want))


@pytest.mark.parametrize("run", [" ", "\t", "\n", "　", " \n\t"])
def test_white_space_of_any_length(run):
    known = bpe.encoder(*RANKS)
    plain = tiktoken.Encoding("plain", pat_str=RANKS[1], mergeable_ranks=bpe._ranks(RANKS[0]), special_tokens={})
    for text in (run * 5000, "a" + run * 5000 + "b", "a" + run * 5000, run * 4096 + "x" + run * 4095 + "'s" + run * 9000 + "  y"):
        assert np.concatenate(bpe.to_ids(text, known)).tolist() == plain.encode_ordinary(text)
    long = "word" + run * (3_000_000 // len(run)) + "word"
    ids = np.concatenate(bpe.to_ids(long, known))
    found = bpe.pieces(RANKS[0])
    assert b"".join(found[ids]) == long.encode()


def test_long_digit_runs_are_no_error():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []
    assert pii.base_spans("9" * 100_000) == []


def test_threshold_covers_all_labelled_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join("plain" if draw.random() < 0.6 else "##" for _ in range(draw.integers(3, 40))), int(draw.random() < 0.4)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(7, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    for sample in (20_000, 60):
        fitted = ranking.train(docs, labels, sample=sample)
        data = np.array([ranking.features(t) for _, t, _ in rows], float)
        assert fitted.mean == pytest.approx(data.mean(0), abs=1e-6) and fitted.scale == pytest.approx(data.std(0) + 1e-6, abs=1e-6)
        share = np.mean([q for *_, q in rows])
        assert fitted.threshold == pytest.approx(np.quantile(fitted.strength(data), 1 - share, method="midpoint"), abs=1e-9)
    values = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 1e-300, 1, 1, 5, -7] * 30], "v double")
    old = ranking.FEW
    try:
        ranking.FEW = 3
        assert [ranking.nth_smallest(values, "v", k) for k in (0, 29, 30, 119, 120, 149, 150, 239)] == [-7, -7, 0, 0, 1e-300, 1e-300, 1, 5]
    finally:
        ranking.FEW = old


def test_conversations_ignore_other_columns(spark):
    rows = [(c, t, "user", f"text {c % 3} {t}") for c in range(12) for t in range(4)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = plain.select("*", *[F.lit("x").alias(name) for name in ("conv", "at", "pos", "block", "t0", "k0", "level", "last", "node", "n_convs")])
    key = lambda df: sorted(map(str, df.drop("node", "parent").collect()))
    assert key(prefixes.prefix_trie(clashing)) == key(prefixes.prefix_trie(plain))
