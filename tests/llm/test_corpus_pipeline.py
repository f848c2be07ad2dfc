"""The pipeline against a brute-force version, stage by stage."""
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marksheet.llm import bpe, mix, near, queries
from test_text_operators import RANKS, plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_filtering_stages(stages, sf_dir):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    left = {r.doc_id: r for r in stages["language"].collect()}
    assert len(rows) - len(left) <= 0.02 * len(rows)
    gone = [rows[i]["text"] for i in set(rows) - set(left)]
    assert all(not any(map(str.isalpha, t or "")) or len(t) < 400 for t in gone)
    best = {}
    for i, r in left.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        best[key] = max(best.get(key, -1), i)
    assert {r.doc_id for r in stages["exact_copies"].collect()} == set(best.values())
    prints = {i: plain_fingerprint(left[i].text) for i in best.values()}
    roots = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(r.doc_id for r in stages["near_copies"].collect()) == sorted(set(roots.values()))
    for name in ("language", "exact_copies", "near_copies", "mixture"):
        assert stages[name].columns == list(next(iter(rows.values())))


def test_mixture_and_tokens(stages, spark, sf_dir):
    copies = {r.doc_id: r.copies for r in mix.mix(stages["near_copies"]).collect() if r.copies}
    taken = {r.doc_id: r["count"] for r in stages["mixture"].groupBy("doc_id").count().collect()}
    assert taken == copies
    encoder = bpe.encoder(*RANKS)
    n = {r.doc_id: len(encoder.encode_ordinary(r.text)) for r in stages["mixture"].collect()}
    assert {r.doc_id: r.n_tokens for r in stages["tokens"].collect()} == n
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(whole.collect()) == sorted(stages["tokens"].collect())
