"""Conversation tries, SentencePiece merges and clustering against plain versions, and on awkward rows."""
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import compare
from marksheet.llm import centroids, pieces, prefixes, queries
from marksheet.llm.common import Scratch

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("key", ["op11_prefix_trie", "op13_pca_centroids"])
def test_matches_sql(spark, sf_dir, key):
    assert compare.differences(queries.QUERIES[key](spark, sf_dir), compare.connect(sf_dir), queries.ORACLE[key]) == []


# ---- conversations

def plain_trie(rows, share=True):
    """Nodes of (conv_id, turn, role, text) rows, keyed by path."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, prefixes_order(digest, text), role or "", text or ""))
    original = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9 if share else 0
        convs[c] = original.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {path: [q for q in members if len(q) == len(path) + 1 and q[:len(path)] == path] for path in members}
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        size = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * size + sum(saved[k] for k in children[path])
        leaves[path] = sum(leaves[k] for k in children[path]) if children[path] else 1
    found = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        found.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path],
                      saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def prefixes_order(digest, text):
    import base64
    return base64.b64encode(digest).decode() + str(len((text or "").encode()))


def trie_rows(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    found = prefixes.prefix_trie(table.repartition(3), **options).drop("node", "parent")
    return sorted((tuple(r) for r in found.collect()), key=str)


def conversations(draw, convs=40, most=20):
    rows = []
    for c in range(convs):
        for t in range(draw.randint(1, most)):
            rows.append((c, t, draw.choice(["user", "bot", None]), draw.choice(["a", "bé", "", None]) if t < 3 else draw.choice("ab")))
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_trie_by_brute_force(spark, hot_rows):
    rows = conversations(random.Random(4))
    rows += [(c, t, "user", "same") for c in (100, 101, 103, 106, 200) for t in range(70)]      # long, shared for long
    rows += [(103, 70, "bot", "more"), (250, 0, "user", "same"), (-7, 0, "user", "below zero"), (-7, 1, None, None)]
    assert trie_rows(spark, rows, hot_rows=hot_rows) == plain_trie(rows)
    assert trie_rows(spark, rows, share=False, hot_rows=hot_rows) == plain_trie(rows, share=False)


def test_trie_of_awkward_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", "first"),
            (2, 5, "bot", "tie"), (2, 5, "bot", "tie"), (3, 0, "user", "x" * 300_000), (4, 0, "12", "3"), (6, 0, "1", "23"), (9, 0, None, "")]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, rows[:1]) == [] and trie_rows(spark, [(None, None, None, None)] * 3) == []
    lone = [(c, 0, "user", "gone") for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9]       # all turnless: only a root, a leaf
    assert trie_rows(spark, lone) == plain_trie(lone) and len(trie_rows(spark, lone)) == 1


def test_ends_come_in_numeric_order_over_many_lists(spark):
    ids = [*range(0, 60_000, 7), -5, 10**15]
    table = spark.createDataFrame([(i,) for i in ids], "conv long").select("conv", F.lit(0).cast("long").alias("pos"), F.lit("k" * 24 + "3").alias("turn"))
    found = {r.depth: r for r in prefixes.trie(table.repartition(5), Scratch(spark)).collect()}
    assert found[1].ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert (found[1].saved_tokens, found[0].n_leaves, found[1].n_convs) == (3 * (len(ids) - 1), 1, len(ids))


# ---- pieces

TEXTS = [None, "", " ", "  two  blanks ", "tab\tline\n\r", "ﬁ Å Å", "\0x", "▁a", "<s></s><unk>", "<0x41>", "日本語 한국어", "a\xa0b​", "�￼", "😀" * 50,
         "a" * 100_000, " " * 100_000, "ab " * 30_000, "日本" * 30_000, "\n" * 50_000 + "x"]


def test_agenda_equals_the_library_on_random_strings():
    library, own, draw = pieces.processor(MODEL), pieces.Agenda(MODEL), random.Random(1)
    for alphabet in ("ab  tthe in", "a b▁<0x41>\n\t日本語한é😀\0ﬁ1990__--  ", "aeiouaeioust ", " \n", "0123456789.,"):
        for _ in range(800):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 90)))
            assert own.encode(library.normalize(text)).tolist() == own_heap(own, library.normalize(text)) == library.encode(text)
    assert own.checked() and not own.unchecked
    own.encode("▁abc")
    own.unchecked[0] = ("▁abc", b"\1\0\0\0")
    assert not own.checked()


def own_heap(own, normal):
    """Merges of the whole text at once, by the agenda for long parts."""
    out = []
    for symbol in own._merged(normal):
        out += [own.ids[symbol]] if symbol in own.ids else [own.bytes[b] for b in symbol.encode()]
    return out


def test_pieces_on_awkward_rows(spark):
    data = [(i, t, "x", True) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, agrees boolean").repartition(3)
    library = pieces.processor(MODEL)
    found = pieces.encode(docs, MODEL).withColumn("back", pieces.decode(F.col("ids"), MODEL)).collect()
    want = {i: library.encode(t or "") for i, t, *_ in data}
    assert len(found) == len(data) and all(r.agrees and r.ids == want[r.doc_id] and r.back == library.decode(want[r.doc_id]) for r in found)
    assert pieces.encode(docs.limit(0), MODEL).collect() == []


def test_piece_query_by_the_library(spark, sf_dir):
    library = pieces.processor(MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in queries.piece_agenda(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# ---- centroids

def plain_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (key(r), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, near(v)) for i, v in kept]
    inertia, total = {}, sum(d for _, (d, _) in found)
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], total, sha[j]) for i, (d, j) in found), key=str)


def clustered(spark, rows, kind="array<float>", **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, x string").repartition(3)
    return sorted((tuple(r) for r in centroids.summary(centroids.cluster(table, **options)).collect()), key=str)


def test_clusters_by_brute_force_on_awkward_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=64) * draw.choice([0.1, 1, 30])]) for i in range(200)]
    rows += [rows[3]] * 5 + [(7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 64), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65),
             (504, [1.0] * 63 + [None]), (505, [1.0] * 63 + [float("nan")]), (506, [float("-inf")] + [1.0] * 63)]
    rows += [(600 + i, [0.25] * 64) for i in range(80)]       # one vector very often
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, rows[:7], "array<double>") == plain_clusters(rows[:7])      # fewer vectors than centroids
    assert clustered(spark, rows[-95:-80]) == plain_clusters(rows[-95:-80]) and clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []


def test_bounds_leave_the_nearest_and_discard_most(spark, sf_dir):
    draw = np.random.default_rng(6)
    for scale in (1, 50, 5_000, 1 << 24):
        basis = draw.normal(size=(6, 64))
        x = np.rint(draw.normal(size=(500, 6)) @ basis * scale + draw.normal(size=(500, 64))).astype(np.int64)
        c = x[draw.choice(500, 40)]
        rotation = np.linalg.svd(x - x.mean(0))[2][:12].T
        best, far, verified = centroids.nearest(x, *centroids._rotated(x.astype(float), rotation), c, rotation)
        exact = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == exact.argmin(1)).all() and (far == exact.min(1)).all()
        assert scale < 50 or verified < 0.25 * exact.size
    assert 0 < centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).verified < 1


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        clustered(spark, [(1, [1e30] * 64)], "array<double>")
