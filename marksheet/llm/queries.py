"""The registered queries of this package, each over its whole table, and their SQL checks."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.llm import bpe, centroids, exact, langid, lm, mix, near, passages, pieces, pii, prefixes, ranking, rules
from marksheet.llm.common import Scratch, documents, held_out

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function
    return register


_BOILERPLATE = " OR ".join(f"contains(low, '{phrase}')" for phrase in rules.BOILERPLATE)


@query("op1_line_rules", rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs)),
windows AS (SELECT doc_id, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS s
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 AS again FROM windows),
covered AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
lines AS (SELECT doc_id, line, lower(line) AS low, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT *, len(w) AS n, symbols > 0.5::DOUBLE * len(w)
    OR (len(list_filter(w, lambda x: x IN ('|', '>', '»', '›', '•', '·', '/'))) >= 2
        AND len(list_filter(w, lambda x: x IN ('|', '>', '»', '›', '•', '·', '/'))) > 0.2::DOUBLE * len(w))
    OR {_BOILERPLATE}
    OR (len(w) >= 6 AND (len(string_split(line, '!! ')) - 1 + CASE WHEN ends_with(line, '!!') THEN 1 ELSE 0 END > 0.3::DOUBLE * len(w)
        OR len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) > 0.7::DOUBLE * len(w)
        OR len(list_filter(list_zip(w[1:-2], w[2:]), lambda x: x[1] = x[2])) > 0.5::DOUBLE * len(w)))
    OR (len(w) > 100 AND NOT regexp_matches(line, '[.,!?:;…、。！？]')) AS failed FROM lines),
by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (failed) AS n_removed,
    coalesce(sum(n) FILTER (failed), 0) AS n_lost_words FROM judged GROUP BY doc_id),
counts AS (SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
whole AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_lost_words, 0)::BIGINT AS n_lost_words FROM counts LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= 0.5::DOUBLE * n_words AS kept FROM whole""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean(documents(spark, sf_dir)).drop("clean_text")


@query("op2_source_mix", r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496::DOUBLE)
      / coalesce(0.05::DOUBLE + 0.95::DOUBLE * (length(translate(text, '#*$%&|<>0123456789', ''))::DOUBLE
          / greatest(length(text), 1)::DOUBLE), 0.05::DOUBLE) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources WINDOW before AS (ORDER BY 3 * source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE,
    weight * (SELECT level FROM ordered WHERE ratio >= level ORDER BY ratio, rank LIMIT 1)) AS target FROM ordered),
budgets AS (
  SELECT *, floor(target / source_size)::BIGINT AS epochs, target - floor(target / source_size) * source_size AS budget FROM planned),
sums AS (
  SELECT doc_id, size, source_size, target, epochs, budget,
    sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS through
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
taken AS (SELECT *, epochs + CASE WHEN size > 0 AND 2 * through - size <= 2 * budget THEN 1 ELSE 0 END AS copies FROM sums)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM taken""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(documents(spark, sf_dir))


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_digests(bpe.encode(documents(spark, sf_dir), *ranks), ranks[0])


def bpe_digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they stand for."""
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"),
                          F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


@query("op4_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.train(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("all").alias("spans"))


@query("op5_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, *langid.train(docs.filter(~held_out("doc_id", 5, 0))))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query("op6_recurrent_scores")
def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    learned = docs.filter(~held_out("doc_id", 7, 2))
    vocabulary = lm.count_words(learned, scratch)
    scores = lm.score(docs, vocabulary, lm.train(learned, vocabulary), scratch)
    return scores.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op7_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


@query("op8_simhash_pivots")
def simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


@query("op9_pairwise_quality")
def pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 4, 2))
    docs = documents(spark, sf_dir)
    scores = ranking.rank(docs, ranking.train(docs, labels))
    return scores.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "strength")


@query("op10_chunk_recipes", """
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(t) AS text_sha256 FROM folded WINDOW g AS (PARTITION BY t)""")
def chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(documents(spark, sf_dir))


# crc32 bit by bit: the first of a byte's eight steps brings in the byte.
_CRC = """CAST(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({x}, ''),
    lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, 3988292384::BIGINT * (xor(a, e) & 1))), 4294967295::BIGINT) AS BIGINT)"""


@query("op11_prefix_trie", f"""
WITH original AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT DISTINCT c, c - c % 5 AS base, {_CRC.format(x="CAST(c AS VARCHAR)")} % 9 AS h FROM original),
joined AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN original o ON o.c = convs.base AND o.pos < convs.h
  UNION ALL SELECT convs.c, 1, pos, role, text FROM convs JOIN original o ON o.c = convs.c AND o.pos >= convs.h),
turns AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, role, text FROM joined),
paths AS MATERIALIZED (
  SELECT c, depth, text, sha256(CAST(list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY depth) AS VARCHAR)) AS node FROM turns
  UNION ALL SELECT c, 0, '', 'root' FROM convs),
linked AS MATERIALIZED (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM paths WINDOW w AS (PARTITION BY c ORDER BY depth)),
nodes AS MATERIALIZED (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * octet_length(encode(any_value(text))) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY node),
counted AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) AS n_children FROM nodes n),
below AS (
  SELECT up.node, count(*) FILTER (down.n_children = 0) AS n_leaves, sum(down.own)::BIGINT AS saved_tokens
  FROM paths up JOIN counted down ON up.c = down.conv_id
    JOIN paths at_down ON at_down.c = down.conv_id AND at_down.node = down.node AND at_down.depth >= up.depth GROUP BY up.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (node) LEFT JOIN nodes p ON n.parent = p.node""")
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


@query("op12_piece_agenda")
def piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return pieces.encode(documents(spark, sf_dir), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"),
        F.sha2(pieces.decode(F.col("ids"), path), 256).alias("decoded_sha256"), "agrees")


_ROUND = """
near{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN centre{i} c USING (i) GROUP BY v.r, c.k) GROUP BY r),"""
_MOVE = """
centre{j} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM centre{i} c LEFT JOIN (
    SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM cells JOIN near{i} USING (r) GROUP BY k, i) m
  ON c.k = m.k AND c.i = m.i),"""


@query("op13_pca_centroids", f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cells AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(64)) AS i FROM kept),
chosen AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k FROM kept
  ORDER BY k LIMIT 40),
centre0 AS MATERIALIZED (SELECT k, i, x FROM chosen JOIN cells USING (r)),"""
       + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(5)) + _ROUND.format(i=5) + """
digests AS (SELECT k, sha256(string_agg(CAST(x::BIGINT AS VARCHAR), ',' ORDER BY i)) AS s FROM centre5 GROUP BY k)
SELECT vec_id, n.k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY n.k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256 FROM near5 n JOIN kept USING (r) JOIN digests g ON n.k = g.k""")
def pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
