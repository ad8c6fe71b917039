"""The contract queries of the ten operators; each maps (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, langid, minhash, mixing, ngram_join, packing, pii, prefix_trie, quality, repair, secret_scan, token_counts, vector_join
from .common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return minhash.edited_fingerprints(docs, minhash.banded_duplicates(docs))


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.learn(docs)).select("doc_id", _held_out(), "lang_pred", "score")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids", "n_ids")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_repair_shards, op2_minhash, op3_pivotal_mix, op4_ngram_jaccard, op5_secret_scan, op6_metric_join, op7_language_id, op8_hilbert_packing, op9_personal_data, op10_quality, op11_source_divergence, op12_prefix_trie, op13_token_counts)}

#: SQL for DuckDB, where SQL can express a query over whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS cl FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
     g AS (SELECT DISTINCT lang, source FROM d),
     o AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
     c AS (SELECT g.lang, g.source, k.term, k.cl, coalesce(o.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
     n AS (SELECT lang, source, sum(c) AS n, sum(cl) AS nl, count(*) AS v FROM c GROUP BY ALL),
     p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (cl + 2)) // (nl + 2 * v)::HUGEINT AS q FROM c JOIN n USING (lang, source)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q),
     s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM s WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
     c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
                  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i:i])::BIGINT)),
                      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))) % 4 AS h
           FROM (SELECT DISTINCT conv_id FROM t)),
     r AS (SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
           UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
     p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
           FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
           UNION ALL SELECT conv_id, 0, '', 0 FROM c),
     n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM p GROUP BY path, depth),
     k AS (SELECT path[1 : 32 * (depth - 1)] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
     m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
     s AS (SELECT p.path, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.path),
     e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = m.path[1 : 32 * (m.depth - 1)]
"""
