"""All queries of the engine over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import card_catalog, derived_catalog, search_catalog, sql_catalog, text_catalog
from .functions import tokens as T
from .operators import overlap, retrieval, sessions, stats
from .sources import markup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")






def _shingle_sql(words: str, n: int) -> str:
    return f"list_distinct(list_transform(range(0, len({words}) - {n - 1}), lambda i: array_to_string({words}[i + 1 : i + {n}], ' ')))"


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']+')"
_GRAMS = "CASE WHEN length(b) = 0 THEN [] WHEN length(b) <= 3 THEN [b] ELSE list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) END"
_BARE = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')"
_UNITS = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')) + len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]'))"
_ESTIMATE = r"CAST(floor(len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]')) + (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]'))) * 0.35::DOUBLE) AS BIGINT)"
_SENTENCES = r"""WITH raw AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[.!?。！？\n]+', chr(1), 'g'), chr(1))) AS text FROM documents),
w AS (SELECT doc_id, """ + _WORDS + """ AS w FROM raw), s AS (SELECT DISTINCT doc_id, array_to_string(w, ' ') AS sentence FROM w WHERE len(w) >= 8)"""
_COVERAGE = f"""WITH own AS (SELECT doc_id, {_BARE} AS b FROM documents WHERE {_UNITS} >= 8), g AS (SELECT doc_id, {_GRAMS} AS g FROM own),
card AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM (SELECT {_BARE} AS b FROM benchmark)),
u AS (SELECT doc_id, unnest(g) AS gram FROM g), hits AS (SELECT doc_id, count(*) AS hit FROM u WHERE gram IN (SELECT gram FROM card) GROUP BY doc_id),
cov AS (SELECT g.doc_id, CAST(len(g) AS BIGINT) AS grams, coalesce(hit, 0) AS hit FROM g LEFT JOIN hits USING (doc_id))"""

QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


_add("overlap_containment", lambda s, d: overlap.containment(_table(s, d, "documents"), _table(s, d, "benchmark")), f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark), s AS (SELECT doc_id, {_shingle_sql("w", 8)} AS s FROM d),
k AS (SELECT DISTINCT unnest({_shingle_sql("w", 8)}) AS x FROM b), u AS (SELECT doc_id, unnest(s) AS x FROM s), h AS (SELECT doc_id, count(*) AS n FROM u WHERE x IN (SELECT x FROM k) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(n, 0) AS n_shared, CASE WHEN len(s) = 0 THEN 'TOO_SHORT' WHEN coalesce(n, 0) > len(s) * 0.005::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s LEFT JOIN h USING (doc_id)""")
_add("repeated_sentences", lambda s, d: overlap.repeated_sentences(_table(s, d, "documents")), _SENTENCES + """, m AS (SELECT sentence FROM s GROUP BY sentence HAVING count(*) > 1)
SELECT doc_id, count(*) AS n_repeated FROM s WHERE sentence IN (SELECT sentence FROM m) GROUP BY doc_id""")
_add("quote_best_segment", lambda s, d: overlap.best_segments(_table(s, d, "benchmark"), _table(s, d, "documents")), f"""
WITH q AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents), qs AS (SELECT item_id, {_shingle_sql("w", 5)} AS s FROM q),
qu AS (SELECT item_id, CAST(len(s) AS BIGINT) AS total, unnest(s) AS x FROM qs), du AS (SELECT doc_id, unnest({_shingle_sql("w", 5)}) AS x FROM d),
sh AS (SELECT item_id, total, doc_id, count(*) AS shared FROM qu JOIN du USING (x) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM sh)
SELECT item_id, doc_id, shared, total, CAST(rank AS INTEGER) AS rank, CASE WHEN shared * 10 >= total * 6 THEN 'HIT' WHEN shared * 10 >= total * 4 THEN 'PARTIAL' ELSE 'MISS' END AS verdict FROM r WHERE rank <= 3""")
_add("coverage_audit", lambda s, d: overlap.coverage(_table(s, d, "documents"), _table(s, d, "benchmark")), _COVERAGE + " SELECT doc_id, grams, hit FROM cov")
_add("coverage_sensitivity", lambda s, d: overlap.sensitivity(overlap.coverage(_table(s, d, "documents"), _table(s, d, "benchmark"))), _COVERAGE + """
SELECT CAST(p AS INTEGER) AS percent, count(*) AS texts, CAST(sum(CASE WHEN hit * 100 >= grams * p THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM cov, unnest([50, 55, 60, 65, 70, 75, 80]) AS t(p) GROUP BY p""")

_QUERY = ["with", "from"]
_LEX = r'''regexp_extract_all(lower(coalesce(text, '')), '[^，。、；：？！（）()【】《》,.;:?!" \t\r\n'']+')'''
_BM25 = f"""WITH d AS (SELECT doc_id, {_LEX} AS t FROM documents), r AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'with')) AS f0, len(list_filter(t, lambda x: x = 'from')) AS f1 FROM d),
st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM r),
sc AS (SELECT doc_id, greatest(0.000001, ln((n - n0 + 0.5) / (n0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(0.000001, ln((n - n1 + 0.5) / (n1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM r, st WHERE f0 > 0 AND f1 > 0),
top AS (SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 5)"""
_add("bm25_matches", lambda s, d: retrieval.bm25(_table(s, d, "documents"), _QUERY).select("doc_id", F.round("score", 4).alias("score")), _BM25 + " SELECT doc_id, round(score, 4) AS score FROM sc")
_add("bm25_topk", lambda s, d: retrieval.top_k(retrieval.bm25(_table(s, d, "documents"), _QUERY)).select("doc_id"), _BM25 + " SELECT doc_id FROM top")
_add("bm25_neighbours", lambda s, d: retrieval.neighbours(retrieval.top_k(retrieval.bm25(_table(s, d, "documents"), _QUERY)), _table(s, d, "documents"), 2), _BM25 + " SELECT top.doc_id, x.doc_id AS near FROM top JOIN documents x ON x.doc_id <> top.doc_id AND abs(x.doc_id - top.doc_id) <= 2")
_add("postings_stats", lambda s, d: retrieval.postings(_table(s, d, "documents")).groupBy("doc_id", "length").agg(F.count("*").alias("terms"), F.max("tf").alias("most")), f"WITH d AS (SELECT doc_id, {_LEX} AS t FROM documents), u AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d), p AS (SELECT doc_id, length, term, count(*) AS tf FROM u GROUP BY ALL) SELECT doc_id, CAST(length AS BIGINT) AS length, count(*) AS terms, max(tf) AS most FROM p GROUP BY doc_id, length")
_add("grep_documents", lambda s, d: retrieval.grep(_table(s, d, "documents"), "The and"), "SELECT DISTINCT doc_id FROM documents WHERE contains(source, 'The and') OR contains(lower(text), 'the and')")


def _quality(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "documents")
    found = retrieval.grep(docs, "with").select(F.lit("with").alias("query"), "doc_id")
    truth = docs.filter(F.array_contains(T.lexical_tokens(F.col("text")), "with")).select(F.lit("with").alias("query"), "doc_id")
    return retrieval.retrieval_quality(found, truth)


_add("retrieval_quality", _quality, f"""WITH f AS (SELECT doc_id FROM documents WHERE contains(source, 'with') OR contains(lower(text), 'with')), t AS (SELECT doc_id FROM documents WHERE list_contains({_LEX}, 'with'))
SELECT 'with' AS query, count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id""")
_add("token_totals", lambda s, d: stats.token_totals(_table(s, d, "documents")), f"WITH t AS (SELECT source, {_ESTIMATE} AS t FROM documents) SELECT source, count(*) AS files, min(t) AS fewest, max(t) AS most, CAST(sum(t) AS BIGINT) AS tokens FROM t GROUP BY source")
_add("secret_documents", lambda s, d: stats.secret_documents(_table(s, d, "documents")), r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(api_?key|token|secret|password)\s*[:=]\s*["''][^"'']{8,}["'']')) AS BIGINT) AS n_secrets FROM documents WHERE regexp_matches(text, '(?i)(api_?key|token|secret|password)\s*[:=]\s*["''][^"'']{8,}["'']')""")
_add("expression_stats", lambda s, d: stats.expression_stats(_table(s, d, "documents")), r"""WITH raw AS (SELECT lang, length(trim(unnest(string_split(regexp_replace(coalesce(text, ''), '[.!?。！？\n]+', chr(1), 'g'), chr(1))))) AS n FROM documents)
SELECT lang, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS chars, min(n) AS shortest, max(n) AS longest, CAST(sum(n * n) AS BIGINT) AS squares, CASE WHEN sum(n) >= 3000 THEN 'ok' ELSE 'insufficient' END AS state FROM raw WHERE n > 0 GROUP BY lang""")
_add("filler_documents", lambda s, d: _table(s, d, "documents").filter(stats.filler(F.coalesce("text", F.lit("")))).select("doc_id"), rf"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)^\s*\((laughter|applause|music)\)|^\s*thank you') OR {_UNITS} < 8")
_add("page_text", lambda s, d: markup.page_text(_table(s, d, "pages")), r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
_add("gap_sessions", lambda s, d: sessions.gap_sessions(_table(s, d, "events").select("user_id", "ts", F.col("event_id").alias("tie")), "user_id", "ts", F.expr("interval 6 hours")), """
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > interval 6 hours OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, session""")




QUERIES |= card_catalog.QUERIES
QUERIES |= text_catalog.QUERIES
QUERIES |= search_catalog.QUERIES
QUERIES |= derived_catalog.QUERIES
QUERIES |= sql_catalog.queries(QUERIES)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
