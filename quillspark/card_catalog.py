"""Queries about cards: quotations, rules, merging, reading costs; with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import measures, quotations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(table: str, key: str, text: str) -> str:
    split = f"string_split(regexp_replace({text}, '\r\n?', chr(10), 'g'), chr(10))"
    return f"l AS (SELECT {key} AS doc_id, unnest({split}) AS text, unnest(range(0, len({split}))) AS line FROM {table})"



def _has(tags: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(text, '{t}')" for t in tags) + ")"


_add("lint_quotes", lambda s, d: quotations.lint_quotes(_table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))), f"""WITH {_lines('pages', 'page_id', 'html')},
m AS (SELECT *, coalesce(bool_or({_has(quotations.META_TAGS)}) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), false) OR coalesce(bool_or({_has(quotations.AUTHOR_FRAME)}) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 7 PRECEDING AND 1 FOLLOWING), false) AS meta FROM l),
q AS (SELECT doc_id, line, meta, trim(unnest(list_concat(regexp_extract_all(text, '"([^"\n]{{8,400}})"', 1), regexp_extract_all(text, '「([^」]{{8,400}})」', 1)))) AS quote FROM m)
SELECT doc_id, line, quote, meta FROM q WHERE length(quote) >= 8 AND NOT regexp_matches(quote, '://|[*?]|[/\\\\]([^/\\\\\\s\\x{{4E00}}-\\x{{9FFF}}]{{40}}|[^/\\\\\\s\\x{{4E00}}-\\x{{9FFF}}]{{1,39}}([/\\\\\\s]|$))')""")
_add("anchor_quotes", lambda s, d: quotations.anchor_quotes(_table(s, d, "documents")), f"""WITH {_lines('documents', 'doc_id', 'text')}, q AS (SELECT doc_id, line, unnest(list_concat(regexp_extract_all(text, '"([^"\n]{{4,600}})"', 1), regexp_extract_all(text, '[「“]([^」”\n]{{4,600}})[」”]', 1))) AS q FROM l),
c AS (SELECT doc_id, line, trim(q) AS quote, len(regexp_extract_all(q, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS cjk FROM q)
SELECT doc_id, line, quote, CASE WHEN (cjk >= 8 AND cjk >= length(quote) * 0.4::DOUBLE) OR (regexp_matches(quote, '^[A-Za-z0-9]') AND regexp_matches(quote, '[A-Za-z]{{2}}') AND length(quote) >= 12) THEN 'quote' WHEN cjk BETWEEN 4 AND 7 THEN 'short' ELSE 'noise' END AS kind FROM c""")
_add("token_saving", lambda s, d: measures.token_saving(_table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("seq"), F.col("role").alias("title"), "text"), ["with", "from"]), """
WITH r AS (SELECT conv_id AS book, turn AS seq, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[\\x{4E00}-\\x{9FFF}]')) AS z, coalesce(CAST(contains(text, 'with') AS INT), 0) + coalesce(CAST(contains(text, 'from') AS INT), 0) AS hits, coalesce(role, '') AS title FROM conversations),
t AS (SELECT *, CAST(floor(z + (chars - z) * 0.35::DOUBLE) AS BIGINT) AS tokens, coalesce(lag(hits) OVER w, 0) + coalesce(lead(hits) OVER w, 0) > 0 AS beside, length(CAST(seq AS VARCHAR) || '  ' || title || '  (' || CAST(chars AS VARCHAR) || 'c, ' || CAST(hits AS VARCHAR) || ')') AS e FROM r WINDOW w AS (PARTITION BY book ORDER BY seq)),
g AS (SELECT book, count(*) AS blocks, count(*) FILTER (hits > 0) AS hit_blocks, CAST(sum(tokens) AS BIGINT) AS whole, CAST(sum(tokens) FILTER (hits > 0) AS BIGINT) AS hit_only, CAST(sum(tokens) FILTER (hits > 0 OR beside) AS BIGINT) AS with_neighbours,
  CAST(floor((sum(e) + count(*) - 1) * 0.35::DOUBLE) AS BIGINT) AS idx, max(tokens) FILTER (hits > 0) < 200 AS degenerate FROM t GROUP BY book),
b AS (SELECT book, tokens, row_number() OVER (PARTITION BY book ORDER BY hits DESC, tokens, seq) AS nth FROM t WHERE hits > 0)
SELECT g.book, blocks, hit_blocks, whole, hit_only, with_neighbours, idx + b.tokens AS index_then_one, degenerate FROM g JOIN b ON g.book = b.book AND nth = 1""")
_add("seeded_split", lambda s, d: measures.seeded_split(_table(s, d, "benchmark").select(F.col("item_id").alias("case_id"))), "WITH r AS (SELECT item_id AS case_id, row_number() OVER (ORDER BY sha256('42:' || CAST(item_id AS VARCHAR))) AS nth, count(*) OVER () AS n FROM benchmark) SELECT case_id, CASE WHEN nth <= round_even(n * 0.6::DOUBLE, 0) THEN 'train' ELSE 'validation' END AS part FROM r")
