"""Queries of the positional index and of many strings in many texts, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gram_index, occurrences, retrieval, search
from .operators.search import all_words, phrase, prefix, word
from .plans.scratch import scratch_path
from .sinks import versions
from .streaming import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "search-index")
    search.write_index(_table(spark, sf_dir, "documents"), path, ("text", "source"))
    return search.read_index(spark, path)


_CUT = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
_DOCS = f"w AS (SELECT doc_id, text, {_CUT.format('text')} AS t, {_CUT.format('source')} AS s FROM documents)"
_N = "(SELECT count(*) FROM w)"
_IN = {None: ("t", "s"), "text": ("t",), "source": ("s",)}


def _times(tokens: str, open_end: bool = False, field: str | None = None) -> str:
    """How often tokens stand one after the other in the lists t (text) and s (source)."""
    parts = tokens.split()
    hit = lambda a: " AND ".join(f"starts_with({a}[i + {k}], '{x}')" if open_end and k == len(parts) - 1 else f"{a}[i + {k}] = '{x}'" for k, x in enumerate(parts))
    return " + ".join(f"len(list_filter(range(1, len({a}) + {2 - len(parts)}), lambda i: {hit(a)}))" for a in _IN[field])


def _scored(counts: list[str], good: str) -> str:
    """CTEs up to m (doc_id, text, score) of the documents for which ``good`` holds; counts are f0, f1, ..."""
    own = ", ".join(f"{x} AS f{i}" for i, x in enumerate(counts))
    held = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(counts)))
    score = " + ".join(f"greatest(0.000001, ln((n - n{i} + 0.5) / (n{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / mean))" for i in range(len(counts)))
    return f"WITH {_DOCS}, f AS (SELECT doc_id, text, len(t) + len(s) AS l, {own} FROM w), k AS (SELECT count(*) AS n, avg(l) AS mean, {held} FROM f), m AS (SELECT doc_id, text, {score} AS score FROM f, k WHERE {good})"


_add(
    "fts_phrases",
    lambda s, d: search.search(_index(s, d), phrase("Of the", "text") & word("and") - phrase("the is") | word("SRC7", "source") & phrase("dé la")).select("doc_id", F.round("score", 6).alias("score")),
    _scored([_times("of the", field="text"), _times("and"), _times("the is"), _times("src7", field="source"), _times("de la")], "f0 > 0 AND f1 > 0 AND NOT f2 > 0 OR f3 > 0 AND f4 > 0") + " SELECT doc_id, round(score, 6) AS score FROM m",
)
_add(
    "fts_prefix",
    lambda s, d: search.search(_index(s, d), prefix("ment") | prefix("the an") & prefix("src1", "source")).select("doc_id", F.round("score", 6).alias("score")),
    _scored([_times("ment", True), _times("the an", True), _times("src1", True, "source")], "f0 > 0 OR f1 > 0 AND f2 > 0") + " SELECT doc_id, round(score, 6) AS score FROM m",
)
_add(
    "fts_dictionary",
    lambda s, d: search.dictionary(_index(s, d), "th"),
    f"WITH {_DOCS}, x AS (SELECT doc_id, unnest(list_concat(t, s)) AS term FROM w) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM x WHERE starts_with(term, 'th') GROUP BY term",
)


def _best_with_snippets(s: SparkSession, d: str) -> DataFrame:
    best = retrieval.top_k(search.search(_index(s, d), all_words("of the")), 5)
    return best.join(_table(s, d, "documents"), "doc_id").select("doc_id", F.round("score", 6).alias("score"), search.snippet(F.coalesce("text", F.lit("")), "of the").alias("snippet"))


_BARE = r"""regexp_replace(lower(coalesce(text, '')), '[\s，。、；：？！（）()【】《》,.;:?!"'']+', '', 'g')"""
_add(
    "fts_snippets",
    _best_with_snippets,
    _scored([_times("of"), _times("the")], "f0 > 0 AND f1 > 0")
    + f""", b AS (SELECT doc_id, coalesce(text, '') AS text, score, strpos({_BARE}, 'ofthe') AS spot, length({_BARE}) AS n FROM m ORDER BY score DESC, doc_id LIMIT 5),
c AS (SELECT *, CASE WHEN spot > 0 THEN greatest(0, floor((spot - 1) / greatest(n, 1) * length(text))::BIGINT - 21) ELSE 0 END AS start FROM b)
SELECT doc_id, round(score, 6) AS score, CASE WHEN text = '' THEN '' ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || replace(substr(text, start + 1, 42), chr(10), ' ') || '…' END AS snippet FROM c""",
)

_ASKED = ("of the and", "de la", "mentre", "in that is")
_K = 10


def _quality_at_k(s: SparkSession, d: str) -> DataFrame:
    """Of each query the ranked list's first K against the documents whose text holds all its words as substrings."""
    index, docs = _index(s, d), _table(s, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = [retrieval.top_k(search.search(index, all_words(asked, "text")), _K).select(F.lit(asked).alias("query"), "doc_id") for asked in _ASKED]
    holds = [F.when(reduce(and_, (F.col("low").contains(x) for x in asked.split())), F.lit(asked)) for asked in _ASKED]
    true = docs.select("doc_id", F.array_compact(F.array(*holds)).alias("held")).select(F.explode("held").alias("query"), "doc_id")
    hits = reduce(DataFrame.union, found)
    return retrieval.quality_scores(retrieval.retrieval_quality(hits, true))


def _ranked(asked: str) -> str:
    parts = asked.split()
    body = _scored([_times(x, field="text") for x in parts], " AND ".join(f"f{i} > 0" for i in range(len(parts))))
    return f"SELECT '{asked}' AS query, doc_id FROM ({body} SELECT doc_id FROM m ORDER BY score DESC, doc_id LIMIT {_K})"


_TRUE = " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id FROM documents WHERE " + " AND ".join(f"contains(lower(text), '{x}')" for x in q.split()) for q in _ASKED)
_add(
    "retrieval_at_k",
    _quality_at_k,
    f"""WITH h AS ({' UNION ALL '.join(_ranked(q) for q in _ASKED)}), t AS ({_TRUE}),
c AS (SELECT coalesce(h.query, t.query) AS query, count(*) FILTER (h.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (h.doc_id IS NULL) AS fn FROM h FULL JOIN t ON h.query = t.query AND h.doc_id = t.doc_id GROUP BY ALL),
p AS (SELECT query, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c), q AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p)
SELECT query, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM q""",
)


def _benchmark_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences and single words of the benchmark's texts."""
    text = F.coalesce("text", F.lit(""))
    return _table(s, d, "benchmark").select(F.explode(F.concat(F.split(text, r"\.\s"), F.split(text, r"\s+"))).alias("string")).filter(F.length("string") >= 9)


_add(
    "benchmark_occurrences",
    lambda s, d: occurrences.occurrences(_benchmark_sentences(s, d), _table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")),
    r"""WITH q AS (SELECT DISTINCT string FROM (SELECT unnest(list_concat(regexp_split_to_array(coalesce(text, ''), '\.\s'), regexp_split_to_array(coalesce(text, ''), '\s+'))) AS string FROM benchmark) WHERE length(string) >= 9)
SELECT doc_id AS text_id, string, strpos(text, string)::BIGINT AS first, len(list_filter(range(1, length(text) - length(string) + 2), lambda i: text[i : i + length(string) - 1] = string)) AS n FROM documents JOIN q ON contains(text, string)""",
)


def _pruned_grep(s: SparkSession, d: str, needle: str) -> DataFrame:
    table, index = scratch_path(s, "grep-table"), scratch_path(s, "grep-index")
    _table(s, d, "documents").repartitionByRange(24, "lang", "doc_id").write.parquet(table)
    docs = s.read.parquet(table)
    gram_index.write_index(docs, index)
    return retrieval.grep(gram_index.pruned(s, docs, index, needle), needle)


_add("pruned_grep", lambda s, d: _pruned_grep(s, d, "mentque la"), "SELECT DISTINCT doc_id FROM documents WHERE contains(source, 'mentque la') OR contains(lower(text), 'mentque la')")


def _table_versions(s: SparkSession, d: str) -> DataFrame:
    """The versions of a table that is replaced, appended to, taken back and replaced."""
    docs, table = _table(s, d, "documents"), scratch_path(s, "versioned")
    versions.commit(docs.filter("lang = 'en'"), table)
    versions.snapshot(s, table, "english")
    versions.commit(docs.filter("lang <> 'en'"), table, "append")
    versions.commit(docs.filter("lang = 'de'"), table, "append", expected=2)
    versions.rollback(s, table, "english")
    versions.commit(docs, table, "replace")
    held = [versions.read(s, table, v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("rows"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")) for v in versions.versions(s, table)]
    return versions.history(s, table).join(reduce(DataFrame.union, held), "version")


_BY = "SELECT count(*) FILTER ({0}) AS r, coalesce(sum(n_chars) FILTER ({0}), 0)::BIGINT AS c FROM documents"
_add(
    "table_versions",
    _table_versions,
    f"""WITH en AS ({_BY.format("lang = 'en'")}), more AS ({_BY.format("lang <> 'en'")}), de AS ({_BY.format("lang = 'de'")}), every AS ({_BY.format('true')})
SELECT 1::BIGINT AS version, 0::BIGINT AS parent, 'replace' AS kind, 1::BIGINT AS folders, r AS rows, c AS chars FROM en UNION ALL SELECT 2, 1, 'append', 2, en.r + more.r, en.c + more.c FROM en, more
UNION ALL SELECT 3, 2, 'append', 3, en.r + more.r + de.r, en.c + more.c + de.c FROM en, more, de UNION ALL SELECT 4, 3, 'rollback', 1, r, c FROM en UNION ALL SELECT 5, 4, 'replace', 1, r, c FROM every""",
)


#: A run is one version, of however many files.
_ALL_FILES = 2**31 - 1


def _stage_runs(s: SparkSession, d: str) -> DataFrame:
    """What each version of a stage's table holds after runs over one language's files, then another's, then both once more."""
    docs, folder, table = _table(s, d, "documents"), scratch_path(s, "incoming"), scratch_path(s, "stage")
    work = lambda rows: rows.select("address", "lang", F.length("text").cast("long").alias("chars"))
    for langs in (["en"], ["de", "fr"], ["en", "de"]):
        docs.filter(F.col("lang").isin(langs)).write.mode("append").parquet(folder)
        stages.incremental_stage(s, folder, table, "lengths", work, most_files=_ALL_FILES)
    found = [versions.read(s, table, v).groupBy(F.lit(v).cast("long").alias("version"), "lang").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars")) for v in versions.versions(s, table)]
    return reduce(DataFrame.union, found)


_add(
    "stage_versions",
    _stage_runs,
    """WITH l AS (SELECT DISTINCT ON (coalesce(text, '')) coalesce(text, '') AS k, lang, length(text) AS chars, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS since FROM documents WHERE lang IN ('en', 'de', 'fr') ORDER BY coalesce(text, ''), CASE WHEN lang = 'en' THEN 1 ELSE 2 END)
SELECT v.version::BIGINT AS version, lang, count(*) AS texts, sum(chars)::BIGINT AS chars FROM l, (VALUES (1), (2), (3)) AS v(version) WHERE since <= v.version GROUP BY ALL""",
)
