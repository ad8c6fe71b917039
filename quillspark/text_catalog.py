"""Queries of sources, chunks, scoring, anchoring and statistics over the driver's tables, with their SQL twins.

Marked-up texts are made from the tables by the same concatenations on both sides; what the operators
take apart again, the twin states from the rows that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as T
from .operators import anchoring, catalogue, linting, measures, overlap, quotations, retrieval, scoring, segments, sessions, stats
from .sinks import store
from .sources import files, markup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _turns(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "conversations").select("conv_id", "turn", "role", _text().alias("text"))


def _talks(rows: DataFrame, piece: Column, joint: str = "") -> DataFrame:
    """(doc_id, text): one text for each conversation, of a piece for each turn."""
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("ps"))
    return by.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("ps", lambda x: x["p"]), joint).alias("text"))


_C = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']+')"
_TOKENS = r"CAST(floor(length(coalesce(text, '')) * 0.35::DOUBLE) AS BIGINT)"


def _packing(pieces: str, most: int, glue: int) -> str:
    """CTEs that deal pieces (doc_id, pos, t, cut) to packs (doc_id, pos, t, pack), in order."""
    fits = f"NOT p.cut AND f.held + {glue} + length(p.t) <= {most}"
    return f"""p AS ({pieces}), f AS (SELECT doc_id, pos, t, length(t) AS held, 0::BIGINT AS pack FROM p WHERE pos = 0
UNION ALL SELECT p.doc_id, p.pos, p.t, CASE WHEN {fits} THEN f.held + {glue} + length(p.t) ELSE length(p.t) END, CASE WHEN {fits} THEN f.pack ELSE f.pack + 1 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1)"""


# sources

_add(
    "json_lines",
    lambda s, d: files.json_rows(
        _talks(_turns(s, d), F.to_json(F.struct("turn", "role", "text")), "\n").select(F.col("doc_id").cast("string").alias("file"), F.concat("text", F.lit("\n\n{cut off")).alias("text")),
        "turn int, role string, text string",
    ).select("file", "line", "row.turn", "row.role", "row.text", "bad"),
    f"""WITH {_C} SELECT CAST(conv_id AS VARCHAR) AS file, nth AS line, CAST(turn AS INTEGER) AS turn, role, text, false AS bad FROM c
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), n + 2, NULL, NULL, NULL, true FROM c""",
)
_add(
    "natural_names",
    lambda s, d: _table(s, d, "documents").select("doc_id", files.natural_key(F.concat(F.lit("part-0"), F.col("doc_id").cast("string"), F.lit(".srt"))).alias("name")),
    "SELECT doc_id, 'part-' || lpad(CAST(doc_id AS VARCHAR), 20, '0') || '.srt' AS name FROM documents",
)
_add(
    "described_files",
    lambda s, d: stats.described_files(_table(s, d, "documents").select(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".VTT").otherwise(".bin")).alias("path"), F.when(F.col("lang") == "fr", F.concat(F.lit("first\n # Of "), "source", F.lit(" \n"), _text())).otherwise(F.col("text")).alias("text"))),
    """SELECT 'x/' || doc_id || CASE WHEN lang = 'en' THEN '.md' WHEN lang = 'de' THEN '.VTT' ELSE '.bin' END AS path, CASE WHEN lang = 'en' THEN 'markdown' WHEN lang = 'de' THEN 'subtitle' END AS media,
CASE WHEN lang = 'fr' THEN 'Of ' || source ELSE CAST(doc_id AS VARCHAR) END AS title, CASE WHEN len(regexp_extract_all(substr(coalesce(text, ''), 1, 4000), '[\\x{4E00}-\\x{9FFF}]')) * 20 > length(substr(coalesce(text, ''), 1, 4000)) THEN 'zh' ELSE 'en' END AS family FROM documents""",
)
_add(
    "book_segments",
    lambda s, d: markup.corpus_segments(_talks(_turns(s, d), F.concat(F.lit("【第"), F.col("turn").cast("string"), F.lit("段】"), "text", F.lit("\n"))).select(F.col("doc_id").alias("src"), F.concat(F.lit("before\n"), "text").alias("text"))),
    f"WITH {_C} SELECT conv_id AS src, CAST(turn AS BIGINT) AS seg_no, CAST(NULL AS VARCHAR) AS label, '【第' || turn || '段】' || text || chr(10) AS text FROM c",
)
_add(
    "stamped_segments",
    lambda s, d: markup.corpus_segments(_talks(_turns(s, d), F.concat(F.lit("[00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("] "), "text", F.lit("\n"))).select(F.col("doc_id").alias("src"), "text")),
    f"WITH {_C} SELECT conv_id AS src, nth - 1 AS seg_no, CAST(NULL AS VARCHAR) AS label, '[00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || '] ' || text || chr(10) AS text FROM c",
)
_NORMAL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(T, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&amp;', '&'), '*', ''), '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '[—–]|--+', '-', 'g'), '\s+', ' ', 'g'))"""
_add(
    "numbered_entries",
    lambda s, d: markup.entries(_talks(_turns(s, d), F.concat(F.lit("【第"), F.col("turn").cast("string"), F.lit("条 |A&amp;B -- ** “q” "), "text", F.lit("\n"))).select(F.col("doc_id").alias("src"), "text")),
    f"WITH {_C} SELECT conv_id AS src, CAST(turn AS BIGINT) AS entry, {_NORMAL.replace('T,', "'A&amp;B -- ** “q” ' || text || chr(10),")} AS text FROM c",
)
_add(
    "stamp_index",
    lambda s, d: markup.stamp_index(
        _talks(_turns(s, d).filter("role = 'user'"), F.concat(F.lit("[00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(",00] said "), "role", F.lit("\n"))).select(F.col("doc_id").alias("src"), "text"),
        _turns(s, d).select(F.col("conv_id").alias("src"), (F.col("turn") * 1000 + 70).alias("start_ms"), F.lit("heard -- here…").alias("text")),
    ),
    f"WITH {_C} SELECT conv_id AS src, '00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || '.00' AS stamp, CASE WHEN role = 'user' THEN 'said user' ELSE 'heard - here' END AS text FROM c",
)
_add(
    "wiki_pages",
    lambda s, d: markup.clean_wikitext(_talks(_turns(s, d), F.concat(F.lit("=== "), "role", F.lit(" ===\n{{a|{{b\n|c=1}}}}'''[[x|Seen]]''' [http://y.z on <i>"), F.col("turn").cast("string"), F.lit("</i>]\n|row=1\n[[open {{\n"))).select(F.col("doc_id").alias("page"), "text")),
    f"WITH {_C} SELECT conv_id AS page, string_agg('## ' || role || chr(10) || chr(10) || 'Seen on ' || turn, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS headings, count(*) AS dropped FROM c GROUP BY conv_id",
)
_add(
    "front_matter_values",
    lambda s, d: markup.front_matter_values(_table(s, d, "documents").select(F.col("doc_id").alias("card"), F.concat(F.lit("---\nname: '"), "source", F.lit("'\ntags: [one, \""), "lang", F.lit("\"]\nlist:\n  - x\n  - "), F.col("doc_id").cast("string"), F.lit("\nnest:\n  inner: "), "lang", F.lit("\nblock: |\n  one\n  two\nfold: >\n  a\n  b\n---\nname: no")).alias("text"))),
    """WITH d AS (SELECT doc_id AS card, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT card, 'name' AS key, 0::BIGINT AS seq, source AS value FROM d UNION ALL SELECT card, 'tags', 0, 'one' FROM d UNION ALL SELECT card, 'tags', 1, lang FROM d UNION ALL SELECT card, 'list', 0, 'x' FROM d
UNION ALL SELECT card, 'list', 1, CAST(card AS VARCHAR) FROM d UNION ALL SELECT card, 'nest.inner', 0, lang FROM d UNION ALL SELECT card, 'block', 0, 'one' || chr(10) || 'two' FROM d UNION ALL SELECT card, 'fold', 0, 'a b' FROM d""",
)
_add(
    "salvaged_json",
    lambda s, d: _table(s, d, "documents").select("doc_id", files.salvaged_json(F.concat(F.lit('Sure, {as asked}: here [it is'), F.when(F.col("lang") == "en", "```json\n").otherwise("```\n"), F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "s": ["a}\\"b"]}'), F.when(F.col("lang") != "de", "```").otherwise(""), F.lit(" done"))).alias("found")),
    """SELECT doc_id, CASE WHEN lang <> 'de' THEN '{"id": ' || doc_id || ', "s": ["a}\\"b"]}' END AS found FROM documents""",
)
_add(
    "without_metadata",
    lambda s, d: _table(s, d, "documents").select("doc_id", markup.without_metadata(F.concat(F.lit("---\nk: §1\n---\n"), "source", F.lit(" `§2` of\n```\n§3\n```\n"), "lang")).alias("text")),
    "SELECT doc_id, source || '   of' || chr(10) || ' ' || chr(10) || lang AS text FROM documents",
)

# sinks

_add("stage_keys", lambda s, d: _table(s, d, "documents").select("doc_id", store.stage_key("chunk", ("1", "a"), F.col("text"), F.lit(1000)).alias("address")), "SELECT doc_id, sha256('chunk' || chr(10) || '1' || chr(10) || 'a' || chr(10) || sha256(coalesce(text, '')) || chr(10) || sha256('1000')) AS address FROM documents")
_add(
    "rule_violations",
    lambda s, d: store.violations(_table(s, d, "documents"), {"has_text": F.length("text") > 0, "counted": F.col("n_chars") == F.length("text"), "short": F.col("n_chars") <= 5000}, "doc_id"),
    "SELECT doc_id, 'has_text' AS rule FROM documents WHERE NOT coalesce(length(text) > 0, false) UNION ALL SELECT doc_id, 'counted' FROM documents WHERE NOT coalesce(n_chars = length(text), false) UNION ALL SELECT doc_id, 'short' FROM documents WHERE NOT coalesce(n_chars <= 5000, false)",
)

# chunks

_LINES = "SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS t, false AS cut FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)"


def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "documents").select("doc_id", F.posexplode(F.split(_text(), "\n")).alias("seq", "text"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.lit("paragraph").alias("type"), F.lit("").alias("path"), "text")


_CHUNKS = f"WITH RECURSIVE {_packing(_LINES, 1000, 2)}"
_add("document_chunks", lambda s, d: segments.chunks(_paragraphs(s, d), 1000), _CHUNKS + " SELECT doc_id, pack AS chunk, '' AS path, CAST(max(held) AS BIGINT) AS chars, count(*) AS n_elements FROM f GROUP BY doc_id, pack")
_add("chunk_texts", lambda s, d: segments.chunk_texts(_paragraphs(s, d), 1000).drop("code"), _CHUNKS + " SELECT doc_id, pack AS chunk, '' AS path, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS n_elements FROM f GROUP BY doc_id, pack")
_add("index_totals", lambda s, d: segments.index_totals(segments.chunks(_paragraphs(s, d), 1000)), _CHUNKS + ", k AS (SELECT doc_id, pack, max(held) AS c FROM f GROUP BY doc_id, pack) SELECT doc_id, count(*) AS n_chunks, CAST(max(c) AS BIGINT) AS largest, CAST(sum(c) AS BIGINT) AS chars FROM k GROUP BY doc_id")
_HARD = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos, t, cut OR lag(cut, 1, false) OVER (PARTITION BY doc_id ORDER BY i, j) AS cut FROM (
SELECT doc_id, i, unnest(CASE WHEN whole OR length(s) <= 300 THEN [0] ELSE range(0, (length(s) + 299) // 300) END) AS j, NOT whole AND length(s) > 300 AS cut, CASE WHEN cut THEN substr(s, CAST(j * 300 + 1 AS BIGINT), 300) ELSE s END AS t FROM (
SELECT doc_id, whole, unnest(range(0, len(x))) AS i, unnest(x) AS s FROM (SELECT doc_id, length(text) <= 300 AS whole, CASE WHEN length(text) <= 300 THEN [text] ELSE list_filter(string_split(regexp_replace(text, '([。！？；!?;]|\.\s)', '\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') END AS x FROM documents WHERE text IS NOT NULL)))"""
_add("split_texts", lambda s, d: segments.split_long(_table(s, d, "documents").filter("text is not null"), 300), f"WITH RECURSIVE {_packing(_HARD, 300, 0)} SELECT doc_id, pack AS part, string_agg(t, '' ORDER BY pos) AS text FROM f GROUP BY doc_id, pack")
_add(
    "structure_blocks",
    lambda s, d: segments.structure_blocks(_talks(_turns(s, d), F.concat(F.lit("## "), "role", F.lit("\n"), F.trim("text"), F.lit(" \n\n")))),
    f"WITH {_C} SELECT conv_id AS doc_id, CASE WHEN n = 1 AND false THEN 0 ELSE nth END AS block, CASE WHEN n > 1 THEN 'headings' ELSE 'blank_lines' END AS by, trim('## ' || role || chr(10) || trim(text)) AS text FROM c",
)
_STOPS = r"SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS t, false AS cut FROM (SELECT doc_id, CASE WHEN length(t) <= 400 THEN [t] ELSE list_filter(string_split(regexp_replace(regexp_replace(t, '([。！？；])', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda z: z <> '') END AS x FROM (SELECT doc_id, replace(coalesce(text, ''), '.', '。') AS t FROM documents))"
_add("split_blocks", lambda s, d: segments.split_blocks(_table(s, d, "documents").select("doc_id", F.translate(_text(), ".", "。").alias("text")), 400), f"WITH RECURSIVE {_packing(_STOPS, 400, 0)}, g AS (SELECT doc_id, pack AS part, regexp_replace(string_agg(t, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS text FROM f GROUP BY doc_id, pack) SELECT * FROM g WHERE text <> ''")

# overlap

_SENT = f"""raw AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[.!?。！？\\n]+', chr(1), 'g'), chr(1))) AS text FROM documents), w AS (SELECT doc_id, {_WORDS} AS w FROM raw), s AS (SELECT DISTINCT doc_id, array_to_string(w, ' ') AS x FROM w WHERE len(w) >= 8),
braw AS (SELECT unnest(string_split(regexp_replace(coalesce(text, ''), '[.!?。！？\\n]+', chr(1), 'g'), chr(1))) AS text FROM benchmark), bw AS (SELECT {_WORDS} AS w FROM braw), b AS (SELECT DISTINCT array_to_string(w, ' ') AS x FROM bw WHERE len(w) >= 8)"""
_add("sentences_in_benchmark", lambda s, d: overlap.sentences_in_old(_table(s, d, "documents"), _table(s, d, "benchmark")), f"WITH {_SENT} SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (x IN (SELECT x FROM b)) AS n_old FROM s GROUP BY doc_id")
_RUNS8 = "list_distinct(list_transform(range(0, len(w) - 7), lambda i: array_to_string(w[i + 1 : i + 8], ' ')))"
_add(
    "overlap_report",
    lambda s, d: overlap.overlap_report(_table(s, d, "documents"), _table(s, d, "benchmark")),
    f"""WITH {_SENT}, n AS (SELECT DISTINCT unnest({_RUNS8}) AS x FROM (SELECT {_WORDS} AS w FROM documents)), o AS (SELECT DISTINCT unnest({_RUNS8}) AS x FROM (SELECT {_WORDS} AS w FROM benchmark)),
t AS (SELECT count(*) AS n_shingles, count(*) FILTER (x IN (SELECT x FROM o)) AS n_shared FROM n), q AS (SELECT count(*) AS n_sentences FROM s WHERE x IN (SELECT x FROM b))
SELECT n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment, n_sentences, CASE WHEN n_shared / n_shingles > 0.005 OR n_sentences > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM t, q""",
)
_BARE = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')"
_GRAMS = "CASE WHEN length(b) = 0 THEN [] WHEN length(b) <= 3 THEN [b] ELSE list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) END"
_UNITS = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')) + len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]'))"
_SHARES = f"""own AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_BARE} AS b FROM documents WHERE {_UNITS} >= 8)), card AS (SELECT DISTINCT unnest({_GRAMS}) AS x FROM (SELECT {_BARE} AS b FROM benchmark)),
h AS (SELECT doc_id, count(*) AS hit FROM (SELECT doc_id, unnest(g) AS x FROM own) WHERE x IN (SELECT x FROM card) GROUP BY doc_id), cov AS (SELECT doc_id, len(g) AS grams, coalesce(hit, 0) AS hit FROM own LEFT JOIN h USING (doc_id)), sh AS (SELECT *, CASE WHEN grams > 0 THEN hit / grams ELSE 0.0 END AS share FROM cov)"""
_add(
    "coverage_report",
    lambda s, d: overlap.coverage_audit(overlap.coverage(_table(s, d, "documents"), _table(s, d, "benchmark"))),
    f"""WITH {_SHARES}, l AS (SELECT list(share ORDER BY share) AS v FROM sh), t AS (SELECT count(*) AS n, count(*) FILTER (hit * 100 >= grams * 60) AS covered, count(*) FILTER (hit * 100 >= grams * 70) AS covered_strict FROM sh)
SELECT n, covered, covered_strict, round(v[n // 4 + 1], 6) AS q1, round(v[n // 2 + 1], 6) AS q2, round(v[3 * n // 4 + 1], 6) AS q3, covered < n OR covered <> covered_strict AS fragile, CASE WHEN n = 0 THEN 'insufficient' WHEN covered = n THEN 'covered' ELSE 'uncovered' END AS state FROM t, l""",
)
_add("least_covered", lambda s, d: overlap.least_covered(overlap.coverage(_table(s, d, "documents"), _table(s, d, "benchmark")), 90).select("doc_id"), f"WITH {_SHARES} SELECT doc_id FROM sh WHERE hit * 100 < grams * 90 ORDER BY share, doc_id LIMIT 20")

# retrieval

_SPLIT = r'''regexp_extract_all(lower(coalesce(X, '')), '[^，。、；：？！（）()【】《》,.;:?!" \t\r\n'']+')'''
_CHUNK_ROWS = "conv_id * 100 + turn AS chunk_id"


def _chunk_rows(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("role").alias("path"), "text")


_add(
    "bm25_fields",
    lambda s, d: retrieval.bm25_fields(_chunk_rows(s, d), ["user", "with"]).select("chunk_id", F.round("score", 4).alias("score")),
    f"""WITH k AS (SELECT {_CHUNK_ROWS}, {_SPLIT.replace('X', 'role')} AS p, {_SPLIT.replace('X', 'text')} AS t FROM conversations), r AS (SELECT chunk_id, 2 * len(p) + len(t) AS l, 2 * len(list_filter(p, lambda x: x = 'user')) + len(list_filter(t, lambda x: x = 'user')) AS f0, 2 * len(list_filter(p, lambda x: x = 'with')) + len(list_filter(t, lambda x: x = 'with')) AS f1 FROM k),
st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM r)
SELECT chunk_id, round(greatest(0.000001, ln((n - n0 + 0.5) / (n0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(0.000001, ln((n - n1 + 0.5) / (n1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)), 4) AS score FROM r, st WHERE f0 > 0 AND f1 > 0""",
)
_add("grep_chunks", lambda s, d: retrieval.grep_chunks(_chunk_rows(s, d), "THE"), f"SELECT {_CHUNK_ROWS}, role AS path FROM conversations WHERE contains(role, 'THE') OR contains(lower(text), 'the') ORDER BY chunk_id LIMIT 20")
_TERMS = ("with", "from", "una")


def _retrieved(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "documents").select("doc_id", F.lower(_text()).alias("low"), T.lexical_tokens(F.col("text")).alias("t"), F.explode(F.array(*[F.lit(q) for q in _TERMS])).alias("query"))
    return retrieval.quality_scores(retrieval.retrieval_quality(docs.filter(F.col("low").contains(F.col("query"))), docs.filter(F.array_contains("t", F.col("query")))))


_add(
    "retrieval_scores",
    _retrieved,
    f"""WITH q AS (SELECT unnest(['with', 'from', 'una']) AS query), r AS (SELECT query, contains(lower(coalesce(text, '')), query) AS f, list_contains({_SPLIT.replace('X', 'text')}, query) AS t FROM documents, q),
c AS (SELECT query, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM r GROUP BY query), p AS (SELECT query, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c),
x AS (SELECT query, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p) SELECT query, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM x UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM x""",
)

# scoring

_CASE_ROWS = "SELECT doc_id AS case_id, CASE WHEN toxic = 0 THEN source END AS target, n_chars > 900 AS paired, CASE WHEN n_chars < 400 THEN ' N/A ' WHEN lang = 'de' THEN 'src-x' WHEN lang = 'fr' THEN (SELECT min(source) FROM documents) ELSE source END AS selected, n_chars >= 100 AS told FROM documents JOIN labels USING (doc_id)"


def _cases(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(s, d, "documents").join(_table(s, d, "labels"), "doc_id")
    first = _table(s, d, "documents").agg(F.min("source").alias("first"))
    rows = docs.crossJoin(first).select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 0, F.col("source")).alias("target"), (F.col("n_chars") > 900).alias("paired"), "n_chars", F.when(F.col("n_chars") < 400, " N/A ").when(F.col("lang") == "de", "src-x").when(F.col("lang") == "fr", F.col("first")).otherwise(F.col("source")).alias("selected"))
    return rows.select("case_id", "target", "paired"), rows.filter("n_chars >= 100").select("case_id", "selected")


_RESULTS = f"""k AS ({_CASE_ROWS}), r AS (SELECT case_id, target, paired, told, CASE WHEN lower(trim(selected)) = 'n/a' THEN NULL ELSE trim(selected) END AS chosen FROM k), sc AS (SELECT DISTINCT target AS name FROM k WHERE target IS NOT NULL),
v AS (SELECT case_id, target, CASE WHEN NOT told THEN 'unanswered' WHEN target IS NULL THEN 'decoy' WHEN chosen IS NOT DISTINCT FROM target THEN CASE WHEN paired THEN 'sibling' ELSE 'trigger' END WHEN chosen IN (SELECT name FROM sc) THEN 'sibling' ELSE 'trigger' END AS kind,
CASE WHEN NOT told THEN 'unanswered' WHEN chosen IS NOT DISTINCT FROM target THEN 'pass' ELSE 'fail' END AS status FROM r)"""
_add("case_results", lambda s, d: scoring.case_results(*_cases(s, d)), f"WITH {_RESULTS} SELECT case_id, target, kind, status FROM v")
_add("results_by_kind", lambda s, d: scoring.by_kind(scoring.case_results(*_cases(s, d))), f"WITH {_RESULTS} SELECT kind, count(*) FILTER (status = 'pass') AS passed, count(*) AS cases FROM v GROUP BY kind")
_add(
    "trigger_report",
    lambda s, d: scoring.trigger_report(scoring.case_results(*_cases(s, d))),
    f"""WITH {_RESULTS}, a AS (SELECT count(*) FILTER (target IS NOT NULL AND status = 'pass') AS tp, count(*) FILTER (target IS NULL AND status = 'fail') AS fp, count(*) FILTER (target IS NOT NULL AND status <> 'pass') AS fn, count(*) FILTER (target IS NULL AND status <> 'unanswered') AS dn, count(*) FILTER (target IS NULL AND status = 'pass') AS dp,
count(*) FILTER (target IS NOT NULL AND status = 'fail' AND kind = 'sibling') AS sibling_confusion, count(*) FILTER (status = 'unanswered') AS unanswered, count(*) FILTER (status = 'pass') AS passed, count(*) AS cases FROM v), b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM a)
SELECT tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1, round(CASE WHEN dn > 0 THEN dp / dn ELSE 1.0 END, 3) AS decoy_pass_rate, sibling_confusion, round(CASE WHEN tp + fn > 0 THEN sibling_confusion / (tp + fn) ELSE 0 END, 3) AS sibling_rate, unanswered, passed, cases, CASE WHEN passed = cases THEN 'pass' ELSE 'fail' END AS verdict FROM b""",
)
_add("blind_cases", lambda s, d: scoring.blind_cases(_table(s, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("prompt"), F.col("source").alias("target"))), "SELECT doc_id AS case_id, text AS prompt FROM documents")
_DIMS = tuple(scoring.MOST_POINTS)


def _sheets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = _table(s, d, "conversations")
    rows = turns.select(F.col("conv_id").alias("subject"), F.col("turn").alias("sheet"), F.when(F.length("text") > 60, F.col("role")).otherwise(F.lit(" ")).alias("grader"), F.posexplode(F.array(*[F.lit(x) for x in _DIMS])).alias("i", "dimension"), F.length("text").alias("n"))
    return rows.filter("not (i = 4 and n > 150)").select("subject", "sheet", "grader", "dimension", F.when(F.col("n") > 40, F.floor(F.col("n") / 10)).alias("score")), turns.select(F.col("conv_id").alias("subject"), F.lit("user").alias("answerer")).distinct()


_LIMITS = ", ".join(f"({i}, '{name}', {most})" for i, (name, most) in enumerate(scoring.MOST_POINTS.items()))
_add(
    "grader_errors",
    lambda s, d: scoring.grader_errors(*_sheets(s, d)),
    f"""WITH m(i, dimension, most) AS (VALUES {_LIMITS}), b AS (SELECT conv_id AS subject, turn AS sheet, CASE WHEN length(text) > 60 THEN role END AS grader, length(text) AS n FROM conversations), s AS (SELECT b.*, i, dimension, most, CASE WHEN n > 40 THEN n // 10 END AS score FROM b, m WHERE NOT (i = 4 AND n > 150) OR n IS NULL)
SELECT subject, grader, 'bad_score:' || dimension AS error FROM s WHERE score IS NULL OR score > most UNION ALL SELECT subject, grader, 'missing:structure' FROM b WHERE n > 150 UNION ALL SELECT subject, grader, 'no_grader' FROM b WHERE grader IS NULL
UNION ALL SELECT subject, grader, 'same_grader' FROM b WHERE grader IS NOT NULL GROUP BY subject, grader HAVING count(*) > 1 UNION ALL SELECT DISTINCT subject, grader, 'grades_itself' FROM b WHERE grader = 'user'""",
)


def _reports(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "documents").join(_table(s, d, "labels"), "doc_id")
    n = F.col("n_chars")
    return docs.select(
        F.col("doc_id").alias("subject"), F.when(F.col("lang") == "en", "dual-agent").when(F.col("lang") == "de", "fallback-self").when(F.col("lang") == "fr", "unknown").otherwise("single").alias("mode"),
        *[F.least(F.floor(n / (10 * (i + 2))), F.lit(most)).cast("int").alias(name) for i, (name, most) in enumerate(scoring.MOST_POINTS.items())],
        F.when(F.col("toxic") == 1, "Fail").otherwise("pass").alias("verdict"), (1 - F.col("quality")).alias("blocking"), F.lit(None).cast("string").alias("note"), F.when(n > 500, 2).otherwise(1).alias("graders"), F.floor(n / 300).alias("spread"),
    )


_POINTS = ", ".join(f"CAST(least(n_chars // {10 * (i + 2)}, {most}) AS INTEGER) AS {name}" for i, (name, most) in enumerate(scoring.MOST_POINTS.items()))
_add(
    "gated_reports",
    lambda s, d: scoring.gated(scoring.discounted(_reports(s, d))),
    f"""WITH r AS (SELECT doc_id AS subject, CASE WHEN lang = 'en' THEN 'dual' WHEN lang = 'de' THEN 'self' WHEN lang = 'fr' THEN 'unknown' ELSE 'single' END AS mode, {_POINTS}, toxic = 1 AS failed, quality = 0 AS blocking, n_chars > 500 AS two, n_chars // 300 > 10 AS apart FROM documents JOIN labels USING (doc_id)),
c AS (SELECT *, CASE WHEN mode = 'self' THEN consistency * 8 // 10 ELSE consistency END AS a, CASE WHEN mode = 'self' THEN 0 ELSE style END AS b, CASE WHEN mode = 'self' THEN edge_honesty * 8 // 10 ELSE edge_honesty END AS e FROM r), t AS (SELECT *, CAST(a + b + e + source_transparency + structure AS BIGINT) AS total FROM c),
v AS (SELECT *, list_filter([CASE WHEN failed THEN 'failed' END, CASE WHEN e = 0 THEN 'invented' END, CASE WHEN mode = 'unknown' THEN 'unknown_mode' END, CASE WHEN blocking THEN 'blocking' END], lambda x: x IS NOT NULL) AS veto FROM t),
w AS (SELECT *, CASE WHEN len(veto) > 0 THEN array_to_string(veto, ' ') WHEN mode <> 'dual' THEN 'not_independent' ELSE array_to_string(list_filter([CASE WHEN NOT two THEN 'too_few_graders' END, CASE WHEN apart THEN 'graders_differ' END, CASE WHEN total < 70 THEN 'below_grade' END], lambda x: x IS NOT NULL), ' ') END AS reasons FROM v)
SELECT subject, total, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' ELSE 'D' END AS grade, reasons = '' AS passed, reasons FROM w""",
)


def _signal_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _table(s, d, "documents").select(F.col("doc_id").alias("card"), "lang", "source", _text().alias("text"))
    cards = docs.select("card", F.concat(F.lit('tags: ["'), "source", F.lit('", x, '), "lang", F.lit("]\n「"), F.substring(F.regexp_replace("text", r"[^a-z ]", ""), 1, 20), F.lit("」")).alias("text"))
    answers = docs.select("card", F.lit(1).alias("answer_id"), F.when(F.col("lang") == "en", F.concat("text", F.lit(" §3"))).when(F.col("lang") == "de", F.concat(F.lit("不适用 "), "source")).otherwise(F.regexp_replace("text", r"[^a-z ]", "")).alias("text"))
    return cards, docs.select("card", F.when(F.length("text") > 800, F.concat(F.lit("ask "), "lang")).alias("text")), answers


_SIGNALS = r"""b AS (SELECT doc_id AS card, lang, source, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g') AS low FROM documents), g AS (SELECT *, substr(low, 1, 20) AS q, CASE WHEN length(text) > 800 THEN [lang] ELSE [] END AS leaked FROM b),
s AS (SELECT *, CASE WHEN length(q) >= 6 THEN [substr(trim(q), 1, 6)] ELSE [] END AS keys, list_filter(list_sort(list_distinct([source, lang])), lambda t: NOT list_contains(leaked, t)) AS tags FROM g)"""
_add("card_signals", lambda s, d: scoring.without_leaks(scoring.card_signals(_signal_tables(s, d)[0]), _signal_tables(s, d)[1]).select("card", *[F.array_join(c, "|").alias(c) for c in ("tags", "keys", "leaked")]), f"WITH {_SIGNALS} SELECT card, array_to_string(tags, '|') AS tags, array_to_string(keys, '|') AS keys, array_to_string(leaked, '|') AS leaked FROM s")


def _signs(s: SparkSession, d: str) -> DataFrame:
    cards, questions, answers = _signal_tables(s, d)
    return scoring.answer_signals(answers, scoring.without_leaks(scoring.card_signals(cards), questions))


_add(
    "answer_signals",
    _signs,
    f"""WITH {_SIGNALS}, a AS (SELECT *, CASE WHEN lang = 'en' THEN text || ' §3' WHEN lang = 'de' THEN '不适用 ' || source ELSE low END AS answer FROM s), t AS (SELECT *, regexp_replace(answer, '\\s+', '', 'g') AS tight FROM a)
SELECT card, 1::INTEGER AS answer_id, lang = 'en' AS locator, len(list_filter(keys, lambda k: contains(tight, replace(k, ' ', '')))) > 0 AS quoted, lang = 'de' AS bounded, len(list_filter(tags, lambda k: contains(tight, replace(k, ' ', '')))) > 0 AS tagged FROM t""",
)
_add(
    "evidence_gaps",
    lambda s, d: scoring.evidence_gaps(_table(s, d, "documents").select(F.col("doc_id").alias("claim"), F.col("doc_id").alias("test"), (F.col("n_chars") > 500).cast("int").alias("said")), _table(s, d, "labels").select(F.col("doc_id").alias("test"), F.col("quality").cast("int").alias("number"))),
    "SELECT doc_id AS claim, doc_id AS test, CASE WHEN quality IS NULL THEN 'undefined' ELSE 'number_differs' END AS gap FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> CAST(n_chars > 500 AS INTEGER)",
)
_add("evidence_totals", lambda s, d: scoring.evidence_totals(documents=_table(s, d, "documents"), labels=_table(s, d, "labels"), benchmark=_table(s, d, "benchmark")), "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
_add(
    "chosen_strategy",
    lambda s, d: scoring.chosen_strategy(_table(s, d, "documents").select(F.col("doc_id").alias("bundle"), F.when(F.col("lang") == "de", "pack").when(F.col("lang") == "fr", "both").alias("requested"), F.when(F.col("n_chars") < 200, "workflow").when(F.col("n_chars") < 300, "other").otherwise("").alias("purpose"), F.floor(F.col("n_chars") / 200).alias("promoted"), (F.col("lang") == "en").alias("ready"))),
    "SELECT doc_id AS bundle, CASE WHEN lang = 'de' THEN 'pack' WHEN n_chars < 200 THEN 'pack' WHEN n_chars < 300 THEN 'single' WHEN n_chars // 200 >= 3 AND lang = 'en' THEN 'pack' ELSE 'single' END AS strategy, n_chars // 200 > 8 AS over_budget FROM documents",
)
_add(
    "failure_matrix",
    lambda s, d: scoring.failure_matrix(_table(s, d, "documents").select(F.col("source").alias("category"), F.when(F.col("lang") == "en", "P0").when(F.col("lang") == "de", "P1").otherwise("other").alias("severity"))),
    "SELECT source AS category, count(*) FILTER (lang = 'en') AS P0, count(*) FILTER (lang = 'de') AS P1, 0::BIGINT AS P2, count(*) FILTER (source IS NOT NULL AND lang IN ('en', 'de')) AS valid, count(*) AS n FROM documents GROUP BY source",
)

# anchoring

_ANCHOR = f"""q AS (SELECT item_id, text, {_WORDS} AS w FROM benchmark), kk AS (SELECT *, CASE WHEN len(w) >= 3 THEN least(5, greatest(2, len(w) // 2)) END AS k FROM q), a AS (SELECT item_id, k, list_distinct(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS s FROM kk),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT item_id, k, unnest(s) AS x FROM a), h AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS x FROM d, (SELECT DISTINCT k FROM kk WHERE k IS NOT NULL)),
c AS (SELECT item_id, doc_id, count(*) AS shared FROM u JOIN h USING (k, x) GROUP BY ALL), t AS (SELECT a.item_id, CASE WHEN length(text) > 80 THEN a.item_id * 3 END AS target, a.k, len(s) AS total, doc_id, shared FROM a JOIN q USING (item_id) LEFT JOIN c USING (item_id)),
b AS (SELECT *, max(shared) FILTER (doc_id = target) OVER (PARTITION BY item_id) AS own, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC NULLS LAST, coalesce(doc_id = target, false) DESC, doc_id) AS nth FROM t),
v AS (SELECT item_id AS quote_id, target, CASE WHEN target IS NULL THEN 'UNANCHORED' WHEN k IS NULL THEN 'TOO_SHORT' WHEN shared IS NULL THEN 'NOT_IN_CORPUS' WHEN shared * 100 >= total * 60 THEN CASE WHEN doc_id = target THEN 'ANCHOR_HIT' ELSE 'SPAN_HIT' END WHEN coalesce(own, 0) * 100 >= total * 40 THEN 'ANCHOR_PARTIAL' ELSE 'ANCHOR_MISS' END AS verdict,
CASE WHEN shared * 100 >= total * 60 THEN doc_id END AS hit_at, coalesce(shared, 0) AS shared, CAST(coalesce(total, 0) AS BIGINT) AS total FROM b WHERE nth = 1)"""


def _anchored(s: SparkSession, d: str) -> DataFrame:
    quotes = _table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), F.when(F.length("text") > 80, F.col("item_id") * 3).alias("target"))
    return anchoring.anchor_verdicts(quotes, _table(s, d, "documents").select(F.col("doc_id").alias("seg"), "text"))


_add("anchor_verdicts", _anchored, f"WITH {_ANCHOR} SELECT * FROM v")
_NAMES = ("ANCHOR_HIT", "ANCHOR_PARTIAL", "SPAN_HIT", "ANCHOR_MISS", "NOT_IN_CORPUS", "TOO_SHORT", "UNANCHORED")
_add("anchor_report", lambda s, d: anchoring.anchor_report(_anchored(s, d)), f"WITH {_ANCHOR} SELECT count(*) AS quotes, count(target) AS claimed, {', '.join(f'count(*) FILTER (verdict = {n!r}) AS {n.lower()}' for n in _NAMES)}, true AS balanced, CASE WHEN count(*) FILTER (verdict IN ('ANCHOR_MISS', 'NOT_IN_CORPUS', 'SPAN_HIT')) > 0 THEN 'FAIL' WHEN count(target) = 0 THEN 'UNVERIFIED' ELSE 'PASS' END AS verdict FROM v")
_add(
    "verify_accounting",
    lambda s, d: anchoring.verify_accounting(_table(s, d, "documents").select(F.when(F.col("lang") == "en", "verified").when(F.col("lang") == "de", "misplaced").when(F.col("lang") == "fr", "unquoted").otherwise("lang_skipped").alias("status"), (F.col("n_chars") > 100).alias("quoted"))),
    "SELECT count(*) AS refs, count(*) FILTER (n_chars > 100) AS quotes, count(*) FILTER (lang = 'en') AS verified, 0::BIGINT AS unverified, count(*) FILTER (lang = 'de') AS misplaced, 0::BIGINT AS orphaned, count(*) FILTER (lang = 'fr') AS unquoted, 0::BIGINT AS locator_only, count(*) FILTER (lang NOT IN ('en', 'de', 'fr') OR lang IS NULL) AS lang_skipped, true AS balanced, 'fail' AS verdict FROM documents",
)

# statistics and catalogue

_add("largest_files", lambda s, d: stats.largest_files(_table(s, d, "documents")), f"SELECT doc_id, {_TOKENS} AS tokens FROM documents ORDER BY tokens DESC, doc_id LIMIT 10")
_add(
    "token_metrics",
    lambda s, d: stats.token_metrics(_table(s, d, "documents").select(F.concat(F.lit("---\nname: "), "source", F.lit("\n---\n"), _text()).alias("text"))),
    f"WITH t AS (SELECT CAST(floor(length('---' || chr(10) || 'name: ' || source || chr(10) || '---' || chr(10) || coalesce(text, '')) * 0.35::DOUBLE) AS BIGINT) AS t, CAST(floor(length('name: ' || source) * 0.35::DOUBLE) AS BIGINT) AS h FROM documents) SELECT count(*) AS cards, min(t) AS fewest, CAST(trunc(quantile_cont(t, 0.5)) AS BIGINT) AS median, max(t) AS most, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(h) AS BIGINT) AS discovery FROM t",
)
_add(
    "shell_hazards",
    lambda s, d: stats.shell_hazards(_table(s, d, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("# $1\nrun \"$1\" "), F.when(F.col("lang") == "en", "$2 x").when(F.col("lang") == "de", "$nameé").otherwise("ok"), F.lit("\nmake | tail -3 "), F.when(F.col("n_chars") > 500, "| && echo").otherwise("")).alias("text"))),
    "SELECT doc_id AS path, 2::BIGINT AS line, CASE WHEN lang = 'en' THEN 'bare_argument' ELSE 'name_meets_letter' END AS hazard FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, 3, 'pipe_as_status' FROM documents WHERE n_chars > 500",
)
_MARKERS = {"turn": ("but", "and"), "certain": ("the", "then")}
_TIMES = lambda words: " + ".join(f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{w}', ''))) / {len(w)}" for w in words)
_add(
    "marker_rates",
    lambda s, d: stats.marker_rates(_table(s, d, "documents"), "source", _MARKERS, 100_000),
    rf"WITH t AS (SELECT source, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS chars, {_TIMES(_MARKERS['turn'])} AS a, {_TIMES(_MARKERS['certain'])} AS b FROM documents), g AS (SELECT source, CAST(sum(chars) AS BIGINT) AS chars, sum(a) AS a, sum(b) AS b FROM t GROUP BY source) SELECT source, chars, CASE WHEN chars >= 100000 THEN 'ok' ELSE 'insufficient' END AS state, CASE WHEN chars >= 100000 THEN round(a * 1000 / chars, 2) END AS turn_rate, CASE WHEN chars >= 100000 THEN round(b * 1000 / chars, 2) END AS certain_rate FROM g",
)
_ABC, _HAN = "etaoinshrdlu", "山水火木金土日月星天地人"
_add(
    "top_bigrams",
    lambda s, d: stats.top_bigrams(_table(s, d, "documents").select("lang", F.translate(F.lower(_text()), _ABC, _HAN).alias("text")), "lang", 10, stats.STOP_CHARACTERS + "山"),
    f"""WITH t AS (SELECT lang, regexp_replace(unnest(string_split(regexp_replace(translate(lower(coalesce(text, '')), '{_ABC}', '{_HAN}'), '[。！？；!?;]+', chr(1), 'g'), chr(1))), '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g') AS s FROM documents),
p AS (SELECT lang, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS pair FROM t WHERE length(s) > 1), n AS (SELECT lang, pair, count(*) AS n FROM p WHERE NOT contains(pair, '山') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, pair) AS rank FROM n) SELECT lang, pair, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
_add("top_titles", lambda s, d: stats.top_titles(_table(s, d, "documents").select("lang", F.concat(F.lit("in 《"), "source", F.lit("》 and 《a title too long to count》")).alias("text")), "lang", 3), "WITH n AS (SELECT lang, source AS title, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, title) AS rank FROM n WHERE length(title) <= 12) SELECT lang, title, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")


def _section_editions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = _turns(s, d)
    old = _talks(turns, F.concat(F.lit("## "), "role", F.lit("\n"), F.lit("text "), F.col("turn").cast("string"), F.lit("\n")))
    new = _talks(turns, F.concat(F.lit("## "), F.when(F.col("turn") > 5, "late").otherwise(F.col("role")), F.lit("\n"), F.when(F.col("role") == "user", "text ").otherwise("other "), F.col("turn").cast("string"), F.lit("\n")))
    return old, new


_add(
    "section_diff",
    lambda s, d: catalogue.section_diff(*_section_editions(s, d)),
    f"""WITH {_C}, o AS (SELECT conv_id, role AS title, string_agg('text ' || turn, chr(10) ORDER BY turn) AS x FROM c GROUP BY ALL), w AS (SELECT conv_id, CASE WHEN turn > 5 THEN 'late' ELSE role END AS title, string_agg(CASE WHEN role = 'user' THEN 'text ' ELSE 'other ' END || turn, chr(10) ORDER BY turn) AS y FROM c GROUP BY ALL)
SELECT conv_id AS doc_id, title, CASE WHEN x IS NULL THEN 'additive' WHEN y IS NULL THEN 'deletion' ELSE 'modified' END AS change FROM o FULL JOIN w USING (conv_id, title) WHERE x IS DISTINCT FROM y""",
)
_add(
    "repaired_files",
    lambda s, d: catalogue.repaired(_table(s, d, "documents").select(F.col("doc_id").alias("path"), F.lit("x").alias("slug"), F.concat(F.lit("---\nname: "), F.when(F.col("lang") == "en", "x").otherwise("y"), F.when(F.col("lang") == "fr", "\r\n").otherwise("\n"), F.lit("---\nbody"), F.when(F.col("n_chars") > 500, " \n").otherwise("")).alias("text"))).select("path", "text", F.array_join("notes", " ").alias("notes")),
    """WITH d AS (SELECT doc_id AS path, lang, n_chars > 500 AS long FROM documents) SELECT path, '---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || 'body' || chr(10) AS text, array_to_string(list_filter([CASE WHEN lang = 'fr' THEN 'line_ends' END, CASE WHEN NOT long THEN 'final_line_end' END, CASE WHEN long THEN 'trailing_blanks' END, CASE WHEN lang <> 'en' THEN 'name' END], lambda x: x IS NOT NULL), ' ') AS notes FROM d""",
)
_add(
    "patched_cards",
    lambda s, d: catalogue.patched(
        _table(s, d, "documents").select(F.col("doc_id").alias("card"), F.lit("---\nname: a\n---\n\n## One\n\nold\n\n## Two\n\nlast\n").alias("text")),
        _table(s, d, "documents").filter("lang <> 'es'").select(F.col("doc_id").alias("card"), F.when(F.col("lang") == "en", "field").when(F.col("lang") == "de", "append").otherwise("replace").alias("kind"), F.when(F.col("lang") == "en", "name").when(F.col("n_chars") > 500, "One").otherwise("Nine").alias("name"), F.concat(F.lit(" $"), "source", F.lit(" ")).alias("content")),
    ),
    r"""WITH d AS (SELECT doc_id AS card, coalesce(lang, 'es') AS lang, n_chars > 500 AS long, '$' || source AS v, chr(10) AS n FROM documents) SELECT card, CASE WHEN lang = 'en' THEN '---' || n || 'name: ' || v || n || '---' || n || n || '## One' || n || n || 'old' || n || n || '## Two' || n || n || 'last' || n
WHEN lang = 'de' THEN '---' || n || 'name: a' || n || '---' || n || n || '## One' || n || n || 'old' || n || n || '## Two' || n || n || 'last' || n || n || '## ' || CASE WHEN long THEN 'One' ELSE 'Nine' END || n || n || v || n
WHEN lang = 'fr' AND long THEN '---' || n || 'name: a' || n || '---' || n || n || '## One' || n || n || v || n || n || '## Two' || n || n || 'last' || n ELSE '---' || n || 'name: a' || n || '---' || n || n || '## One' || n || n || 'old' || n || n || '## Two' || n || n || 'last' || n END AS text,
CASE WHEN lang = 'es' THEN 'unchanged' WHEN lang = 'fr' AND NOT long THEN 'no_section' ELSE 'patched' END AS state FROM d""",
)
_add(
    "missing_parts",
    lambda s, d: catalogue.missing_parts(_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.when(F.col("lang") != "de", F.col("text")).alias("description"), F.when(F.col("lang") != "fr", F.col("doc_id").cast("string")).alias("src")), _table(s, d, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("toxic") == 1).alias("is_link"))),
    "SELECT CAST(doc_id AS VARCHAR) AS slug, 'no_description' AS rule FROM documents WHERE lang IS NULL OR lang = 'de' OR coalesce(text, '') = '' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no_src' FROM documents WHERE lang IS NULL OR lang = 'fr' UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic IS NULL THEN 'missing_file' ELSE 'link' END FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'fr' AND (toxic IS NULL OR toxic = 1)",
)
_add(
    "stated_ratios",
    lambda s, d: _table(s, d, "documents").select("doc_id", catalogue.stated_ratio(F.when(F.col("lang") == "en", F.concat(F.lit("one_hand_ratio: 0."), F.col("doc_id").cast("string"), F.lit(" [二手]"))).when(F.col("lang") == "de", "[一手] [二手] [二手] [二手]").otherwise(F.col("source"))).alias("ratio")),
    "SELECT doc_id, CASE WHEN lang = 'en' THEN CAST('0.' || doc_id AS DOUBLE) WHEN lang = 'de' THEN 0.25 END AS ratio FROM documents",
)
_add(
    "compiled_cards",
    lambda s, d: measures.compiled_modes(_turns(s, d).select(F.col("conv_id").alias("bundle"), F.concat(F.when(F.col("role") == "user", "cards/").otherwise("refs/"), F.col("turn").cast("string")).alias("path"), (F.col("turn") == 0).alias("entry"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text")), "cards"),
    f"WITH {_C}, k AS (SELECT *, turn = 0 AS entry, CASE WHEN role = 'user' THEN 'cards/' ELSE 'refs/' END || turn AS path FROM c) SELECT conv_id AS bundle, string_agg(CASE WHEN entry THEN 't' || turn ELSE '## ' || path || chr(10) || chr(10) || 't' || turn END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY NOT entry, path) AS prompt, count(*) AS n_files FROM k WHERE entry OR role = 'user' GROUP BY conv_id",
)

# functions

_add("clean_texts", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(T.clean(_text())).alias("bare")), r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\s，。、；：？！“”‘’「」『』（）《》〈〉【】—…·,.;:?!"''()\[\]<>-]+', '', 'g')) AS bare FROM documents""")
_add("normal_texts", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(T.normal(_text())).alias("normal")), f"SELECT doc_id, md5({_NORMAL.replace('T,', 'coalesce(text, CHR_),').replace('CHR_', "''")}) AS normal FROM documents")
_add("mapped_texts", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(T.mapped(_text(), dict(zip(_ABC, _HAN, strict=True)))).alias("mapped")), f"SELECT doc_id, md5(translate(coalesce(text, ''), '{_ABC}', '{_HAN}')) AS mapped FROM documents")
_add("clock_marks", lambda s, d: _table(s, d, "documents").select("doc_id", T.clock(F.col("n_chars") * 1234).alias("mark")), "SELECT doc_id, printf('%02d:%02d:%02d.%d0', n_chars * 1234 // 3600000, n_chars * 1234 // 60000 % 60, n_chars * 1234 // 1000 % 60, n_chars * 1234 // 100 % 10) AS mark FROM documents")
_add("canonical_rows", lambda s, d: _table(s, d, "labels").select("doc_id", F.sha2(files.canonical_json(F.struct("doc_id", "quality", "toxic")), 256).alias("h")), """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS h FROM labels""")
_add(
    "differing_characters",
    lambda s, d: quotations.differing_characters(_table(s, d, "documents").select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("sent_id"), F.concat(F.lit("abc"), "lang").alias("quote"), F.concat(F.lit("aXc"), "lang", F.lit("!")).alias("sentence"))).select("quote_id", "sent_id", F.array_join("differs", " ").alias("differs")),
    "SELECT doc_id AS quote_id, doc_id AS sent_id, CASE WHEN lang IS NULL THEN '' ELSE 'b>X >!' END AS differs FROM documents",
)

# marked-up texts and editions

def _srt(s: SparkSession, d: str) -> DataFrame:
    turn = F.lpad(F.col("turn").cast("string"), 2, "0")
    head = F.concat(F.col("turn").cast("string"), F.lit("\n"), F.when(F.col("role") == "user", "01:").otherwise(""), F.lit("00:"), turn, F.lit(",500 --> 01:00:"), turn, F.lit(".750\n<i>"))
    return _talks(_turns(s, d), F.concat(head, "role", F.lit("</i>\n  says "), F.col("turn").cast("string"), F.lit("\n\n"))).select(F.col("doc_id").alias("file"), F.concat(F.lit("WEBVTT\n\n"), "text", F.lit("9\n00:00:09.000 --> 00:00:10.000\n...\n")).alias("text"))


_add("subtitles", lambda s, d: markup.subtitles(_srt(s, d)), f"WITH {_C} SELECT conv_id AS file, nth AS idx, CAST(CASE WHEN role = 'user' THEN 3600000 ELSE 0 END + turn * 1000 + 500 AS BIGINT) AS start_ms, CAST(3600000 + turn * 1000 + 750 AS BIGINT) AS end_ms, role || ' says ' || turn AS text FROM c")
_add(
    "capped_sessions",
    lambda s, d: sessions.capped_sessions(_turns(s, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), (F.col("turn") * 3000).alias("start_ms"), (F.col("turn") * 3000 + F.when(F.col("role") == "user", 100).otherwise(600)).alias("end_ms"), F.when(F.length("text") < 30, "(laughs)").otherwise(F.col("text")).alias("text"))),
    f"""WITH RECURSIVE {_C}, {_packing("SELECT conv_id AS doc_id, nth - 1 AS pos, CASE WHEN length(text) < 30 THEN '(laughs)' ELSE text END AS t, coalesce(turn * 3000 - lag(turn * 3000 + CASE WHEN role = 'user' THEN 100 ELSE 600 END) OVER (PARTITION BY conv_id ORDER BY turn) > 2500, false) AS cut FROM c", 420, 1)},
g AS (SELECT f.doc_id, pack, min(turn) * 3000 AS start_ms, max(turn * 3000 + CASE WHEN role = 'user' THEN 100 ELSE 600 END) AS end_ms, string_agg(t, ' ' ORDER BY pos) AS text, count(*) AS cue_count FROM f JOIN c ON c.conv_id = f.doc_id AND c.nth = f.pos + 1 GROUP BY f.doc_id, pack)
SELECT doc_id AS file, row_number() OVER (PARTITION BY doc_id ORDER BY pack) - 1 AS para, start_ms, end_ms, length(text) AS chars, cue_count, text FROM g WHERE text <> '(laughs)'""",
)
_add("time_segments", lambda s, d: markup.time_segments(_talks(_turns(s, d), F.concat(F.lit("[00:01:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(".5] "), "role", F.lit("\n  and more\n"))).select(F.col("doc_id").alias("src"), F.concat(F.lit("intro\n"), "text").alias("text"))), f"WITH {_C} SELECT conv_id AS src, nth - 1 AS seg_no, '00:01:' || lpad(CAST(turn AS VARCHAR), 2, '0') || '.5' AS mark, role || ' and more' AS text FROM c")
_add("front_matter", lambda s, d: markup.front_matter(_table(s, d, "documents").select(F.col("doc_id").alias("card"), F.concat(F.lit("---\nname: "), "source", F.lit("\nlang:  "), "lang", F.lit("\n---\nbody: not this")).alias("text"))), "SELECT doc_id AS card, unnest(['name', 'lang']) AS key, unnest([source, lang]) AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
_add("use_cases", lambda s, d: _table(s, d, "documents").select("doc_id", F.array_join(catalogue.use_cases(F.concat(F.lit("适用：- read "), "source", F.lit("；不做 this；read "), "source", F.lit(";ok。write "), "lang", F.lit(" well"))), "|").alias("uses")), "SELECT doc_id, 'read ' || source || '|write ' || lang || ' well' AS uses FROM documents")
_add("source_ratio", lambda s, d: _table(s, d, "documents").select("doc_id", catalogue.source_ratio(F.concat(F.when(F.col("lang") == "en", "[一手] [二手] [一手]").otherwise(""), F.when(F.col("n_chars") > 500, "[二手]").otherwise(""))).alias("ratio")), "SELECT doc_id, CASE WHEN lang = 'en' THEN 2 / CASE WHEN n_chars > 500 THEN 4 ELSE 3 END WHEN n_chars > 500 THEN 0.0 END AS ratio FROM documents")
_add(
    "speakers",
    lambda s, d: sessions.speakers(_table(s, d, "conversations").select(F.concat(F.when(F.col("turn") > 2, F.col("role")).otherwise(F.substring(F.regexp_replace("text", " ", ""), 1, 3)), F.lit(" : "), "text").alias("text"))),
    "SELECT speaker, count(*) AS n FROM (SELECT trim(regexp_extract(CASE WHEN turn > 2 THEN role ELSE substr(replace(text, ' ', ''), 1, 3) END || ' : ' || text, '^\\s*([A-Za-z][^\\s:：]{0,11}|[\\x{4E00}-\\x{9FFF}]{2,6})\\s*[:：]', 1)) AS speaker FROM conversations) WHERE speaker <> '' GROUP BY speaker HAVING count(*) >= 2",
)
_add(
    "document_stats",
    lambda s, d: stats.document_stats(_table(s, d, "documents").withColumn("text", F.when(F.col("lang") == "de", F.translate("text", _ABC, _HAN)).otherwise(F.col("text")))),
    f"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'de' THEN translate(text, '{_ABC}', '{_HAN}') ELSE text END AS text FROM documents), u AS (SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[\\x{{4E00}}-\\x{{9FFF}}]')) AS z, {_UNITS} AS units FROM t)
SELECT doc_id, CAST(units AS BIGINT) AS units, CAST(floor(z + (length(text) - z) * 0.35::DOUBLE) AS BIGINT) AS tokens, CASE WHEN len(regexp_extract_all(substr(text, 1, 4000), '[\\x{{4E00}}-\\x{{9FFF}}]')) * 20 > length(substr(text, 1, 4000)) THEN 'zh' ELSE 'en' END AS family FROM u""",
)


def _editions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents; and a later edition: Spanish ones gone, German ones in capitals, passages added under negative ids."""
    docs = _table(s, d, "documents").select("doc_id", "lang", "text")
    later = docs.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")).alias("text"))
    return docs, later.union(_table(s, d, "benchmark").select(-F.col("item_id") - 1, "text"))


_EDITIONS = """a AS (SELECT doc_id, sha256(coalesce(text, '')) AS x FROM documents), b AS (SELECT doc_id, sha256(coalesce(CASE WHEN lang = 'de' THEN upper(text) ELSE text END, '')) AS y FROM documents WHERE lang <> 'es' UNION ALL SELECT -item_id - 1, sha256(coalesce(text, '')) FROM benchmark), e AS (SELECT * FROM a FULL JOIN b USING (doc_id))"""
_add("version_diff", lambda s, d: catalogue.version_diff(*_editions(s, d)), f"WITH {_EDITIONS} SELECT doc_id, CASE WHEN x IS NULL THEN 'additive' WHEN y IS NULL THEN 'deletion' WHEN x <> y THEN 'modified' ELSE 'unchanged' END AS change FROM e")


def _drift(s: SparkSession, d: str) -> DataFrame:
    old, new = (x.select(F.col("doc_id").cast("string").alias("path"), F.sha2(_text(), 256).alias("hash")) for x in _editions(s, d))
    return catalogue.manifest_drift(old, new)


_add("manifest_drift", _drift, f"WITH {_EDITIONS} SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN y IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM e WHERE x IS NOT NULL AND (y IS NULL OR x <> y)")


def _outlines(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("line one\nline "), F.col("turn").cast("string"), F.lit("\n\n- item\n```\n# no heading\n```\n"))
    return _talks(_turns(s, d), F.concat(F.when(F.col("role") == "user", "# ").otherwise("### "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), body))


_PATHS = f"{_C}, o AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS up FROM c), h AS (SELECT *, CASE WHEN role = 'user' OR up IS NULL THEN role || ' ' || turn ELSE 'user ' || up || ' / ' || role || ' ' || turn END AS path FROM o)"
_PARTS = f"""{_PATHS}, e AS (SELECT conv_id AS doc_id, nth, path, unnest([0, 1, 2, 3]) AS k, unnest(['heading', 'paragraph', 'list', 'code']) AS type, unnest([CASE WHEN role = 'user' THEN '# ' ELSE '### ' END || role || ' ' || turn, 'line one' || chr(10) || 'line ' || turn, '- item', '```' || chr(10) || '# no heading' || chr(10) || '```']) AS text FROM h)"""
_add("markdown_elements", lambda s, d: segments.elements(_outlines(s, d)), f"WITH {_PARTS} SELECT doc_id, 4 * (nth - 1) + k AS seq, type, path, text FROM e")
_add("markdown_chunks", lambda s, d: segments.chunk_texts(segments.elements(_outlines(s, d)), 40), f"WITH {_PARTS} SELECT doc_id, 2 * (nth - 1) + CASE WHEN k = 3 THEN 1 ELSE 0 END AS chunk, path, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text, count(*) AS n_elements, k = 3 AS code FROM e GROUP BY doc_id, nth, path, k = 3")
_add("lexical_tokens", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(F.array_join(T.lexical_tokens(F.col("text")), "|")).alias("tokens")), f"SELECT doc_id, md5(array_to_string({_SPLIT.replace('X', 'text')}, '|')) AS tokens FROM documents")
_add(
    "cjk_tokens",
    lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(F.array_join(T.words(F.translate(F.substring(_text(), 1, 2000), "eao", "山水火")), "|")).alias("tokens")),
    """WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(translate(substr(coalesce(text, ''), 1, 2000), 'eao', '山水火')), '([\\x{4E00}-\\x{9FFF}]+)', ' \\1 ', 'g'), '[\\p{L}\\p{N}'']+') AS w FROM documents)
SELECT doc_id, md5(array_to_string(flatten(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[\\x{4E00}-\\x{9FFF}]') AND length(x) > 1 THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END)), '|')) AS tokens FROM t""",
)

_add(
    "person_rules",
    lambda s, d: linting.person_rules(_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("---\nname: x\nsubject_type: "), F.when(F.col("lang") == "es", "book").otherwise("person"), F.lit("\n---\n你不是在模仿语气\n## 我看问题的方式 way\n"), F.when(F.col("lang") == "de", "1. look\n").otherwise("see\n"), F.lit("## 内在矛盾\n我明确不懂的 信念及其来源\n"), F.when(F.col("n_chars") > 500, "我绝不会做的事 [一手]").otherwise("")).alias("text"))),
    "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS name, lang, n_chars FROM documents WHERE lang <> 'es') SELECT name, 'error' AS level, 'steps_as_way' AS rule FROM d WHERE lang = 'de' UNION ALL SELECT name, 'error', 'no_red_lines' FROM d WHERE n_chars <= 500 UNION ALL SELECT name, 'warn', 'no_first_hand' FROM d WHERE n_chars <= 500",
)
