"""The tokenisers, measures and segmenters as SQL functions of a session.

``register(spark)`` makes them known; scalar functions are SQL expressions that Spark plans like any
other, table functions are read with LATERAL::

    SELECT d.doc_id, c.chunk, c.text FROM documents d, LATERAL text_chunks(d.text, 1000) c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.tokens import CJK, PUNCTUATION, SEPARATORS
from .operators.overlap import SHINGLE

_LOW = "lower(coalesce(t, ''))"
_BLANKS = " " * len(SEPARATORS)
_SEPARATORS = SEPARATORS.replace("'", "\\'").replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")
_PUNCTUATION = PUNCTUATION.replace("'", "\\'")


def _tokens(text: str, inside: str) -> str:
    """Runs of ``inside``, those of CJK characters as bigrams."""
    pair = f"CASE WHEN w RLIKE '^[{CJK}]' THEN transform(sequence(1, greatest(length(w) - 1, 1)), i -> substring(w, i, 2)) ELSE array(w) END"
    return f"CASE WHEN {text} RLIKE '[{CJK}]' THEN flatten(transform(regexp_extract_all(regexp_replace({text}, '([{CJK}]+)', ' $1 '), {inside}, 0), w -> {pair})) ELSE regexp_extract_all({text}, {inside}, 0) END"


#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("text_words", "t STRING", "ARRAY<STRING>", _tokens(_LOW, 'r"[\\p{L}\\p{N}\']+"')),
    ("text_lexical_tokens", "t STRING", "ARRAY<STRING>", _tokens(f"translate({_LOW}, '{_SEPARATORS}', '{_BLANKS}')", "'[^ ]+'")),
    ("token_shingles", "w ARRAY<STRING>, n INT", "ARRAY<STRING>", "array_distinct(regexp_extract_all(array_join(w, ' '), concat('(?<![^ ])(?=([^ ]+(?: [^ ]+){', n - 1, '})(?![^ ]))'), 1))"),
    ("text_bare", "t STRING", "STRING", f"regexp_replace({_LOW}, r'[^\\p{{L}}\\p{{N}}]+', '')"),
    ("char_grams", "b STRING, n INT", "ARRAY<STRING>", "CASE WHEN b = '' THEN array() WHEN length(b) <= n THEN array(b) ELSE array_distinct(transform(sequence(1, length(b) - n + 1), i -> substring(b, i, n))) END"),
    ("set_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "size(array_intersect(a, b)) / (size(a) + size(b) - size(array_intersect(a, b)))"),
    ("text_fragment", "t STRING", "STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '&amp;', '&'), r'\*', ''), '[—–]|--+', '-'), r'…|\.\.\.', ' '), r'\s+', ' '))"),
    ("text_clean", "t STRING", "STRING", f"translate(regexp_replace(t, r'\\s+', ''), '{_PUNCTUATION}', '')"),
    ("unit_count", "t STRING", "BIGINT", f"regexp_count(coalesce(t, ''), '[{CJK}]') + regexp_count(coalesce(t, ''), \"[A-Za-z0-9']+\")"),
    ("token_estimate", "t STRING", "BIGINT", f"floor(regexp_count(coalesce(t, ''), '[{CJK}]') + (length(coalesce(t, '')) - regexp_count(coalesce(t, ''), '[{CJK}]')) * 0.35D)"),
    ("text_family", "t STRING", "STRING", f"CASE WHEN regexp_count(substring(t, 1, 4000), '[{CJK}]') * 20 > length(substring(t, 1, 4000)) THEN 'zh' ELSE 'en' END"),
    ("overlap_verdict", "n BIGINT, shared BIGINT", "STRING", "CASE WHEN n = 0 THEN 'TOO_SHORT' WHEN shared > n * 0.005D THEN 'FAIL' ELSE 'PASS' END"),
    ("text_lines", "t STRING", "TABLE (line INT, text STRING)", r"SELECT pos, col FROM (SELECT posexplode(split(regexp_replace(coalesce(t, ''), r'\r\n?', '\n'), '\n')))"),
    ("text_sentences", "t STRING", "TABLE (nth INT, text STRING)", r"SELECT pos, s FROM (SELECT pos, regexp_replace(col, r'^\s+|\s+\z', '') AS s FROM (SELECT posexplode(split(coalesce(t, ''), r'[.!?。！？\n]+')))) WHERE s <> ''"),
    ("text_shingles", "t STRING, n INT", "TABLE (shingle STRING)", "SELECT e.x FROM (SELECT token_shingles(text_words(t), n) AS a) s, LATERAL explode(s.a) AS e(x)"),
)


class _Chunks:
    """A text's lines packed in order, up to ``most`` characters a chunk, lines parted by a blank line."""

    def eval(self, text: str | None, most: int) -> Iterator[tuple[int, str, int]]:
        chunk, held, size = 0, [], 0
        for line in (text or "").split("\n"):
            if held and size + 2 + len(line) > most:
                yield chunk, "\n\n".join(held), len(held)
                chunk, held, size = chunk + 1, [line], len(line)
            else:
                size += len(line) + (2 if held else 0)
                held.append(line)
        yield chunk, "\n\n".join(held), len(held)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; again is no harm."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("text_chunks", F.udtf(_Chunks, returnType="chunk: bigint, text: string, n_elements: bigint"))


DOCUMENT_STATS = """WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN translate(text, 'etaoinshrdlu', '山水火木金土日月星天地人') ELSE text END AS text FROM {documents})
SELECT doc_id, unit_count(text) AS units, token_estimate(text) AS tokens, text_family(text) AS family FROM d"""
CONTAINMENT = f"""WITH n AS (SELECT doc_id, token_shingles(text_words(text), {SHINGLE}) AS s FROM {{documents}}),
own AS (SELECT doc_id, CAST(size(s) AS BIGINT) AS n_shingles, explode_outer(s) AS x FROM n),
old AS (SELECT DISTINCT xxhash64(s.shingle) AS h FROM {{benchmark}} b, LATERAL text_shingles(b.text, {SHINGLE}) s),
hit AS (SELECT doc_id, n_shingles, count(old.h) AS n_shared FROM (SELECT doc_id, n_shingles, CASE WHEN x IS NOT NULL THEN xxhash64(x) END AS h FROM own) o LEFT JOIN old ON old.h = o.h GROUP BY doc_id, n_shingles)
SELECT doc_id, n_shingles, n_shared, overlap_verdict(n_shingles, n_shared) AS verdict FROM hit"""
CHUNK_TEXTS = "SELECT d.doc_id, c.chunk, '' AS path, c.text, c.n_elements FROM {documents} d, LATERAL text_chunks(d.text, 1000) c"
