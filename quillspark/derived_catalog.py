"""Queries of cards, claims, grades, quotations and reports over tables that SQL makes from the given ones.

Each input is one SQL text that Spark and DuckDB both run; the twins compute their answers from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anchoring, catalogue, diffs, linting, measures, merging, quotations, scoring, stats
from .plans.derived import Derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


# grades, reviews and cards

ANSWERS = Derived("answers", "SELECT doc_id AS case_id, CASE WHEN lang = 'en' THEN ' ' || source || ' ' WHEN lang = 'de' THEN ' None' WHEN lang = 'fr' THEN 'n/a' ELSE substr(text, 1, CAST(n_chars % 3 AS INT)) END AS selected FROM {documents}")
SCORES = Derived("s", "SELECT 'd' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) AS subject, CAST(CASE WHEN n_chars % 17 = 0 THEN NULL WHEN n_chars % 29 = 0 THEN 130 ELSE 80 + n_chars % 14 END AS DOUBLE) AS score FROM {documents}")
_GRADES = ("SELECT 'd' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) AS subject, 'g' || CAST(doc_id % 3 AS STRING) AS grader, '{name}' AS dimension, CAST({most} - n_chars % {span} AS INT) AS score FROM {{documents}}").format
GRADES = Derived("g", " UNION ALL ".join(_GRADES(name=name, most=most, span=5 + i) for i, (name, most) in enumerate(scoring.MOST_POINTS.items())))
HITS = Derived("h", "SELECT conv_id AS subject, turn AS run, CASE WHEN role = 'user' THEN 'without' ELSE 'with' END AS arm, length(coalesce(text, '')) > 90 AS hit FROM {conversations}")
REVIEWS = Derived("r", "SELECT 'c' || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) AS card, CASE WHEN lang = 'en' THEN 'self' WHEN lang = 'de' THEN 'cross_model' ELSE 'human' END AS reviewer_type, CASE WHEN n_chars % 5 = 0 THEN 'none' ELSE 'A' END AS grade, n_chars % 7 = 0 AS fabricated FROM {documents}")
CARDS = Derived("c", """SELECT CASE WHEN lang = 'en' THEN source || '-' || CAST(n_chars AS STRING) WHEN lang = 'de' THEN 'Bad_' || source ELSE source || '-' || lang END AS slug, substr(text, 1, CAST(n_chars % 60 AS INT)) AS description,
CASE WHEN lang = 'fr' THEN '../' || source ELSE source || '/' || lang END AS src, source || CAST(CAST(floor(doc_id / 60) AS BIGINT) AS STRING) AS bundle, n_chars % 2 = 0 AS promoted, n_chars % 3 > 0 AS trigger_ready FROM {documents}""")
RELATIONS = Derived("rel", "SELECT 'c' || CAST(conv_id AS STRING) AS slug, 'c' || CAST(conv_id + 7 * turn AS STRING) AS target, CASE WHEN role = 'user' THEN 'depends_on' ELSE 'contrasts_with' END AS relation FROM {conversations}")
NAMES = Derived("c", "SELECT DISTINCT 'c' || CAST(conv_id AS STRING) AS slug FROM {conversations}")
FAILURES = Derived("f", "SELECT source AS category, 'P' || CAST(n_chars % 4 AS STRING) AS severity FROM {documents}")

_add("normal_answers", lambda s, d: ANSWERS.df(s, d).select("case_id", scoring.normal_answer(F.col("selected")).alias("answer")), f"WITH {ANSWERS.cte} SELECT case_id, CASE WHEN lower(trim(selected)) IN ('none', 'null', 'nil', 'n/a', 'na', '-', '', '无', '不适用') THEN NULL ELSE trim(selected) END AS answer FROM answers")
_add("cross_review", lambda s, d: scoring.cross_review(SCORES.df(s, d)), f"""WITH {SCORES.cte}, b AS (SELECT subject, count(score) AS scorers, max(score) - min(score) AS spread, bool_or(score < 0 OR score > 100) AS bad FROM s GROUP BY subject)
SELECT subject, scorers, CAST(spread AS DOUBLE) AS spread, CASE WHEN scorers = 0 OR bad THEN 'error' WHEN scorers < 2 THEN 'insufficient_scorers' WHEN spread > 10 THEN 'needs_human_review' ELSE 'pass' END AS verdict, coalesce(scorers >= 2 AND abs(spread - 10) <= 1, false) AS fragile FROM b""")
_add("merged_grades", lambda s, d: scoring.merged_grades(GRADES.df(s, d)), f"""WITH {GRADES.cte}, dim AS (SELECT subject, dimension, CAST(round_even(avg(score), 0) AS BIGINT) AS p FROM g GROUP BY ALL), t AS (SELECT subject, CAST(sum(p) AS BIGINT) AS total FROM dim GROUP BY subject),
o AS (SELECT subject, count(*) AS graders, CAST(max(t) - min(t) AS BIGINT) AS gap FROM (SELECT subject, grader, sum(score) AS t FROM g GROUP BY ALL) GROUP BY subject)
SELECT subject, total, graders, gap, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' ELSE 'D' END AS grade, CASE WHEN graders < 2 THEN 'insufficient' WHEN gap > 10 THEN 'rejected' ELSE 'pass' END AS verdict FROM t JOIN o USING (subject)""")
_add("utility_gain", lambda s, d: scoring.utility(HITS.df(s, d)), f"""WITH {HITS.cte}, b AS (SELECT subject, count(*) FILTER (arm = 'with' AND hit) AS with_card, count(*) FILTER (arm = 'without' AND hit) AS without_card FROM h GROUP BY subject)
SELECT *, with_card - without_card AS delta, CASE WHEN with_card - without_card >= 2 AND with_card >= 3 AND without_card <= 1 THEN 'significant' WHEN with_card - without_card >= 1 THEN 'moderate' ELSE 'none' END AS level FROM b""")
_VALID = "count(*) FILTER (NOT fabricated AND grade <> 'none' AND reviewer_type IN ('cross_model', 'human'))"
_add("review_ledger", lambda s, d: scoring.review_ledger(REVIEWS.df(s, d)), f"WITH {REVIEWS.cte} SELECT card, count(*) AS reviews, {_VALID} AS valid, {_VALID} >= 1 AS independent FROM r GROUP BY card")
_READY = "count(*) FILTER (promoted AND trigger_ready)"
_add("output_strategy", lambda s, d: scoring.output_strategy(CARDS.df(s, d)), f"WITH {CARDS.cte} SELECT bundle, count(*) AS cards, {_READY} AS ready, CASE WHEN {_READY} >= 3 THEN 'pack' ELSE 'single' END AS strategy, count(*) > 8 AS over_budget FROM c GROUP BY bundle")
_add("failure_counts", lambda s, d: scoring.failure_counts(FAILURES.df(s, d)), f"WITH {FAILURES.cte} SELECT category, severity, count(*) AS n FROM f GROUP BY ALL")
_add("bundle_rules", lambda s, d: catalogue.bundle_rules(CARDS.df(s, d)), f"""WITH {CARDS.cte} SELECT slug, 'bad_slug' AS rule FROM c WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT slug, CASE WHEN length(coalesce(description, '')) = 0 THEN 'no_description' ELSE 'short_description' END FROM c WHERE length(coalesce(description, '')) < 40
UNION ALL SELECT slug, 'escaping_src' FROM c WHERE src LIKE '/%' OR src LIKE '../%' UNION ALL SELECT slug, 'duplicate_slug' FROM c GROUP BY slug HAVING count(*) > 1""")
_add("dependencies", lambda s, d: catalogue.dependencies(RELATIONS.df(s, d), NAMES.df(s, d)), f"WITH {RELATIONS.cte}, {NAMES.cte} SELECT slug, target, relation, CASE WHEN target IN (SELECT slug FROM c) THEN 'edge' ELSE 'orphan' END AS state FROM rel")
_add("impact", lambda s, d: catalogue.impact(RELATIONS.df(s, d), "c56"), f"WITH {RELATIONS.cte} SELECT DISTINCT slug FROM rel WHERE target = 'c56'")


# quotations


def _bare(x: str) -> str:
    out = f"regexp_replace(replace({x}, '&amp;', '&'), '\\*', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '[—–]|--+', '-', 'g'), '…|\\.\\.\\.', ' ', 'g'), '\\s+', ' ', 'g'))"


_PARTS = r"list_filter(list_transform(regexp_split_to_array(q, '[,;:!?]|\.\s'), lambda x: trim(x)), lambda x: length(x) >= 8)"


def _loose(body: str) -> str:
    hits = f"len(list_filter(parts, lambda p: contains({body}, p)))"
    return f"(length(q) > 0 AND (contains({body}, q) OR {hits} >= 2 OR len(list_filter(parts, lambda p: contains({body}, p) AND length(p) >= 18)) > 0))"


_STAMP = "'00:' || lpad(CAST(CAST(floor({t} / 60) AS BIGINT) AS STRING), 2, '0') || ':' || lpad(CAST({t} % 60 AS STRING), 2, '0')"
CUES = Derived("c", f"SELECT CAST(conv_id AS STRING) AS file, {_STAMP.format(t='turn')} AS stamp, coalesce(text, '') AS text FROM {{conversations}}")
CLAIMS = Derived("k", f"""SELECT conv_id * 1000 + turn AS claim_id, CAST(conv_id AS STRING) AS file, CASE WHEN turn % 4 = 1 THEN {_STAMP.format(t='(turn - 1)')} WHEN turn % 4 = 3 AND conv_id % 5 = 0 THEN '00:59:59' ELSE {_STAMP.format(t='turn')} END AS stamp,
CASE WHEN turn % 4 = 2 THEN substr(text, 3, 70) || ' forged tail never said anywhere' WHEN turn % 4 = 3 THEN substr(text, greatest(1, length(text) - 90), 91) || ' and on' ELSE '*' || text || '...' END AS quote FROM {{conversations}} WHERE text IS NOT NULL""")
_CHECKED = f"""{CUES.cte}, {CLAIMS.cte}, b AS (SELECT file, stamp, {_bare('text')} AS body FROM c), m AS (SELECT *, concat_ws(' ', body, lead(body, 1) OVER w, lead(body, 2) OVER w) AS more FROM b WINDOW w AS (PARTITION BY file ORDER BY stamp)),
q AS (SELECT *, {_PARTS} AS parts, greatest(12, length(q) // 2) AS n FROM (SELECT claim_id, file, stamp, {_bare('quote')} AS q FROM k)), j AS (SELECT q.*, m.body, m.more, NOT contains(body, q) AND length(q) > n AND contains(body, q[1:n]) AND NOT contains(body, q[n + 1:]) AS cut FROM q LEFT JOIN m USING (file, stamp)),
st AS (SELECT *, CASE WHEN body IS NULL THEN 'orphaned' WHEN {_loose('body')} OR cut AND {_loose('more')} THEN 'verified' ELSE 'open' END AS st FROM j),
pl AS (SELECT st.claim_id, m.stamp, row_number() OVER (PARTITION BY st.claim_id ORDER BY m.stamp) AS nth FROM st JOIN m ON m.file = st.file WHERE st = 'open' AND {_loose('m.body')}),
g AS (SELECT claim_id, string_agg(stamp, ' ' ORDER BY stamp) AS places FROM pl WHERE nth <= 3 GROUP BY claim_id), v AS (SELECT claim_id, file, CASE WHEN st <> 'open' THEN st WHEN places IS NOT NULL THEN 'misplaced' ELSE 'unverified' END AS status, coalesce(places, '') AS places FROM st LEFT JOIN g USING (claim_id))"""
_add("checked_stamps", lambda s, d: quotations.checked_stamps(CLAIMS.df(s, d), CUES.df(s, d)), f"WITH {_CHECKED} SELECT claim_id, status, places FROM v")
_add(
    "stamp_accounting",
    lambda s, d: anchoring.verify_accounting(quotations.checked_stamps(CLAIMS.df(s, d), CUES.df(s, d)).withColumn("quoted", F.lit(True))),
    f"""WITH {_CHECKED}, a AS (SELECT count(*) AS refs, count(*) AS quotes, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'misplaced') AS misplaced, count(*) FILTER (status = 'orphaned') AS orphaned FROM v)
SELECT *, 0::BIGINT AS unquoted, 0::BIGINT AS locator_only, 0::BIGINT AS lang_skipped, true AS balanced, CASE WHEN unverified + misplaced + orphaned > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM a""",
)

_QUOTED = "substr(coalesce(text, ''), CAST(1 + floor(length(coalesce(text, '')) / 3) AS INT), 55)"
REFERRING = Derived("t", f"""SELECT doc_id, 'see 【第' || CAST(doc_id AS STRING) || '条】「' || {_QUOTED} || '」 and 【第' || CAST(doc_id + 1 AS STRING) || '条】「' || {_QUOTED} || '」【第' || CAST(doc_id + 900000000 AS STRING) || '条】 says 「' || {_QUOTED} || '」 【第' || CAST(doc_id AS STRING) || '条】 without' AS text FROM {{documents}}""")
ENTRIES = Derived("e", "SELECT doc_id AS entry, text FROM {documents}")
_add(
    "checked_references",
    lambda s, d: quotations.checked_references(quotations.entry_references(REFERRING.df(s, d)), ENTRIES.df(s, d)),
    f"""WITH d AS (SELECT doc_id, {_bare(_QUOTED)} AS q FROM documents), e AS (SELECT doc_id AS entry, {_bare("text")} AS body FROM documents), r AS (SELECT doc_id, unnest([1, 2, 3, 4])::BIGINT AS pos, unnest([doc_id, doc_id + 1, doc_id + 900000000, doc_id]) AS entry, unnest([q, q, q, '']) AS q FROM d)
SELECT doc_id, pos, r.entry, CASE WHEN length(q) < 8 THEN 'unquoted' WHEN body IS NULL THEN 'orphaned' WHEN contains(body, q) THEN 'verified' ELSE 'unverified' END AS status FROM r LEFT JOIN e USING (entry)""",
)

SOURCES = Derived("s", "SELECT CAST(dense_rank() OVER (ORDER BY length(source) DESC, source) AS INT) AS src_no, source AS src, doc_id AS seg FROM {documents} WHERE source IS NOT NULL")
ASKED = Derived("q", "SELECT doc_id AS claim_id, CASE WHEN lang = 'en' THEN ' SRC-' || substr(source, 4) WHEN lang = 'de' THEN upper(source) WHEN lang = 'fr' THEN NULL ELSE lang || source END AS src, doc_id + n_chars % 2 AS seg FROM {documents}")
_add(
    "resolved_claims",
    lambda s, d: quotations.resolved_claims(ASKED.df(s, d), SOURCES.df(s, d)),
    f"""WITH {SOURCES.cte}, {ASKED.cte}, n AS (SELECT DISTINCT src_no, src AS name FROM s), r AS (SELECT claim_id, seg, lower(trim(coalesce(src, ''))) AS raw FROM q),
b AS (SELECT DISTINCT ON (raw) raw, name FROM (SELECT DISTINCT raw FROM r) JOIN n ON raw = name OR contains(lower(name), regexp_replace(raw, '^src-', '')) ORDER BY raw, CASE WHEN raw = name THEN 0 ELSE 1 END, src_no)
SELECT claim_id, name AS src, r.seg, CASE WHEN name IS NULL THEN 'unknown_source' WHEN EXISTS (SELECT 1 FROM s WHERE s.src = name AND s.seg = r.seg) THEN 'found' ELSE 'unknown_segment' END AS status FROM r LEFT JOIN b USING (raw)""",
)

STAMPED = Derived("t", f"""SELECT conv_id * 1000 + turn AS doc_id, '[' || {_STAMP.format(t='turn')} || ']、[00:01:' || lpad(CAST(turn % 60 AS STRING), 2, '0') || ',50] ' || coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) || 'see 【' || {_STAMP.format(t='conv_id')} || '】 and then [00:00:04.10]和[00:00:05]' AS text FROM {{conversations}}""")
_ONE = r"[\[【]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
_add(
    "stamp_groups",
    lambda s, d: quotations.stamp_groups(STAMPED.df(s, d)),
    rf"""WITH {STAMPED.cte}, l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM t)),
g AS (SELECT doc_id, line, unnest(range(0, len(r))) AS grp, unnest(r) AS run FROM (SELECT doc_id, line, regexp_extract_all(text, '{_ONE}(?:[\]】\s、,，/和及]*{_ONE})*') AS r FROM l))
SELECT doc_id, line, grp, replace(unnest(regexp_extract_all(run, '[\[【](\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)', 1)), ',', '.') AS stamp FROM g""",
)

REPEATS = Derived("t", "SELECT CAST(conv_id AS STRING) AS file, turn * 2 AS idx, text FROM {conversations} UNION ALL SELECT CAST(conv_id AS STRING), turn * 2 + 1, CASE WHEN turn % 3 = 0 THEN substr(text, 1, CAST(length(text) - 4 AS INT)) WHEN turn % 3 = 1 THEN replace(text, 'the', 'then') || ' so' ELSE '...' END FROM {conversations}")
_GRAMS3 = "CASE WHEN length({b}) <= 3 THEN [{b}] ELSE list_distinct(list_transform(range(1, length({b}) - 1), lambda i: substr({b}, i, 3))) END"
_SAME = "x.bare <> '' AND f.bare <> '' AND (contains(x.bare, f.bare) OR contains(f.bare, x.bare) OR len(list_intersect(x.g, f.g)) / (len(x.g) + len(f.g) - len(list_intersect(x.g, f.g))) >= 0.86)"
_add(
    "distinct_cues",
    lambda s, d: merging.distinct_cues(REPEATS.df(s, d)),
    rf"""WITH RECURSIVE {REPEATS.cte}, y AS (SELECT file, idx, text, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS bare, row_number() OVER (PARTITION BY file ORDER BY idx) AS n FROM t), x AS (SELECT *, {_GRAMS3.format(b='bare')} AS g FROM y),
f AS (SELECT file, n, idx, text, bare, g, 0 AS seen FROM x WHERE n = 1 UNION ALL SELECT f.file, x.n, CASE WHEN ({_SAME}) AND length(x.bare) <= length(f.bare) THEN f.idx ELSE x.idx END, CASE WHEN ({_SAME}) AND length(x.bare) <= length(f.bare) THEN f.text ELSE x.text END,
CASE WHEN ({_SAME}) AND length(x.bare) <= length(f.bare) THEN f.bare ELSE x.bare END, CASE WHEN ({_SAME}) AND length(x.bare) <= length(f.bare) THEN f.g ELSE x.g END, CASE WHEN {_SAME} THEN f.seen ELSE f.seen + 1 END FROM f JOIN x ON x.file = f.file AND x.n = f.n + 1)
SELECT file, arg_max(idx, n) AS idx, arg_max(struct_pack(v := text), n).v AS text FROM f GROUP BY file, seen""",
)

FINDINGS = Derived("t", """SELECT item_id * 3 AS item_id, 'a' AS lane, text, item_id % 2 = 0 AS first_hand FROM {benchmark} UNION ALL SELECT item_id * 3 + 1, 'b', replace(text, 'ing', 'ung') || ' end', item_id % 3 = 0 FROM {benchmark}
UNION ALL SELECT item_id * 3 + 2, 'c', substr(text, 1, CAST(floor(length(text) * 2 / 3) AS INT)), true FROM {benchmark}""")
_MERGED = rf"""{FINDINGS.cte}, y AS (SELECT item_id, first_hand, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS bare, row_number() OVER (ORDER BY item_id) AS n FROM t), x AS (SELECT *, {_GRAMS3.format(b='bare')} AS g FROM y),
sim AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS likeness FROM x a JOIN x b ON a.item_id < b.item_id WHERE a.bare <> '' AND b.bare <> ''),
near AS (SELECT x.item_id, x.n, coalesce(list(sim.a) FILTER (likeness >= 0.62), []) AS near FROM x LEFT JOIN sim ON sim.b = x.item_id GROUP BY ALL),
f AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS item_id, NULL::BIGINT AS leader UNION ALL SELECT near.n, CASE WHEN len(list_intersect(kept, near.near)) = 0 THEN list_append(kept, near.item_id) ELSE kept END, near.item_id, coalesce(list_min(list_intersect(kept, near.near)), near.item_id) FROM f JOIN near ON near.n = f.n + 1),
led AS (SELECT f.item_id, f.leader, coalesce(sim.likeness < 0.9 AND own.first_hand AND head.first_hand, false) AS conflict FROM f JOIN t own ON own.item_id = f.item_id JOIN t head ON head.item_id = f.leader LEFT JOIN sim ON sim.a = f.leader AND sim.b = f.item_id)"""
_add("merged_claims", lambda s, d: merging.merged_claims(FINDINGS.df(s, d)).select("item_id", "leader", "conflict"), f"WITH RECURSIVE {_MERGED} SELECT item_id, leader, conflict FROM led")
_add(
    "merge_totals",
    lambda s, d: merging.merge_totals(FINDINGS.df(s, d), merging.merged_claims(FINDINGS.df(s, d))),
    f"""WITH RECURSIVE {_MERGED}, h AS (SELECT leader, max(first_hand::INT) AS hand FROM led JOIN t USING (item_id) GROUP BY leader)
SELECT lane, count(*) AS items, count(leader) AS kept, coalesce(sum(hand), 0)::BIGINT AS first_hand FROM t LEFT JOIN h ON item_id = leader GROUP BY lane""",
)
QUOTES = Derived("q", "SELECT item_id AS quote_id, regexp_replace(replace(text, 'ing ', 'in '), 'th', 't', 1) AS quote FROM {benchmark}")
SAID = Derived("s", "SELECT item_id AS sent_id, text AS sentence FROM {benchmark}")

OWNED = Derived("t", f"""SELECT doc_id, '§' || CAST(doc_id AS STRING) || '「' || source || ' said ' || lang || '」 and 「not owned ' || source || '」' || chr(10) || '「before ' || source || '」 §7' || chr(10) || 'no locator 「alone ' || lang || '」' || chr(10) || '§9「first ' || source || '」／「second ' || lang || '」' AS text FROM {{documents}} WHERE source IS NOT NULL AND lang IS NOT NULL""")
_add("owned_quotes", lambda s, d: quotations.owned_quotes(OWNED.df(s, d)), "WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT doc_id, 0::BIGINT AS line, source || ' said ' || lang AS quote FROM d UNION ALL SELECT doc_id, 1, 'before ' || source FROM d UNION ALL SELECT doc_id, 3, 'first ' || source FROM d UNION ALL SELECT doc_id, 3, 'second ' || lang FROM d")
BLOCKS = Derived("t", "SELECT conv_id * 1000 + turn AS doc_id, '> 「one」' || chr(10) || '>' || chr(10) || chr(10) || '> —— 《书》第' || CAST(turn + 1 AS STRING) || '段' || chr(10) || 'text' || chr(10) || '> 「two」' || chr(10) || '> —— 同上' || chr(10) || CASE WHEN role = 'user' THEN 'text' ELSE '> 第' || CAST(turn + 2 AS STRING) || '条' END || chr(10) || '> 「three」' AS text FROM {conversations}")
_add(
    "block_targets",
    lambda s, d: quotations.block_targets(BLOCKS.df(s, d)),
    f"""WITH RECURSIVE {BLOCKS.cte}, l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)), n AS (SELECT *, starts_with(ltrim(text), '>') AS quoted, TRY_CAST(regexp_extract(text, '第(\\d+)[段条]', 1) AS BIGINT) AS number FROM l),
b AS (SELECT *, CASE WHEN quoted THEN coalesce(number, CASE WHEN contains(text, '同上') THEN (SELECT arg_max(m.number, m.line) FROM n m WHERE m.doc_id = n.doc_id AND m.line <= n.line AND m.quoted AND m.number IS NOT NULL) END) END AS sign, (SELECT count(*) FROM n m WHERE m.doc_id = n.doc_id AND m.line <= n.line AND NOT m.quoted AND trim(m.text) <> '') AS block FROM n)
SELECT doc_id, line, target FROM (SELECT doc_id, line, quoted, coalesce(CASE WHEN quoted THEN number END, (SELECT arg_min(m.sign, m.line) FROM b m WHERE m.doc_id = b.doc_id AND m.block = b.block AND m.line > b.line AND m.sign IS NOT NULL), sign) AS target FROM b) WHERE quoted AND target IS NOT NULL""",
)


# layers, rules, links

LAYERED = Derived("t", """SELECT 'd' || CAST(doc_id AS STRING) || CASE WHEN n_chars % 9 = 0 THEN '.Visual.md' WHEN n_chars % 11 = 0 THEN '-ai-transcript.txt' ELSE '.md' END AS name,
CASE WHEN n_chars % 5 = 0 THEN '<!-- SOURCE_LAYER: ai-observation -->' || chr(10) WHEN n_chars % 5 = 1 THEN '  # SOURCE_LAYER : user-supplied' || chr(10) WHEN n_chars % 5 = 2 THEN 'see SOURCE_LAYER: ai-observation' WHEN n_chars % 7 = 0 THEN '{{"layer": "ai-observation"}}' ELSE '' END || coalesce(text, '') || CASE WHEN n_chars % 4 = 0 THEN chr(10) || 'SOURCE_LAYER: ai-observation' ELSE '' END AS text FROM {documents}""")
LAYER_CARDS = Derived("k", "SELECT 'k' || CAST(doc_id AS STRING) AS name, CASE WHEN lang = 'de' THEN '出处: ' || source || '.visual-notes.md' WHEN lang = 'fr' THEN 'SOURCE_LAYER: ai-observation' || chr(10) || 'Source_Locator: x.vision.md' WHEN lang = 'es' THEN '{{\"layer\": \"ai-observation\"}}' ELSE text END AS text FROM {documents}")


def _layer(text: str, name: str) -> str:
    head = f"substr(coalesce({text}, ''), 1, 4000)"
    marked = rf"regexp_extract({head}, '(?m)^\s*(?:<!--|#|//|/\*)?\s*SOURCE_LAYER\s*:\s*(ai-observation|user-supplied)\b', 1)"
    hinted = " OR ".join(f"contains(lower({name}), '{x}')" for x in linting.OBSERVED_FILES)
    return rf"""CASE WHEN {marked} <> '' THEN {marked} WHEN regexp_matches({head}, '"layer"\s*:\s*"ai-observation"') OR {hinted} THEN 'ai-observation' ELSE 'verbatim' END"""


_add("layers", lambda s, d: LAYERED.df(s, d).select("name", linting.layer(F.col("text"), F.col("name")).alias("layer")), f"WITH {LAYERED.cte} SELECT name, {_layer('text', 'name')} AS layer FROM t")
_add(
    "layer_violations",
    lambda s, d: linting.layer_violations(LAYERED.df(s, d), LAYER_CARDS.df(s, d)),
    f"""WITH {LAYERED.cte}, {LAYER_CARDS.cte} SELECT name, 'corpus' AS violation FROM t WHERE {_layer('text', 'name')} = 'ai-observation' UNION ALL SELECT name, 'card' FROM (SELECT name, replace(text, '"layer"', '') AS x FROM k) WHERE {_layer('x', "''")} = 'ai-observation'
UNION ALL SELECT name, 'locator' FROM k WHERE regexp_matches(text, '{linting.OBSERVED_LOCATOR}')""",
)

LINKED = Derived("t", """SELECT 'c' || CAST(conv_id AS STRING) || '/t' || CAST(turn AS STRING) || '.md' AS path, '[next](t' || CAST(turn + 1 AS STRING) || '.md) [over](../c' || CAST(conv_id + 1 AS STRING) || '/t' || CAST(turn AS STRING) || '.md#part) [up](../../x' || CAST(turn AS STRING) || '.md) [web](https://x.y/' || role || ') `[code](no.md)`' || chr(10) || '```' || chr(10) || '[fenced](no.md)' || chr(10) || '```' || chr(10) || coalesce(text, '') || '[abs](/etc/' || role || ') [here](#h) [dir](../c' || CAST(conv_id + 2 AS STRING) || '/)' AS text FROM {conversations}""")
PATHS = Derived("f", "SELECT 'c' || CAST(conv_id AS STRING) || '/t' || CAST(turn AS STRING) || '.md' AS path FROM {conversations}")
_add(
    "dead_links",
    lambda s, d: linting.dead_links(LINKED.df(s, d), PATHS.df(s, d)),
    f"""WITH {PATHS.cte}, p AS (SELECT 'c' || conv_id || '/t' || turn || '.md' AS path, conv_id, turn, role FROM conversations), x AS (SELECT path, unnest(['t' || (turn + 1) || '.md', '../c' || (conv_id + 1) || '/t' || turn || '.md', '../c' || (conv_id + 2) || '/']) AS target, unnest(['c' || conv_id || '/t' || (turn + 1) || '.md', 'c' || (conv_id + 1) || '/t' || turn || '.md', 'c' || (conv_id + 2)]) AS spot FROM p)
SELECT path, target, 'dead' AS state FROM x WHERE spot NOT IN (SELECT path FROM f UNION ALL SELECT regexp_extract(path, '^[^/]*') FROM f) UNION ALL SELECT path, unnest(['../../x' || turn || '.md', '/etc/' || role]), 'escaping' FROM p""",
)


# costs, reports, prompts

VIDEOS = Derived("v", "SELECT doc_id AS video, CASE WHEN lang = 'en' THEN 'agent-slices' WHEN lang = 'de' THEN 'keyframes' ELSE 'full' END AS mode, CASE WHEN n_chars % 13 = 0 THEN NULL ELSE CAST(n_chars - 40 AS DOUBLE) END AS seconds FROM {documents}")
_M = measures
_add(
    "cost_estimate",
    lambda s, d: measures.cost_estimate(VIDEOS.df(s, d), 2.0, 8.0),
    f"""WITH {VIDEOS.cte}, x AS (SELECT video, mode, ceil(greatest(seconds, 0) / {_M.SLICE_SECONDS}) AS s, ceil(greatest(seconds, 0) / {_M.FRAME_SECONDS}) AS f, ceil(greatest(seconds, 0) / 60) AS m, seconds IS NOT NULL AS known FROM v),
c AS (SELECT video, CASE WHEN known THEN (CASE mode WHEN 'agent-slices' THEN s * {_M.SLICE_TOKENS[0]} WHEN 'keyframes' THEN f * {_M.FRAME_TOKENS[0]} ELSE m * {_M.MINUTE_TOKENS_IN} END)::BIGINT END AS tokens_in, CASE WHEN known THEN (CASE mode WHEN 'agent-slices' THEN s * {_M.SLICE_TOKENS[1]} WHEN 'keyframes' THEN f * {_M.FRAME_TOKENS[1]} ELSE s * {_M.FULL_SLICE_TOKENS_OUT} END)::BIGINT END AS tokens_out FROM x)
SELECT *, round((tokens_in * 2.0::DOUBLE + tokens_out * 8.0::DOUBLE) / 1000000, 4) AS cost FROM c""",
)
REPORTS = Derived("r", """SELECT doc_id AS name, '立场/结论一致性 ' || CAST(n_chars % 31 AS STRING) || '/30' || chr(10) || CASE WHEN lang = 'de' THEN '' ELSE '风格辨识度 得分：' || CAST(n_chars % 21 AS STRING) || chr(10) END || '边缘诚实度 ' || CASE WHEN lang = 'fr' THEN 'good' ELSE CAST(n_chars % 20 AS STRING) || ' / 20' END
|| chr(10) || '来源透明度 ' || CAST(n_chars % 15 AS STRING) || '/15' || chr(10) || '认知结构完整度 ' || CAST(n_chars % 14 AS STRING) || '/15' || chr(10) || CASE WHEN lang = 'es' THEN '' ELSE '**总分**：' || CAST(n_chars % 31 + n_chars % 21 + n_chars % 20 + n_chars % 15 + n_chars % 14 - n_chars % 2 AS STRING) END AS text FROM {documents}""")
_add(
    "parsed_reports",
    lambda s, d: measures.parsed_reports(REPORTS.df(s, d)),
    """WITH r AS (SELECT doc_id AS name, n_chars % 31 AS consistency, CASE WHEN lang <> 'de' THEN n_chars % 21 END AS style, CASE WHEN lang <> 'fr' THEN n_chars % 20 END AS edge_honesty, n_chars % 15 AS source_transparency, n_chars % 14 AS structure, CASE WHEN lang <> 'es' THEN n_chars % 31 + n_chars % 21 + n_chars % 20 + n_chars % 15 + n_chars % 14 - n_chars % 2 END AS declared FROM documents),
s AS (SELECT *, concat_ws(' ', CASE WHEN style IS NULL THEN 'style' END, CASE WHEN edge_honesty IS NULL THEN 'edge_honesty' END) AS unparsed, consistency + coalesce(style, 0) + coalesce(edge_honesty, 0) + source_transparency + structure AS summed FROM r) SELECT *, coalesce(declared <> summed, false) AS mismatch FROM s""",
)
BUNDLES = Derived("b", "SELECT conv_id AS bundle, 'p' || lpad(CAST(turn AS STRING), 4, '0') || '.md' AS path, turn = 2 AS entry, text FROM {conversations}")
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CUT_AT = "CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || chr(10) || chr(10) || '[cut at 200 of ' || length(t) || ' characters]' ELSE t END"
_add(
    "compiled_prompts",
    lambda s, d: measures.compiled_prompts(BUNDLES.df(s, d), 200),
    f"""WITH {BUNDLES.cte}, p AS (SELECT bundle, path, entry, CASE WHEN entry THEN {_TRIM.format('t')} ELSE '## ' || path || chr(10) || chr(10) || {_TRIM.format(_CUT_AT)} END AS piece FROM (SELECT bundle, path, entry, coalesce(text, '') AS t FROM b))
SELECT bundle, string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY entry DESC, path) AS prompt, count(*) AS n_files FROM p GROUP BY bundle""",
)

RULED = Derived("t", """SELECT 'd' || CAST(doc_id AS STRING) AS name, CASE WHEN n_chars % 19 = 0 THEN NULL ELSE '---' || chr(10) || CASE WHEN lang = 'en' THEN 'name: ' || source || '-card' WHEN lang = 'de' THEN 'name: Bad_' || source ELSE 'title: x' END || chr(10) || CASE WHEN n_chars % 3 = 0 THEN 'description: ' || substr(translate(coalesce(text, ''), chr(10), ' '), 1, CAST(n_chars % 70 AS INT)) || chr(10) WHEN n_chars % 3 = 1 THEN 'description: helps to decide when time is short; 不适用于 anything else at all' || chr(10) ELSE '' END || CASE WHEN n_chars % 4 = 0 THEN 'source_book: b' || chr(10) ELSE '' END || '---' || chr(10)
|| CASE WHEN n_chars % 5 < 3 THEN '## E — Execution' || chr(10) || CASE WHEN n_chars % 5 = 1 THEN '**Step 1 · x**' || chr(10) || '完成标准: done' || chr(10) ELSE '' END ELSE '' END || CASE WHEN n_chars % 7 < 4 THEN '## B - 边界' || chr(10) || CASE WHEN n_chars % 7 = 1 THEN '失败模式: y' || chr(10) ELSE '' END ELSE '' END
|| CASE WHEN n_chars % 11 < 6 THEN '## claim status' || chr(10) || CASE WHEN n_chars % 11 < 2 THEN '- [原文] said' || chr(10) WHEN n_chars % 11 < 4 THEN '- unmarked' || chr(10) ELSE 'no list' || chr(10) END || '## End' || chr(10) ELSE '' END END AS text FROM {documents}""")
_SAYS = {
    "error": {
        "no_name": "lang IN ('en', 'de')", "bad_name": "lang <> 'de'", "no_description": "about <> ''", "no_completion": "NOT e OR n % 5 = 1", "no_failure_modes": "NOT (e AND b) OR n % 7 = 1",
        "empty_claim_status": "NOT st OR n % 11 < 4", "unmarked_claims": "NOT st OR n % 11 NOT IN (2, 3)",
    },
    "warn": {
        "short_description": "length(about) >= 40", "no_exclusion": "regexp_matches(about, '不做|不适用|不要用于|不用于')", "no_execution": "e", "no_steps": "NOT e OR n % 5 = 1", "no_boundary": "NOT e OR b", "no_source": "n % 4 = 0", "no_claim_status": "st",
    },
}
_RULE_ROWS = " UNION ALL ".join(f"SELECT name, '{level}' AS level, '{rule}' AS rule FROM c WHERE NOT ({holds})" for level, rules in _SAYS.items() for rule, holds in rules.items())
_BARE_CARD = "('error', 'no_name'), ('error', 'no_description'), ('warn', 'short_description'), ('warn', 'no_exclusion'), ('warn', 'no_execution'), ('warn', 'no_source'), ('warn', 'no_claim_status')"
_add(
    "card_rules",
    lambda s, d: linting.card_rules(RULED.df(s, d)),
    f"""WITH a AS (SELECT 'd' || doc_id AS name, n_chars AS n, lang, n_chars % 5 < 3 AS e, n_chars % 7 < 4 AS b, n_chars % 11 < 6 AS st, trim(CASE n_chars % 3 WHEN 0 THEN substr(translate(coalesce(text, ''), chr(10), ' '), 1, (n_chars % 70)::INT) WHEN 1 THEN 'helps to decide when time is short; 不适用于 anything else at all' ELSE '' END) AS about FROM documents),
c AS (SELECT * FROM a WHERE n % 19 <> 0) {_RULE_ROWS} UNION ALL SELECT name, level, rule FROM (SELECT name FROM a WHERE n % 19 = 0), (VALUES {_BARE_CARD}) AS v(level, rule)""",
)
_add("best_sentences", lambda s, d: quotations.best_sentences(QUOTES.df(s, d), SAID.df(s, d)).select("quote_id", "sent_id"), None)


# sentences, differences, promoted quotations

_SENTENCES = r"regexp_split_to_array(coalesce(text, ''), '[。！？；!?;]+')"
_add(
    "sentence_lengths",
    lambda s, d: stats.sentence_lengths(s.read.parquet(f"{d}/documents.parquet"), "source", 2000),
    rf"""WITH n AS (SELECT source, length(regexp_replace(unnest({_SENTENCES}), '\s+', '', 'g')) AS n FROM documents), g AS (SELECT source, sum(n)::BIGINT AS chars, count(*) FILTER (n > 0) AS sentences, round(avg(n) FILTER (n > 0), 1) AS m, round(stddev_pop(n) FILTER (n > 0), 1) AS sd, min(n) FILTER (n > 0)::BIGINT AS lo, max(n) FILTER (n > 0)::BIGINT AS hi FROM n GROUP BY source)
SELECT source, chars, CASE WHEN chars >= 2000 THEN 'ok' ELSE 'insufficient' END AS state, CASE WHEN chars >= 2000 THEN sentences END AS sentences, CASE WHEN chars >= 2000 THEN m END AS mean_chars, CASE WHEN chars >= 2000 THEN sd END AS stdev_chars, CASE WHEN chars >= 2000 THEN lo END AS shortest, CASE WHEN chars >= 2000 THEN hi END AS longest FROM g""",
)



def _editions(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, old, new): a line for each turn of a conversation, one of them edited."""
    line = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" of "), F.coalesce("role", F.lit("")))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("l")))), lambda x: x["l"]), "\n")
    return s.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id")).agg(told(line).alias("old"), told(F.when(F.col("turn") == 1, "edited").otherwise(line)).alias("new"))


_add(
    "line_differences",
    lambda s, d: _editions(s, d).select("doc_id", F.posexplode(diffs.unified_diff(F.col("old"), F.col("new"))).alias("nth", "line")).select("doc_id", F.col("nth").cast("long").alias("nth"), "line"),
    """WITH n AS (SELECT conv_id AS doc_id, turn, 'turn ' || turn || ' of ' || coalesce(role, '') AS l, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), o AS (SELECT doc_id, 3 + turn AS spot, CASE WHEN turn = 1 THEN '-' ELSE ' ' END || l AS line FROM n WHERE turn < 5 AND turn <= 1 UNION ALL SELECT doc_id, 5, '+edited' FROM n WHERE turn = 1
UNION ALL SELECT doc_id, 4 + turn, ' ' || l FROM n WHERE turn BETWEEN 2 AND 4 UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['--- ', '+++ ', '@@ -1,' || least(n, 5) || ' +1,' || least(n, 5) || ' @@']) FROM n WHERE turn = 1)
SELECT doc_id, spot::BIGINT AS nth, line FROM o""",
)
_MARKED = "CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN ' §' || CAST(turn AS STRING) ELSE '' END"
_HAN = "translate(lpad(CAST((conv_id * 31 + turn * 7) % 10000 AS STRING), 4, '0'), '0123456789', '零一二三四五六七八九')"
QUOTING = Derived("t", f"SELECT conv_id * 1000 + turn AS doc_id, '「' || {_HAN} || '」' || {_MARKED} AS text FROM {{conversations}}")
HELD_BY = Derived("g", f"SELECT conv_id * 1000 + turn AS seg, '前 ' || {_HAN} || '后' || coalesce(text, '') AS text FROM {{conversations}} WHERE turn % 2 = 1")


def _promoted(s: SparkSession, d: str) -> DataFrame:
    quotes = quotations.anchor_quotes(QUOTING.df(s, d))
    located = QUOTING.df(s, d).filter("text like '%§%'").select("doc_id", F.lit(0).cast("long").alias("line"))
    return anchoring.promoted_quotes(quotes, HELD_BY.df(s, d), located)


_add(
    "promoted_quotes",
    _promoted,
    f"""WITH {QUOTING.cte}, {HELD_BY.cte}, q AS (SELECT doc_id, regexp_extract(text, '「(.*)」', 1) AS quote, contains(text, '§') AS located FROM t)
SELECT doc_id, 0::BIGINT AS line, quote, CASE WHEN located AND EXISTS (SELECT 1 FROM g WHERE contains(g.text, q.quote)) THEN 'promoted' ELSE 'short' END AS kind FROM q""",
)
