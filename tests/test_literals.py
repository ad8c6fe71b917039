"""Operators over small literal tables against the rows expected of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalogue, linting, measures, merging, quotations, scoring
from tests.literals import Literal

CASES = {}


def _add(name, query, sql):
    CASES[name] = (query, sql)


def _rows(columns, *rows):
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns})"


ANSWERS = Literal("answers", "case_id string, selected string", (("t-01", "a"), ("t-02", " a "), ("t-03", "a"), ("t-04", "b"), ("d-01", "None"), ("d-02", "b")))
SCORES = Literal("s", "subject string, score double", (("p", 95.0), ("p", 91.0), ("q", 95.0), ("q", 83.0), ("r", 95.0), ("r", 85.0), ("s", 95.0), ("t", None), ("u", 130.0), ("u", 90.0)))
GRADES = Literal("g", "subject string, grader string, dimension string, score int", tuple((s, g, d, v) for s, g, vs in (("x", "g1", (28, 19, 19, 12, 15)), ("x", "g2", (27, 18, 19, 11, 14)), ("y", "g1", (30, 20, 20, 15, 15)), ("y", "g2", (22, 14, 15, 11, 12)), ("z", "g1", (20, 10, 9, 8, 7))) for d, v in zip(("consistency", "style", "edge_honesty", "source_transparency", "structure"), vs, strict=True)))
HITS = Literal("h", "subject string, run int, arm string, hit boolean", tuple((s, i, arm, i < n) for s, a, b in (("m", 3, 0), ("n", 2, 1), ("o", 1, 1)) for arm, n in (("with", a), ("without", b)) for i in range(3)))
REVIEWS = Literal("r", "card string, reviewer_type string, grade string, fabricated boolean", (("c1", "cross_model", "A", False), ("c1", "self", "A", False), ("c2", "human", "none", False), ("c2", "human", "B", True), ("c3", "human", "B", False)))
CARDS = Literal("c", "slug string, description string, src string, bundle string, promoted boolean, trigger_ready boolean", (("good-card", "A description that is long enough to say what this is for.", "cards/a.md", "k", True, True), ("Bad_Slug", "short", "../b.md", "k", True, True), ("twin", None, "/c.md", "k", True, True), ("twin", "Another description that is long enough to pass the rule.", "d/e.md", "l", False, True)))
RELATIONS = Literal("rel", "slug string, target string, relation string", (("good-card", "twin", "contrasts_with"), ("twin", "good-card", "contrasts_with"), ("twin", "missing", "depends_on")))
FAILURES = Literal("f", "category string, severity string", (("locator", "P0"), ("locator", "P1"), ("locator", "P1"), ("cjk", "P0")))
OWNED = Literal("t", "doc_id long, text string", ((1, "§4「天行健君子以自強」 and「not owned here」\n「quote before」 §7\nno locator 「alone」\n§9「first of two」／「second of two」\nsrc-02 §3 said: much later \"far away quote\""), (2, "第3段「書中一句話」\n最重要的是第4段「叙述而已」"), (3, None)))
BLOCKS = Literal("t", "doc_id long, text string", ((1, "> 「one」\n>\n\n> —— 《書》第3段\ntext\n> 「two」\n> —— 同上\ntext\n> 「three」\nend"), (2, "> 「a」—— 同上\n> 第5段 「b」"), (3, "")))
ENTRIES = Literal("e", "entry long, text string", ((1, "the first entry holds a *long* quotation here"), (2, "nothing to see")))
REFERRING = Literal("t", "doc_id long, text string", ((1, "【第1条】「a long quotation here」 and 【第2条】「this is made up」【第9条】「an entry not there」 【第1条】 without"), (2, "【第1条】「short」"), (3, None)))
STAMPED = Literal("t", "doc_id long, text string", ((1, "[00:00:01]、[00:00:02.50] one quotation\nsee [00:00:03] and then [00:00:04,10]"), (2, "none")))
STAMP_CUES = Literal("c", "file string, stamp string, text string", (("f", "00:00:01", "the quick brown fox jumps over"), ("f", "00:00:02", "the lazy dog and sleeps all day"), ("f", "00:00:03", "something else entirely is said"), ("g", "00:00:01", "the quick brown fox jumps over")))
STAMP_CLAIMS = Literal("q", "claim_id long, file string, stamp string, quote string", ((1, "f", "00:00:01", "quick brown fox"), (2, "f", "00:00:01", "brown fox jumps over the lazy dog"), (3, "f", "00:00:01", "something else entirely"), (4, "f", "00:00:02", "words never spoken at all"), (5, "f", "00:09:00", "quick brown fox"), (6, "g", "00:00:01", "The quick brown fox, quick brown, fox jumps")))
SOURCES = Literal("s", "src_no int, src string, seg long", ((1, "01-lex-interview", 1), (1, "01-lex-interview", 2), (2, "03-forum", 1), (3, "forum", 7)))
CLAIMS = Literal("q", "claim_id long, src string, seg long", ((1, "src-03", 1), (2, "forum", 7), (3, None, 2), (4, "src-09", 1), (5, "SRC-01", 5)))
QUOTED = Literal("q", "quote_id long, quote string", ((1, "the cat sat on the mat"), (2, "completely different words"), (3, "short"), (4, "a long road goes ever on and on")))
SAID = Literal("s", "sent_id long, sentence string", ((1, "the cat sat on a mat"), (2, "the bat sat on the mat"), (3, "a long road goes on"), (4, "")))
FINDINGS = Literal("t", "item_id long, lane string, text string, first_hand boolean", ((1, "a", "the company was founded in a small garage", False), (2, "a", "the company was founded in a small garage.", True), (3, "b", "the company was founded in one small garage", True), (4, "b", "revenue doubled within three years", True), (5, "c", "revenue doubled within three full years", True), (6, "c", None, False)))
REPEATS = Literal("t", "file string, idx long, text string", (("a", 1, "hello there"), ("a", 2, "Hello there, friend"), ("a", 3, "Hello there"), ("a", 4, "..."), ("a", 5, "something new"), ("b", 1, "hello there"), ("b", 2, None)))
LAYERED = Literal("t", "name string, text string", (("a.md", "<!-- SOURCE_LAYER: ai-observation -->\ntext"), ("b.md", "talk of SOURCE_LAYER: ai-observation"), ("c.json", '{"layer": "ai-observation"}'), ("d.visual.md", None), ("e.md", "# SOURCE_LAYER: user-supplied"), ("f.md", "plain")))
LAYER_CARDS = Literal("k", "name string, text string", (("k1", "出处: d.visual-notes.md"), ("k2", "fine"), ("k3", "SOURCE_LAYER: ai-observation\nsource_locator: x.vision.md")))
RULED = Literal("t", "name string, text string", (
    ("good", "---\nname: good-card\ndescription: helps to decide between plans when time is short; 不适用于 others\nsource_book: b\n---\n## E — Execution\n**Step 1 · x**\n完成标准: done\n## B — Boundary\n失败模式: y\n## 来源状态\n- [原文] said\n- [通法] known\n## End\n- free"),
    ("poor", "---\nname: Poor_Card\n---\n## E - Execution\nno steps\n## B - 边界\n## claim status\n- unmarked\n"),
    ("bare", None),
))
LINKED = Literal("t", "path string, text string", (("a/one.md", "[ok](two.md) [up](../b/three.md#part) [dead](none.md) [out](../../x.md) [web](https://x.y) `[code](no.md)`\n```\n[fenced](no.md)\n```\n[abs](/etc/x) [here](#h) [dir](../b/)"), ("b/three.md", None)))
FILES = Literal("f", "path string", (("a/one.md",), ("a/two.md",), ("b/three.md",)))
VIDEOS = Literal("v", "video string, mode string, seconds double", (("a", "agent-slices", 601.0), ("b", "keyframes", 61.0), ("c", "full", 1200.0), ("d", "full", None), ("e", "keyframes", -5.0)))
REPORTS = Literal("r", "name string, text string", (("full", "立场/结论一致性 28/30\n风格辨识度 得分：18\n边缘诚实度 17 / 20\n来源透明度 12/15\n认知结构完整度 13/15\n**总分**：88"), ("part", "风格辨识度 18/20\n边缘诚实度 good\n总分 50"), ("none", None)))
BUNDLES = Literal("b", "bundle string, path string, entry boolean, text string", (("k", "z.md", True, "entry text\n"), ("k", "b.md", False, "second"), ("k", "a.md", False, "first, longer than twenty characters"), ("l", "e.md", True, None)))

_add("normal_answers", lambda s: ANSWERS.df(s).select("case_id", scoring.normal_answer(F.col("selected")).alias("answer")), f"WITH {ANSWERS.cte} SELECT case_id, CASE WHEN lower(trim(selected)) IN ('none', 'null', 'nil', 'n/a', 'na', '-', '', '无', '不适用') THEN NULL ELSE trim(selected) END AS answer FROM answers")
_add("cross_review", lambda s: scoring.cross_review(SCORES.df(s)), f"""WITH {SCORES.cte}, b AS (SELECT subject, count(score) AS scorers, max(score) - min(score) AS spread, bool_or(score < 0 OR score > 100) AS bad FROM s GROUP BY subject)
SELECT subject, scorers, CAST(spread AS DOUBLE) AS spread, CASE WHEN scorers = 0 OR bad THEN 'error' WHEN scorers < 2 THEN 'insufficient_scorers' WHEN spread > 10 THEN 'needs_human_review' ELSE 'pass' END AS verdict, coalesce(scorers >= 2 AND abs(spread - 10) <= 1, false) AS fragile FROM b""")
_add("merged_grades", lambda s: scoring.merged_grades(GRADES.df(s)), f"""WITH {GRADES.cte}, dim AS (SELECT subject, dimension, CAST(round_even(avg(score), 0) AS BIGINT) AS p FROM g GROUP BY ALL), t AS (SELECT subject, CAST(sum(p) AS BIGINT) AS total FROM dim GROUP BY subject),
o AS (SELECT subject, count(*) AS graders, CAST(max(t) - min(t) AS BIGINT) AS gap FROM (SELECT subject, grader, sum(score) AS t FROM g GROUP BY ALL) GROUP BY subject)
SELECT subject, total, graders, gap, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' ELSE 'D' END AS grade, CASE WHEN graders < 2 THEN 'insufficient' WHEN gap > 10 THEN 'rejected' ELSE 'pass' END AS verdict FROM t JOIN o USING (subject)""")
_add("utility_gain", lambda s: scoring.utility(HITS.df(s)), f"""WITH {HITS.cte}, b AS (SELECT subject, count(*) FILTER (arm = 'with' AND hit) AS with_card, count(*) FILTER (arm = 'without' AND hit) AS without_card FROM h GROUP BY subject)
SELECT *, with_card - without_card AS delta, CASE WHEN with_card - without_card >= 2 AND with_card >= 3 AND without_card <= 1 THEN 'significant' WHEN with_card - without_card >= 1 THEN 'moderate' ELSE 'none' END AS level FROM b""")
_add("review_ledger", lambda s: scoring.review_ledger(REVIEWS.df(s)), f"WITH {REVIEWS.cte} SELECT card, count(*) AS reviews, count(*) FILTER (NOT fabricated AND grade <> 'none' AND reviewer_type IN ('cross_model', 'human')) AS valid, count(*) FILTER (NOT fabricated AND grade <> 'none' AND reviewer_type IN ('cross_model', 'human')) >= 1 AS independent FROM r GROUP BY card")
_add("output_strategy", lambda s: scoring.output_strategy(CARDS.df(s)), f"WITH {CARDS.cte} SELECT bundle, count(*) AS cards, count(*) FILTER (promoted AND trigger_ready) AS ready, CASE WHEN count(*) FILTER (promoted AND trigger_ready) >= 3 THEN 'pack' ELSE 'single' END AS strategy, count(*) > 8 AS over_budget FROM c GROUP BY bundle")
_add("failure_counts", lambda s: scoring.failure_counts(FAILURES.df(s)), f"WITH {FAILURES.cte} SELECT category, severity, count(*) AS n FROM f GROUP BY ALL")
_add("bundle_rules", lambda s: catalogue.bundle_rules(CARDS.df(s)), f"""WITH {CARDS.cte} SELECT slug, 'bad_slug' AS rule FROM c WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT slug, CASE WHEN length(coalesce(description, '')) = 0 THEN 'no_description' ELSE 'short_description' END FROM c WHERE length(coalesce(description, '')) < 40
UNION ALL SELECT slug, 'escaping_src' FROM c WHERE src LIKE '/%' OR src LIKE '../%' UNION ALL SELECT slug, 'duplicate_slug' FROM c GROUP BY slug HAVING count(*) > 1""")
_add("dependencies", lambda s: catalogue.dependencies(RELATIONS.df(s), CARDS.df(s)), f"WITH {RELATIONS.cte}, {CARDS.cte} SELECT slug, target, relation, CASE WHEN target IN (SELECT slug FROM c) THEN 'edge' ELSE 'orphan' END AS state FROM rel")
_add("impact", lambda s: catalogue.impact(RELATIONS.df(s), "twin"), f"WITH {RELATIONS.cte} SELECT DISTINCT slug FROM rel WHERE target = 'twin'")
_add("owned_quotes", lambda s: quotations.owned_quotes(OWNED.df(s)), _rows("doc_id, line, quote", "(1::BIGINT, 0::BIGINT, '天行健君子以自強')", "(1, 1, 'quote before')", "(1, 3, 'first of two')", "(1, 3, 'second of two')", "(2, 0, '書中一句話')"))
_add("block_targets", lambda s: quotations.block_targets(BLOCKS.df(s)), _rows("doc_id, line, target", "(1::BIGINT, 0::BIGINT, 3::BIGINT)", "(1, 1, 3)", "(1, 3, 3)", "(1, 5, 3)", "(1, 6, 3)", "(2, 0, 5)", "(2, 1, 5)"))
_add("checked_references", lambda s: quotations.checked_references(quotations.entry_references(REFERRING.df(s)), ENTRIES.df(s)), _rows("doc_id, pos, entry, status", "(1::BIGINT, 1::BIGINT, 1::BIGINT, 'verified')", "(1, 2, 2, 'unverified')", "(1, 3, 9, 'orphaned')", "(1, 4, 1, 'unquoted')", "(2, 1, 1, 'unquoted')"))
_add("stamp_groups", lambda s: quotations.stamp_groups(STAMPED.df(s)), _rows("doc_id, line, grp, stamp", "(1::BIGINT, 0::BIGINT, 0::BIGINT, '00:00:01')", "(1, 0, 0, '00:00:02.50')", "(1, 1, 0, '00:00:03')", "(1, 1, 1, '00:00:04.10')"))
_add("checked_stamps", lambda s: quotations.checked_stamps(STAMP_CLAIMS.df(s), STAMP_CUES.df(s)), _rows("claim_id, status, places", "(1::BIGINT, 'verified', '')", "(2, 'verified', '')", "(3, 'misplaced', '00:00:03')", "(4, 'unverified', '')", "(5, 'orphaned', '')", "(6, 'verified', '')"))
_add("resolved_claims", lambda s: quotations.resolved_claims(CLAIMS.df(s), SOURCES.df(s)), _rows("claim_id, src, seg, status", "(1::BIGINT, '03-forum', 1::BIGINT, 'found')", "(2, 'forum', 7, 'found')", "(3, '01-lex-interview', 2, 'found')", "(4, NULL, 1, 'unknown_source')", "(5, '01-lex-interview', 5, 'unknown_segment')"))
_add("best_sentences", lambda s: quotations.best_sentences(QUOTED.df(s), SAID.df(s)).select("quote_id", "sent_id"), _rows("quote_id, sent_id", "(1::BIGINT, 2::BIGINT)"))
_add("merged_claims", lambda s: merging.merged_claims(FINDINGS.df(s).filter("text is not null")).select("item_id", "leader", "conflict"), _rows("item_id, leader, conflict", "(1::BIGINT, 1::BIGINT, false)", "(2, 1, false)", "(3, 1, false)", "(4, 4, false)", "(5, 4, true)"))
_add("merge_totals", lambda s: merging.merge_totals(FINDINGS.df(s), merging.merged_claims(FINDINGS.df(s))), _rows("lane, items, kept, first_hand", "('a', 2::BIGINT, 1::BIGINT, 1::BIGINT)", "('b', 2, 1, 1)", "('c', 2, 1, 0)"))
_add("distinct_cues", lambda s: merging.distinct_cues(REPEATS.df(s)), _rows("file, idx, text", "('a', 2::BIGINT, 'Hello there, friend')", "('a', 4, '...')", "('a', 5, 'something new')", "('b', 1, 'hello there')", "('b', 2, NULL)"))
_add("layers", lambda s: LAYERED.df(s).select("name", linting.layer(F.col("text"), F.col("name")).alias("layer")), _rows("name, layer", "('a.md', 'ai-observation')", "('b.md', 'verbatim')", "('c.json', 'ai-observation')", "('d.visual.md', 'ai-observation')", "('e.md', 'user-supplied')", "('f.md', 'verbatim')"))
_add("layer_violations", lambda s: linting.layer_violations(LAYERED.df(s), LAYER_CARDS.df(s)), _rows("name, violation", "('a.md', 'corpus')", "('c.json', 'corpus')", "('d.visual.md', 'corpus')", "('k1', 'locator')", "('k3', 'card')", "('k3', 'locator')"))
_add("card_rules", lambda s: linting.card_rules(RULED.df(s)), _rows("name, level, rule", *[f"('poor', '{level}', '{rule}')" for level, rule in (("error", "no_description"), ("error", "bad_name"), ("warn", "short_description"), ("warn", "no_exclusion"), ("error", "no_completion"), ("warn", "no_steps"), ("error", "no_failure_modes"), ("warn", "no_source"), ("error", "unmarked_claims"))],
    *[f"('bare', '{level}', '{rule}')" for level, rule in (("error", "no_name"), ("error", "no_description"), ("warn", "short_description"), ("warn", "no_exclusion"), ("warn", "no_execution"), ("warn", "no_source"), ("warn", "no_claim_status"))]))
_add("dead_links", lambda s: linting.dead_links(LINKED.df(s), FILES.df(s)), _rows("path, target, state", "('a/one.md', 'none.md', 'dead')", "('a/one.md', '../../x.md', 'escaping')", "('a/one.md', '/etc/x', 'escaping')"))
_add("cost_estimate", lambda s: measures.cost_estimate(VIDEOS.df(s), 2.0, 8.0), _rows("video, tokens_in, tokens_out, cost", "('a', 3600::BIGINT, 800::BIGINT, 0.0136::DOUBLE)", "('b', 2400, 450, 0.0084)", "('c', 50000, 600, 0.1048)", "('d', NULL, NULL, NULL)", "('e', 0, 0, 0.0)"))
_add("parsed_reports", lambda s: measures.parsed_reports(REPORTS.df(s)), _rows("name, consistency, style, edge_honesty, source_transparency, structure, declared, unparsed, summed, mismatch", "('full', 28::BIGINT, 18::BIGINT, 17::BIGINT, 12::BIGINT, 13::BIGINT, 88::BIGINT, '', 88::BIGINT, false)", "('part', NULL, 18, NULL, NULL, NULL, 50, 'consistency edge_honesty source_transparency structure', 18, true)", "('none', NULL, NULL, NULL, NULL, NULL, NULL, 'consistency style edge_honesty source_transparency structure', 0, false)"))
_add("compiled_prompts", lambda s: measures.compiled_prompts(BUNDLES.df(s), 20), _rows("bundle, prompt, n_files", "('k', 'entry text\n\n---\n\n## a.md\n\nfirst, longer than t\n\n[cut at 20 of 36 characters]\n\n---\n\n## b.md\n\nsecond', 3::BIGINT)", "('l', '', 1)"))



@pytest.mark.parametrize("name", sorted(CASES))
def test_expected_rows(spark, name):
    query, sql = CASES[name]
    found, result = query(spark), duckdb.connect().execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(found.columns)
    rows = sorted(repr([str(r[c]) for c in sorted(found.columns)]) for r in found.collect())
    assert rows == sorted(repr([str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in result.fetchall())
