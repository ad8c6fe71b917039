"""Scores of evaluation runs: triggers, agreement of graders, gates, utility, review ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers that mean none; spread from which people must look; grades; most points of each dimension.
NONE_ANSWERS = ("none", "null", "nil", "n/a", "na", "-", '""', "", "无", "不适用")
SPREAD = 10
GRADES = ((85, "A"), (70, "B"), (55, "C"))


def normal_answer(answer: Column) -> Column:
    own = F.trim(answer)
    return F.when(F.lower(own).isin(*NONE_ANSWERS), F.lit(None).cast("string")).otherwise(own)


def grade(total: Column) -> Column:
    out = F.lit("D")
    for least, name in reversed(GRADES):
        out = F.when(total >= least, name).otherwise(out)
    return out


def trigger_metrics(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, sibling confusions, passed cases and total.

    A case expects its target or nothing (decoy).  Choosing another target is a miss, choosing
    anything on a decoy a false positive.
    """
    both = cases.join(answers.select("case_id", normal_answer(F.col("selected")).alias("chosen")), "case_id", "left")
    wanted, chosen = F.col("target"), F.col("chosen")
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return both.agg(
        count(wanted.isNotNull() & (chosen == wanted)).alias("tp"), count(wanted.isNull() & chosen.isNotNull()).alias("fp"),
        count(wanted.isNotNull() & ~chosen.eqNullSafe(wanted)).alias("fn"), count(chosen == F.col("sibling")).alias("sibling_confusion"),
        count(chosen.eqNullSafe(wanted)).alias("passed"), F.count("*").alias("cases"),
    )


def case_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, kind, status) of cases (case_id, target, paired) and answers (case_id, selected).

    A case without an answer is ``unanswered``, not failed.  Kinds: decoy (expects nothing), sibling
    (its pair was to be told apart, or another known target was chosen), trigger.
    """
    told = answers.select("case_id", normal_answer(F.col("selected")).alias("chosen"), F.lit(True).alias("told"))
    scope = cases.select(F.col("target").alias("chosen")).filter("chosen is not null").distinct().withColumn("known", F.lit(True))
    both = cases.join(told, "case_id", "left").join(scope, "chosen", "left")
    wanted, chosen = F.col("target"), F.col("chosen")
    right = chosen.eqNullSafe(wanted)
    kind = F.when(F.col("told").isNull(), "unanswered").when(wanted.isNull(), "decoy").when(F.when(right, F.coalesce("paired", F.lit(False))).otherwise(F.coalesce("known", F.lit(False))), "sibling").otherwise("trigger")
    status = F.when(F.col("told").isNull(), "unanswered").when(right, "pass").otherwise("fail")
    return both.select("case_id", "target", kind.alias("kind"), status.alias("status"))


def by_kind(results: DataFrame) -> DataFrame:
    return results.groupBy("kind").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count("*").alias("cases"))


def trigger_report(results: DataFrame) -> DataFrame:
    """One row of :func:`case_results`: counts, precision, recall, f1, decoy pass rate, sibling confusion, verdict.

    Precision is 1 where nothing was chosen; an unanswered case that expects a target is a miss.
    """
    wanted, passed, told = F.col("target").isNotNull(), F.col("status") == "pass", F.col("status") != "unanswered"
    by = results.agg(
        F.count_if(wanted & passed).alias("tp"), F.count_if(~wanted & told & ~passed).alias("fp"), F.count_if(wanted & ~passed).alias("fn"),
        F.count_if(~wanted & told).alias("decoys"), F.count_if(~wanted & passed).alias("decoys_passed"), F.count_if(wanted & told & ~passed & (F.col("kind") == "sibling")).alias("sibling_confusion"),
        F.count_if(~told).alias("unanswered"), F.count_if(passed).alias("passed"), F.count("*").alias("cases"),
    )
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(F.lit(none))
    by = by.withColumn("p", share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("r", share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    f1 = share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"), 0.0)
    verdict = F.when(F.col("cases") == 0, "vacuous").when(F.col("passed") == F.col("cases"), "pass").otherwise("fail")
    return by.select("tp", "fp", "fn", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f1, 3).alias("f1"), F.round(share(F.col("decoys_passed"), F.col("decoys"), 1.0), 3).alias("decoy_pass_rate"), "sibling_confusion", F.round(share(F.col("sibling_confusion"), F.col("tp") + F.col("fn"), 0.0), 3).alias("sibling_rate"), "unanswered", "passed", "cases", verdict.alias("verdict"))


def blind_cases(cases: DataFrame) -> DataFrame:
    """What an answerer may see of cases: id and prompt."""
    return cases.select("case_id", "prompt")


#: Fixed value: the dimensions of a report and their most points.
MOST_POINTS = {"consistency": 30, "style": 20, "edge_honesty": 20, "source_transparency": 15, "structure": 15}


def _most(dimension: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MOST_POINTS.items() for x in pair]), dimension)


def grader_errors(scores: DataFrame, answerers: DataFrame) -> DataFrame:
    """(subject, grader, error) of scores (subject, sheet, grader, dimension, score) and answerers (subject, answerer).

    A sheet without a grader's name, a dimension missing, no number or out of range, one grader on two
    sheets of a subject, or the answerer as grader.
    """
    name = F.nullif(F.trim("grader"), F.lit(""))
    sheets = scores.select("subject", "sheet", name.alias("grader"), "dimension", "score")
    bad = sheets.filter(F.col("score").isNull() | ~F.col("score").between(0, _most(F.col("dimension")))).select("subject", "grader", F.concat(F.lit("bad_score:"), "dimension").alias("error"))
    own = sheets.groupBy("subject", "sheet", "grader").agg(F.collect_set("dimension").alias("has"))
    missing = own.select("subject", "grader", F.explode(F.array_except(F.array(*[F.lit(d) for d in MOST_POINTS]), "has")).alias("d")).select("subject", "grader", F.concat(F.lit("missing:"), "d").alias("error"))
    nameless = own.filter("grader is null").select("subject", "grader", F.lit("no_grader").alias("error"))
    twice = own.filter("grader is not null").groupBy("subject", "grader").agg(F.count("*").alias("n")).filter("n > 1").select("subject", "grader", F.lit("same_grader").alias("error"))
    itself = own.join(answerers, (own["subject"] == answerers["subject"]) & (F.col("grader") == F.col("answerer"))).select(own["subject"], "grader", F.lit("grades_itself").alias("error")).distinct()
    return bad.union(missing).union(nameless).union(twice).union(itself)


#: What a self-evaluation keeps of two dimensions; what is said in public.
SELF_SHARE, IN_PUBLIC = 0.8, "对外"


def discounted(reports: DataFrame) -> DataFrame:
    """Reports (subject, mode, one column for each dimension, ...) with a self-evaluation's points cut, total and grade."""
    own = F.col("mode") == "fallback-self"
    cut = {"consistency": F.floor(F.col("consistency") * SELF_SHARE).cast("int"), "edge_honesty": F.floor(F.col("edge_honesty") * SELF_SHARE).cast("int"), "style": F.lit(0)}
    out = reports.withColumns({d: F.when(own, c).otherwise(F.col(d)) for d, c in cut.items()}).withColumn("self_applied", F.coalesce(own, F.lit(False)))
    total = sum((F.coalesce(F.col(d), F.lit(0)) for d in MOST_POINTS), F.lit(0)).cast("long")
    return out.withColumn("total", total).withColumn("grade", grade(F.col("total")))


def gated(reports: DataFrame, least: str = "B", allow_self: bool = False, least_graders: int = 2) -> DataFrame:
    """(subject, total, grade, passed, reasons) of :func:`discounted` reports with verdict, blocking, note, graders, spread.

    Vetoes come first and alone: a failed report, invented edges, an unknown mode, a self-evaluation
    used in public, blocking issues.  Then the mode, then the graders' review and the points.
    """
    when = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    vetoes = F.array_compact(F.array(
        when(F.lower("verdict") == "fail", "failed"), when(F.col("edge_honesty") == 0, "invented"), when(F.col("mode") == "unknown", "unknown_mode"),
        when(F.col("self_applied") & F.coalesce(F.col("note"), F.lit("")).contains(IN_PUBLIC), "self_in_public"), when(F.col("blocking") > 0, "blocking"),
    ))
    mode = F.array_compact(F.array(when((F.col("mode") != "dual-agent") & F.lit(not allow_self), "not_independent")))
    review = when(F.coalesce("graders", F.lit(0)) < least_graders, "too_few_graders") if not allow_self else F.lit(None).cast("string")
    bar = {name: points for points, name in GRADES}.get(least, 70)
    rest = F.array_compact(F.array(review, when(F.col("spread") > SPREAD, "graders_differ"), when(F.col("total") < bar, "below_grade")))
    reasons = F.when(F.size(vetoes) > 0, vetoes).when(F.size(mode) > 0, mode).otherwise(rest)
    return reports.select("subject", "total", "grade", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, " ").alias("reasons"))


#: Forms of locators and of a stated boundary.
LOCATOR = r"§\d+|【第\d+[段条]】|第\d+[段条]|[一二三四五六七八九十]+之[一二三四五六七八九十]+"
OUT_OF_BOUNDS = r"未覆盖|没有覆盖|素材[^。；\n]{0,8}没讲|素材[^。；\n]{0,8}不覆盖|不适用|本卡不负责|超出本卡"


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def card_signals(cards: DataFrame) -> DataFrame:
    """(card, tags, keys) of cards (card, text): tags of the front matter (2 characters or more), first 6 characters of each quotation."""
    text = F.coalesce("text", F.lit(""))
    bare = lambda t: F.regexp_replace(F.trim(t), r"^[\"']+|[\"']+$", "")
    tags = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?ms)^tags:\s*\[(.*?)\]", 1), ","), bare), lambda t: F.length(t) >= 2)
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"[「“]([^」”\n]{6,})[」”]"), F.lit(1)), lambda q: F.substring(F.trim(q), 1, 6))
    return cards.select("card", F.array_sort(F.array_distinct(tags)).alias("tags"), F.array_sort(F.array_distinct(keys)).alias("keys"))


def without_leaks(signals: DataFrame, questions: DataFrame) -> DataFrame:
    """Signals without the tags that a question (card, text) already says, and those as ``leaked``."""
    said = questions.select("card", _tight(F.coalesce("text", F.lit(""))).alias("said"))
    both = signals.join(said, "card", "left").withColumn("leaked", F.filter("tags", lambda t: F.coalesce(F.col("said").contains(_tight(t)), F.lit(False))))
    return both.select("card", F.array_except("tags", "leaked").alias("tags"), "keys", "leaked")


def answer_signals(answers: DataFrame, signals: DataFrame) -> DataFrame:
    """(card, answer_id, locator, quoted, bounded, tagged): four signs that an answer (card, answer_id, text) used the card."""
    both = answers.join(signals, "card").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tight", _tight(F.col("text")))
    holds = lambda words: F.exists(words, lambda w: F.col("tight").contains(_tight(w)))
    return both.select("card", "answer_id", F.col("text").rlike(LOCATOR).alias("locator"), holds("keys").alias("quoted"), F.col("text").rlike(OUT_OF_BOUNDS).alias("bounded"), holds("tags").alias("tagged"))


def evidence_gaps(claims: DataFrame, tests: DataFrame) -> DataFrame:
    """(claim, test, gap): tests that a claim (claim, test, said) cites and that are not there (``undefined``), or whose number differs."""
    both = claims.join(tests.select("test", F.col("number").alias("found")), "test", "left")
    gap = F.when(F.col("found").isNull(), "undefined").when(F.col("said") != F.col("found"), "number_differs")
    return both.select("claim", "test", gap.alias("gap")).filter("gap is not null")


def evidence_totals(**tables: DataFrame) -> DataFrame:
    """(what, n): the number of rows of each table, in one union of counts."""
    counts = [t.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def cross_review(scores: DataFrame) -> DataFrame:
    """Per subject: scorers, spread and verdict; out-of-range scores and too few scorers are states of their own."""
    s = F.col("score")
    by = scores.groupBy("subject").agg(F.count("score").alias("scorers"), (F.max(s) - F.min(s)).alias("spread"), F.max(((s < 0) | (s > 100)).cast("int")).alias("bad"))
    verdict = F.when((F.col("scorers") == 0) | (F.col("bad") == 1), "error").when(F.col("scorers") < 2, "insufficient_scorers").when(F.col("spread") > SPREAD, "needs_human_review").otherwise("pass")
    return by.select("subject", "scorers", "spread", verdict.alias("verdict"), F.coalesce((F.col("scorers") >= 2) & (F.abs(F.col("spread") - SPREAD) <= 1), F.lit(False)).alias("fragile"))


def merged_grades(scores: DataFrame) -> DataFrame:
    """Per subject: the sum over dimensions of the mean score rounded half to even, its grade and the graders' gap."""
    dims = scores.groupBy("subject", "dimension").agg(F.bround(F.avg("score")).cast("long").alias("points"))
    total = dims.groupBy("subject").agg(F.sum("points").alias("total"))
    own = scores.groupBy("subject", "grader").agg(F.sum("score").alias("t")).groupBy("subject").agg(F.count("*").alias("graders"), (F.max("t") - F.min("t")).cast("long").alias("gap"))
    out = total.join(own, "subject").withColumn("grade", grade(F.col("total")))
    return out.withColumn("verdict", F.when(F.col("graders") < 2, "insufficient").when(F.col("gap") > SPREAD, "rejected").otherwise("pass"))


def utility(hits: DataFrame) -> DataFrame:
    """Per subject: signals with and without the card, and the level of the gain."""
    on = lambda arm: F.sum(((F.col("arm") == arm) & F.col("hit")).cast("long"))
    by = hits.groupBy("subject").agg(on("with").alias("with_card"), on("without").alias("without_card")).withColumn("delta", F.col("with_card") - F.col("without_card"))
    level = F.when((F.col("delta") >= 2) & (F.col("with_card") >= 3) & (F.col("without_card") <= 1), "significant").when(F.col("delta") >= 1, "moderate").otherwise("none")
    return by.withColumn("level", level)


def review_ledger(reviews: DataFrame) -> DataFrame:
    """Per card: valid reviews (not fabricated, graded, by another model or a person) and independence."""
    valid = ~F.col("fabricated") & (F.col("grade") != "none") & F.col("reviewer_type").isin("cross_model", "human")
    return reviews.groupBy("card").agg(F.count("*").alias("reviews"), F.sum(valid.cast("long")).alias("valid")).withColumn("independent", F.col("valid") >= 1)


def output_strategy(cards: DataFrame, budget: int = 8) -> DataFrame:
    """Per bundle: pack if at least three cards are promoted and ready, else single; and whether it exceeds the budget."""
    ready = F.col("promoted") & F.col("trigger_ready")
    return cards.groupBy("bundle").agg(F.count("*").alias("cards"), F.sum(ready.cast("long")).alias("ready")).select("bundle", "cards", "ready", F.when(F.col("ready") >= 3, "pack").otherwise("single").alias("strategy"), (F.col("cards") > budget).alias("over_budget"))


#: Fixed value: what a purpose asks for.
PURPOSES = {"learning": "single", "reference": "single", "workflow": "pack", "distribution": "pack"}


def chosen_strategy(bundles: DataFrame, budget: int = 8) -> DataFrame:
    """(bundle, strategy, over_budget) of bundles (bundle, requested, purpose, promoted, ready): a request, else a purpose, else the counts decide."""
    asked = F.when(F.col("requested").isin("single", "pack"), F.col("requested"))
    meant = F.when(F.coalesce("purpose", F.lit("")) != "", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PURPOSES.items() for x in pair]), F.col("purpose")), F.lit("single")))
    counted = F.when((F.col("promoted") >= 3) & F.col("ready"), "pack").otherwise("single")
    return bundles.select("bundle", F.coalesce(asked, meant, counted).alias("strategy"), (F.col("promoted") > budget).alias("over_budget"))


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("category", "severity").agg(F.count("*").alias("n"))


def failure_matrix(failures: DataFrame, severities: tuple[str, ...] = ("P0", "P1", "P2")) -> DataFrame:
    """(category, one count for each severity, valid): failures without a category or of another severity are not valid."""
    ok = F.col("category").isNotNull() & F.col("severity").isin(*severities)
    return failures.groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities], F.count_if(F.coalesce(ok, F.lit(False))).alias("valid"), F.count("*").alias("n"))
