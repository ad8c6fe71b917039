"""Card operators against brute force, and their edge cases."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalogue, linting, measures, merging, quotations


def _grams(text):
    bare = "".join(c for c in text.lower() if c.isalnum())
    return {bare} - {""} if len(bare) <= 3 else {bare[i : i + 3] for i in range(len(bare) - 2)}


def _texts(n, seed):
    rng, words = random.Random(seed), ["alpha", "beta", "gamma", "delta", "road", "stone", "river", "cloud"]
    base = [" ".join(rng.choices(words, k=6)) for _ in range(n // 3)]
    return [t if rng.random() < 0.4 else " ".join(w for w in t.split() if rng.random() < 0.85) + rng.choice(["", " end", "x"]) for t in rng.choices(base, k=n)]


def test_merged_claims_equal_a_fold(spark):
    texts = _texts(60, 1)
    rows = [(i, t, bool(i % 2)) for i, t in enumerate(texts)]
    kept, want = [], {}
    for i, text in enumerate(texts):
        g = _grams(text)
        leader = next((k for k in kept if g and len(g & _grams(texts[k])) / len(g | _grams(texts[k])) >= 0.62), None)
        if leader is None:
            kept.append(i)
        want[i] = i if leader is None else leader
    found = merging.merged_claims(spark.createDataFrame(rows, "item_id long, text string, first_hand boolean")).collect()
    assert {r.item_id: r.leader for r in found} == want and len(kept) < len(texts)


def test_best_sentences_equal_all_pairs(spark):
    quotes, sentences = [t for t in _texts(40, 2) if len(t) >= 8], _texts(80, 3) + ["", "a", "road"]
    want = {}
    for i, q in enumerate(quotes):
        ratios = [difflib.SequenceMatcher(None, q, s).ratio() for s in sentences]
        best = max(range(len(sentences)), key=lambda j: ratios[j])
        if ratios[best] >= 0.80 and abs(len(sentences[best]) - len(q)) <= max(4, len(q) // 4):
            want[i] = best
    found = quotations.best_sentences(spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(sentences)), "sent_id long, sentence string")).collect()
    assert {r.quote_id: r.sent_id for r in found} == want and want


@pytest.mark.parametrize("block", [1000, 7])
def test_best_sentences_meet_in_blocks(spark, monkeypatch, block):
    ratios = []
    monkeypatch.setattr(quotations, "BLOCK", block)
    texts = [t for t in _texts(30, 5) if len(t) >= 8] + ["学习的方法和学习的道理", "学习的方法和学习的道"]
    quotes, sentences = texts * 3, texts[::-1] * 2
    for q in quotes:
        ratio = [difflib.SequenceMatcher(None, q, s).ratio() for s in sentences]
        best = max(range(len(sentences)), key=lambda j: ratio[j])
        ratios.append((best, round(ratio[best], 9)))
    found = quotations.best_sentences(spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(sentences)), "sent_id long, sentence string"))
    assert {r.quote_id: (r.sent_id, round(r.ratio, 9)) for r in found.collect()} == dict(enumerate(ratios))
    assert "Join [pair" not in found._jdf.queryExecution().executedPlan().toString()


def test_common_subsequence():
    for a, b, n in [("abcbdab", "bdcaba", 4), ("", "a", 0), ("aaaa", "aa", 2), ("学a习", "习a学a", 2)]:
        bits = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in a}
        assert quotations._common(bits, len(a), b) == n


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for op in (quotations.lint_quotes, quotations.anchor_quotes, quotations.owned_quotes, quotations.block_targets, quotations.entry_references, quotations.stamp_groups):
        assert op(docs).count() == 0
    claims = spark.createDataFrame([], "item_id long, text string, first_hand boolean, lane string")
    assert merging.merge_totals(claims, merging.merged_claims(claims)).count() == 0
    assert linting.card_rules(spark.createDataFrame([], "name string, text string")).count() == 0
    assert measures.seeded_split(spark.createDataFrame([], "case_id long")).count() == 0


def test_guard_stops_at_observations(spark):
    cards = spark.createDataFrame([("k", "fine")], "name string, text string")
    linting.guard_layers(cards, cards)
    with pytest.raises(ValueError):
        linting.guard_layers(cards.select(F.lit("x.vision.md").alias("name"), "text"), cards)


def test_lint_marks_talk_about_quotations(spark):
    docs = spark.createDataFrame([(1, '归属：\n"said in one line"\nplain\n"said far from it"'), (2, '语言信号\n1\n2\n3\n4\n5\n6\n"seven lines below"\n"eight lines below"')], "doc_id long, text string")
    assert {(r.quote, r.meta) for r in quotations.lint_quotes(docs).collect()} == {("said in one line", True), ("said far from it", False), ("seven lines below", True), ("eight lines below", False)}


def test_use_cases_leave_exclusions_out(spark):
    texts = ["- first use；* second use；不做 this；English version here；不适用于 that；\n• third use 。不用于 more；fourth use；fifth use", "* -•  marked use ;- marked use\u3000；abc", ""]
    got = [r.uses for r in spark.createDataFrame(list(enumerate(texts)), "id int, text string").orderBy("id").select(catalogue.use_cases(F.col("text")).alias("uses")).collect()]
    assert got == [["first use", "second use", "third use", "fourth use"], ["marked use"], []]
