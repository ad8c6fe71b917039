"""Overlap between corpora: shingle containment, repeated sentences, best segments, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..plans.scratch import written
from .ranks import nth, quantile_places

#: Words of a shingle, the containment above which an overlap fails, words that a sentence needs.
SHINGLE, CONTAINMENT, SENTENCE = 8, 0.005, 8


def shingled(texts: DataFrame, key: list[str], n: int) -> DataFrame:
    """(key, s): the distinct n-word shingles of each text."""
    return texts.select(*key, T.words(F.col("text")).alias("w")).select(*key, T.shingles(F.col("w"), n).alias("s"))


def gram_sets(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, g): the character 3-grams of each text."""
    return texts.select(*key, T.bare(F.col("text")).alias("b")).select(*key, T.char_grams(F.col("b")).alias("g"))


def exploded(sets: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
    """(key, name): the elements of a set column.

    explode alone would make Spark test the set's size below the expressions that made it, and so
    compute the words anew for every shingle; an outer explode is not looked through.
    """
    return sets.select(*key, F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


#: Rows up to which the smaller side of a join of shingles is broadcast (of at most a few hundred bytes each).
BROADCAST_ROWS = 500_000


def _beside(small: DataFrame) -> DataFrame:
    """The smaller side of a join, made once, to be broadcast if it is small enough."""
    small = written(small, "beside")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _known_in(sets: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, size, hits): the size of each text's set and how many of its elements are in ``known``.

    A text's elements stay in their task while the known side is small, and only the counts of a
    text move; else elements travel as 64-bit hashes.
    """
    rows = sets.select(key, F.size("s").cast("long").alias("size"), F.explode_outer("s").alias("x"))
    rows = rows.select(key, "size", F.xxhash64("x").alias("h"), F.col("x").isNull().alias("none"))
    right = known.select(F.xxhash64("x").alias("h")).distinct().withColumn("hit", F.lit(1))
    joined = rows.join(_beside(right), "h", "left")
    return joined.groupBy(key, "size").agg(F.count(F.when(~F.col("none"), F.col("hit"))).alias("hits"))


def containment(new: DataFrame, old: DataFrame, key: str = "doc_id", n: int = SHINGLE, most: float = CONTAINMENT) -> DataFrame:
    """Per new text: distinct n-word shingles, how many occur in any old text, and a verdict.

    Texts of fewer than n words are ``TOO_SHORT``, not a pass.  Keys name texts, once each.
    """
    known = exploded(shingled(old, [], n), [], "s", "x")
    out = _known_in(shingled(new, [key], n), key, known).select(key, F.col("size").alias("n_shingles"), F.col("hits").alias("n_shared"))
    verdict = F.when(F.col("n_shingles") == 0, "TOO_SHORT").when(F.col("n_shared") > F.col("n_shingles") * most, "FAIL").otherwise("PASS")
    return out.withColumn("verdict", verdict)


def sentence_hashes(docs: DataFrame, key: str) -> DataFrame:
    """(key, h): 64-bit hashes of the distinct normalised sentences of at least SENTENCE words of each text."""
    parts = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?。！？\n]+"), lambda x: x != "")
    raw = docs.select(key, F.explode(F.array_distinct(parts)).alias("raw")).select(key, T.words(F.col("raw")).alias("w"))
    # a projection of its own, so that the words are not made anew for the filter
    own = raw.select(key, F.when(F.size("w") >= SENTENCE, F.xxhash64(F.array_join("w", " "))).alias("h"))
    return own.filter("h is not null")


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """Per document with one: how many of its sentences occur in another document too.

    Hashes are dealt out once, and counted and looked up where they lie.
    """
    own = sentence_hashes(docs, "doc_id").repartition("h")
    often = own.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h")
    return own.join(often, "h", "left_semi").groupBy("doc_id").agg(F.countDistinct("h").alias("n_repeated"))


def sentences_in_old(new: DataFrame, old: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sentences, n_old): each new text's distinct sentences of at least SENTENCE words, and those that an old text has."""
    rows = sentence_hashes(new, key).distinct()
    known = sentence_hashes(old.select(F.lit(0).alias("k"), "text"), "k").select("h").distinct().withColumn("hit", F.lit(1))
    return rows.join(_beside(known), "h", "left").groupBy(key).agg(F.count("*").alias("n_sentences"), F.count("hit").alias("n_old"))


def overlap_report(new: DataFrame, old: DataFrame, n: int = SHINGLE, most: float = CONTAINMENT) -> DataFrame:
    """One row: shingles and shared ones over all new texts, containment (6 digits), sentences that are in old texts, verdict.

    The verdict fails above the bound or with any old sentence, and is ``vacuous`` without shingles.
    """
    known = exploded(shingled(old, [], n), [], "s", "x").select(F.xxhash64("x").alias("h")).distinct().withColumn("hit", F.lit(1))
    own = exploded(shingled(new, [], n), [], "s", "x").select(F.xxhash64("x").alias("h"))
    own = own.repartition("h").distinct()  # nearly all differ: tables of them before the shuffle would only spill
    counts = own.join(_beside(known), "h", "left").agg(F.count("*").alias("n_shingles"), F.count("hit").alias("n_shared"))
    again = sentences_in_old(new, old).agg(F.coalesce(F.sum("n_old"), F.lit(0)).alias("n_sentences"))
    both = counts.crossJoin(again)  # one row each
    share = F.col("n_shared") / F.col("n_shingles")
    verdict = F.when(F.col("n_shingles") == 0, "vacuous").when((share > most) | (F.col("n_sentences") > 0), "FAIL").otherwise("PASS")
    return both.select("n_shingles", "n_shared", F.when(F.col("n_shingles") > 0, F.round(share, 6)).alias("containment"), "n_sentences", verdict.alias("verdict"))


def best_segments(quotes: DataFrame, segments: DataFrame, n: int = 5, top: int = 3) -> DataFrame:
    """Per quote the segments that share most of its n-word shingles, and a verdict of the first.

    Shingles are joined, not texts: nothing is compared with a segment it shares nothing with.
    """
    asked = shingled(quotes, ["item_id"], n).select("item_id", F.size("s").cast("long").alias("total"), "s")
    asked = exploded(asked, ["item_id", "total"], "s", "x").select("item_id", "total", F.xxhash64("x").alias("h"), F.col("x").alias("asked"))
    held = exploded(shingled(segments, ["doc_id"], n), ["doc_id"], "s", "x").select("doc_id", F.xxhash64("x").alias("h"))
    shared = held.join(_beside(asked.drop("asked")), "h").groupBy("item_id", "total", "doc_id").agg(F.count("*").alias("shared"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))).filter(F.col("rank") <= top)
    verdict = F.when(F.col("shared") * 10 >= F.col("total") * 6, "HIT").when(F.col("shared") * 10 >= F.col("total") * 4, "PARTIAL").otherwise("MISS")
    return ranked.select("item_id", "doc_id", "shared", "total", "rank", verdict.alias("verdict"))


def coverage(source: DataFrame, card: DataFrame) -> DataFrame:
    """Per source text of at least 8 units: its character 3-grams and how many the card's texts cover."""
    grams = gram_sets(source.filter(T.unit_count(F.col("text")) >= 8), ["doc_id"]).withColumnRenamed("g", "s")
    known = exploded(gram_sets(card, []), [], "g", "x")
    return _known_in(grams, "doc_id", known).select("doc_id", F.col("size").alias("grams"), F.col("hits").alias("hit"))


def coverage_audit(covered: DataFrame, percent: int = 60, strict: int = 10) -> DataFrame:
    """One row of (doc_id, grams, hit): texts, covered ones at ``percent`` and at ``strict`` more, quartiles, fragility.

    Quartiles are elements of the ascending order, at n/4, n/2 and 3n/4 rounded down.  ``fragile``:
    the least covered text is below the bound, or the strict count differs.
    """
    share = F.when(F.col("grams") > 0, F.col("hit") / F.col("grams")).otherwise(F.lit(0.0))
    covered = written(covered.select("doc_id", "grams", "hit"), "covered")
    rows = covered.select(share.alias("share"))
    at = lambda p: F.sum((F.col("hit") * 100 >= F.col("grams") * p).cast("long"))
    total = covered.agg(F.count("*").alias("n"), F.coalesce(at(percent), F.lit(0)).alias("covered"), F.coalesce(at(percent + strict), F.lit(0)).alias("covered_strict"))
    n = rows.count()
    quartiles = [nth(rows, "share", place, n) for place in quantile_places(n, 4)]
    out = total.select("*", *[F.lit(q).cast("double").alias(f"q{i}") for i, q in enumerate(quartiles, 1)])
    state = F.when(F.col("n") == 0, "insufficient").when(F.col("covered") == F.col("n"), "covered").otherwise("uncovered")
    return out.select("n", "covered", "covered_strict", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")], ((F.col("covered") < F.col("n")) | (F.col("covered") != F.col("covered_strict"))).alias("fragile"), state.alias("state"))


def least_covered(covered: DataFrame, percent: int = 60, top: int = 20) -> DataFrame:
    """(doc_id, share): the ``top`` texts below the bound, ascending by share, then by id."""
    share = F.when(F.col("grams") > 0, F.col("hit") / F.col("grams")).otherwise(F.lit(0.0))
    return covered.filter(F.col("hit") * 100 < F.col("grams") * percent).select("doc_id", share.alias("share")).orderBy("share", "doc_id").limit(top)


def sensitivity(covered: DataFrame, percents: tuple[int, ...] = (50, 55, 60, 65, 70, 75, 80)) -> DataFrame:
    """How many texts count as covered at each threshold, in one aggregate over the texts."""
    at = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    rows = covered.select("grams", "hit", at)
    return rows.groupBy("percent").agg(F.count("*").alias("texts"), F.sum((F.col("hit") * 100 >= F.col("grams") * F.col("percent")).cast("long")).alias("covered"))
