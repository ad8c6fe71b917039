"""Whether a quotation stands in the place it claims: rates per segment, verdicts, tallies, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from .overlap import _beside, exploded

#: Longest run of words compared, rates of a hit and of a partial one, words that a quotation needs.
RUN, HIT, PARTIAL, LEAST_WORDS = 5, 60, 40, 3
FAILED = ("ANCHOR_MISS", "NOT_IN_CORPUS", "SPAN_HIT")


def anchor_verdicts(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """(quote_id, target, verdict, hit_at, shared, total) of quotes (quote_id, quote, target, short) against segments (seg, text).

    Runs of ``min(5, max(2, words / 2))`` words are compared.  The best segment is the one that holds
    most of them; of equal ones the claimed one, then the first.  TOO_SHORT below 3 words, UNANCHORED
    without a claimed segment, NOT_IN_CORPUS if nothing is shared; from 60 % on ANCHOR_HIT in the claimed
    segment, SPAN_HIT elsewhere; ANCHOR_PARTIAL from 40 % in the claimed one, else ANCHOR_MISS.
    """
    own = quotes.select("quote_id", "target", T.words(F.col("quote")).alias("w"))
    k = F.when(F.size("w") >= LEAST_WORDS, F.least(F.lit(RUN), F.greatest(F.lit(2), F.floor(F.size("w") / 2).cast("int"))))
    own = own.withColumn("k", k)
    held = segments.select("seg", T.words(F.col("text")).alias("w"))
    lengths = sorted(r["k"] for r in own.select("k").filter("k is not null").distinct().collect())  # of 2 to RUN
    runs = lambda n: F.transform(T.shingles(F.col("w"), n), lambda x: F.xxhash64(F.lit(n), x))
    none = F.array().cast("array<bigint>")
    asked = exploded(own.select("quote_id", F.concat(none, *[F.when(F.col("k") == n, runs(n)).otherwise(none) for n in lengths]).alias("s")), ["quote_id"], "s", "h")
    there = exploded(held.select("seg", F.concat(none, *[runs(n) for n in lengths]).alias("s")), ["seg"], "s", "h")
    counts = there.join(_beside(asked), "h").groupBy("quote_id", "seg").agg(F.count("*").alias("shared"))
    totals = own.select("quote_id", "target", "k", F.when(F.col("k").isNotNull(), F.greatest(F.size("w") - F.col("k") + 1, F.lit(0))).alias("most"), _distinct_runs().alias("total"))
    both = totals.join(counts, "quote_id", "left")
    order = Window.partitionBy("quote_id").orderBy(F.desc_nulls_last("shared"), F.desc(F.coalesce(F.col("seg") == F.col("target"), F.lit(False))), "seg")
    both = both.withColumn("at_target", F.max(F.when(F.col("seg") == F.col("target"), F.col("shared"))).over(Window.partitionBy("quote_id"))).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    best, total = F.coalesce("shared", F.lit(0)), F.col("total")
    hit = best * 100 >= total * HIT
    verdict = F.when(F.col("target").isNull(), "UNANCHORED").when(F.col("k").isNull(), "TOO_SHORT").when(best == 0, "NOT_IN_CORPUS").when(hit & (F.col("seg") == F.col("target")), "ANCHOR_HIT")
    verdict = verdict.when(hit, "SPAN_HIT").when(F.coalesce("at_target", F.lit(0)) * 100 >= total * PARTIAL, "ANCHOR_PARTIAL").otherwise("ANCHOR_MISS")
    return both.select("quote_id", "target", verdict.alias("verdict"), F.when(hit & (best > 0), F.col("seg")).alias("hit_at"), best.cast("long").alias("shared"), F.coalesce(total, F.lit(0)).cast("long").alias("total"))


def _distinct_runs():
    out = F.lit(0)
    for n in range(2, RUN + 1):
        out = F.when(F.col("k") == n, F.size(T.shingles(F.col("w"), n))).otherwise(out)
    return out


def anchor_report(verdicts: DataFrame) -> DataFrame:
    """One row of (quote_id, target, verdict): counts of each verdict, and one of all.

    FAIL with a quotation that is not where it says; UNVERIFIED if there are quotations but none
    claims a place; else PASS.  ``balanced``: the counts add up to the quotations.
    """
    names = ("ANCHOR_HIT", "ANCHOR_PARTIAL", "SPAN_HIT", "ANCHOR_MISS", "NOT_IN_CORPUS", "TOO_SHORT", "UNANCHORED")
    by = verdicts.agg(F.count("*").alias("quotes"), F.count_if(F.col("target").isNotNull()).alias("claimed"), *[F.count_if(F.col("verdict") == n).alias(n.lower()) for n in names])
    failed = sum((F.col(n.lower()) for n in FAILED), F.lit(0))
    verdict = F.when(failed > 0, "FAIL").when((F.col("quotes") > 0) & (F.col("claimed") == 0), "UNVERIFIED").otherwise("PASS")
    return by.withColumn("balanced", sum((F.col(n.lower()) for n in names), F.lit(0)) == F.col("quotes")).withColumn("verdict", verdict)


def promoted_quotes(candidates: DataFrame, segments: DataFrame, located: DataFrame) -> DataFrame:
    """Candidates (doc_id, line, quote, kind) with short ones made quotes where the corpus holds them as they are and their line has a locator.

    Only distinct short quotations meet segments (seg, text), by the pairs of characters that begin them.
    """
    short = candidates.filter("kind = 'short'").select("quote").distinct().withColumn("head", F.substring("quote", 1, 4))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?=([{T.CJK}]{{4}}))"), F.lit(1)))
    heads = segments.select("text", F.explode(runs).alias("head"))
    known = heads.join(_beside(short), "head").filter(F.col("text").contains(F.col("quote"))).select("quote").distinct().withColumn("known", F.lit(True))
    both = candidates.join(known, "quote", "left").join(located.select("doc_id", "line").distinct().withColumn("located", F.lit(True)), ["doc_id", "line"], "left")
    up = (F.col("kind") == "short") & F.coalesce("known", F.lit(False)) & F.coalesce("located", F.lit(False))
    return both.select("doc_id", "line", "quote", F.when(up, "promoted").otherwise(F.col("kind")).alias("kind"))


def verify_accounting(references: DataFrame) -> DataFrame:
    """One row of references (status, quoted boolean): counts by status and a verdict.

    Every reference has one status, so the counts add up (``balanced``).  ``vacuous``: quotations are
    there but no reference; ``fail`` with one that is unverified, misplaced or orphaned.
    """
    names = ("verified", "unverified", "misplaced", "orphaned", "unquoted", "locator_only", "lang_skipped")
    by = references.agg(F.count("status").alias("refs"), F.count_if(F.coalesce("quoted", F.lit(False))).alias("quotes"), *[F.count_if(F.col("status") == n).alias(n) for n in names])
    verdict = F.when((F.col("refs") == 0) & (F.col("quotes") > 0), "vacuous").when(F.col("unverified") + F.col("misplaced") + F.col("orphaned") > 0, "fail").otherwise("pass")
    return by.withColumn("balanced", sum((F.col(n) for n in names), F.lit(0)) == F.col("refs")).withColumn("verdict", verdict)
