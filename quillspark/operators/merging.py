"""Merging of near repeats: claims of several researchers, and adjacent cues."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..plans.folds import folded
from .overlap import exploded, gram_sets

#: Jaccard of 3-grams from which claims are one, below which equals may conflict, and from which cues repeat.
CLAIM, CONFLICT, CUE = 0.62, 0.9, 0.86


def similar_claims(claims: DataFrame, least: float = CLAIM) -> DataFrame:
    """(a, b, likeness) of claims (item_id, text) with a < b; exact, by their shared 3-grams."""
    sets = gram_sets(claims, ["item_id"]).withColumn("n", F.size("g"))
    grams = exploded(sets, ["item_id", "n"], "g", "gram")
    left, right = grams.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "gram"), grams.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "gram")
    sized = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))
    both = left.join(right, "gram").filter(sized).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return both.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("likeness")).filter(F.col("likeness") >= least)


def _cut(frame: DataFrame) -> DataFrame:
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return frame.checkpoint()


def merged_claims(claims: DataFrame, least: float = CLAIM) -> DataFrame:
    """(item_id, leader, likeness, conflict): a claim is absorbed by the first kept one that is alike enough, else it is kept.

    Claims (item_id, text, first_hand) count in order of item_id.  Round by round a claim is kept
    once every earlier one like it is absorbed, and absorbed once one of them is kept; the number of
    rounds is the longest chain of alike claims.  Both first-hand and less than 0.9 alike: a conflict.
    """
    edges = _cut(similar_claims(claims, least))
    state = _cut(claims.select("item_id", F.lit(None).cast("boolean").alias("kept")))
    while state.filter("kept is null").limit(1).count():
        seen = edges.join(state.select(F.col("item_id").alias("a"), F.col("kept").alias("a_kept")), "a").groupBy(F.col("b").alias("item_id")).agg(F.max(F.coalesce("a_kept", F.lit(False)).cast("int")).alias("taken"), F.max(F.col("a_kept").isNull().cast("int")).alias("waits"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("taken") == 1, False).when(F.coalesce("waits", F.lit(0)) == 0, True)
        state = _cut(state.join(seen, "item_id", "left").select("item_id", now.alias("kept")))
    kept = state.filter("kept").select(F.col("item_id").alias("a"))
    first = edges.join(kept, "a").withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy("a"))).filter("nth = 1")
    led = state.filter("not kept").join(first.select(F.col("b").alias("item_id"), F.col("a").alias("leader"), "likeness"), "item_id").select("item_id", "leader", "likeness")
    out = state.filter("kept").select("item_id", F.col("item_id").alias("leader"), F.lit(1.0).alias("likeness")).union(led)
    hand = claims.select("item_id", "first_hand")
    both = out.join(hand, "item_id").join(hand.select(F.col("item_id").alias("leader"), F.col("first_hand").alias("leader_first")), "leader")
    return both.select("item_id", "leader", "likeness", ((F.col("likeness") < CONFLICT) & F.col("first_hand") & F.col("leader_first")).alias("conflict"))


def merge_totals(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """Per lane: items, kept and kept first-hand ones.  A group counts as first-hand if any member is, as that one speaks for it."""
    hand = merged.join(claims.select("item_id", "first_hand"), "item_id").groupBy("leader").agg(F.max(F.col("first_hand").cast("int")).alias("hand"))
    both = claims.join(hand, F.col("item_id") == F.col("leader"), "left")
    return both.groupBy("lane").agg(F.count("*").alias("items"), F.count("leader").alias("kept"), F.coalesce(F.sum("hand"), F.lit(0)).cast("long").alias("first_hand"))


def distinct_cues(cues: DataFrame, least: float = CUE) -> DataFrame:
    """(file, idx, text): cues that do not repeat the last kept one; of two alike the longer stays.

    Alike: one bare text holds the other, or their 3-grams are.  What is kept depends on what was
    kept before, so this is a fold over a file's cues, whose state is one cue; texts without letters
    or digits stay.
    """
    rows = cues.select("file", "idx", "text", T.bare(F.col("text")).alias("bare"))
    grams = lambda x: {x} if len(x) <= 3 else {x[i : i + 3] for i in range(len(x) - 2)}

    def alike(a: str, b: str) -> bool:
        if not a or not b:
            return False
        x, y = grams(a), grams(b)
        return a in b or b in a or len(x & y) / len(x | y) >= least

    def kept(cues: Iterator[tuple]) -> Iterator[tuple]:
        held = next(cues)
        for cue in cues:
            if not alike(cue[3], held[3]):
                yield held[:3]
                held = cue
            elif len(cue[3]) > len(held[3]):
                held = cue
        yield held[:3]

    return folded(rows, "file", ["idx", "text"], kept, cues.select("file", "idx", "text").schema)
