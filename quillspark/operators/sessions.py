"""Ordered rows: gap sessions, sessions of bounded size, adjacent repeats, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folds import in_order, packed

#: The gap in ms and the characters up to which cues are merged.
GAP_MS, MOST_CHARS = 2500, 420


def gap_sessions(rows: DataFrame, key: str, at: str, gap: Column) -> DataFrame:
    """(key, session, n, first, last): rows of a key no more than ``gap`` after the one before."""
    order = Window.partitionBy(key).orderBy(at, "tie")
    opens = (F.col(at) - F.lag(at).over(order)) > gap
    rows = rows.withColumn("session", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(order))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).withColumn("session", F.col("session").cast("long"))


def capped_sessions(cues: DataFrame, gap_ms: int = GAP_MS, most: int = MOST_CHARS) -> DataFrame:
    """Cues (file, idx, start_ms, end_ms, text) merged while the gap and the size allow it; one row per paragraph, with its text.

    Paragraphs of under 12 characters that are nothing but a bracketed remark go.
    """
    order = ["idx", "start_ms", "end_ms", "text"]
    rows = in_order(cues.select("file", *order), "file", order)
    cut = F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("file").orderBy(*order)) > gap_ms
    out = packed(rows, "file", F.length("text"), cut, most, 1).withColumnRenamed("pack", "n")
    by = out.groupBy("file", "n").agg(F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    by = by.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), " "))
    by = by.filter(~((F.length("text") < 12) & F.col("text").rlike(r"^\s*[\[(（【][^\])）】]*[\])）】]\s*$")))
    para = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    return by.select("file", para.cast("long").alias("para"), "start_ms", "end_ms", F.length("text").cast("long").alias("chars"), F.size("t").cast("long").alias("cue_count"), "text")


def speakers(rows: DataFrame, least: int = 2) -> DataFrame:
    """(speaker, n) of labels before a colon that occur at least ``least`` times."""
    label = F.trim(F.regexp_extract("text", r"^\s*([A-Za-z][^\s:：]{0,11}|[一-鿿]{2,6})\s*[:：]", 1))
    return rows.select(label.alias("speaker")).filter("speaker <> ''").groupBy("speaker").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
