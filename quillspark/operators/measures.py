"""Reports and plans: reading costs, cost estimates, report parsing, splits, compiled prompts."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T

#: Seconds of a slice and between key frames; tokens of each unit, in and out; dimensions of a report.
SLICE_SECONDS, FRAME_SECONDS = 600, 30
SLICE_TOKENS, FRAME_TOKENS, MINUTE_TOKENS_IN, FULL_SLICE_TOKENS_OUT = (1800, 400), (800, 150), 2500, 300
DIMENSIONS = (("consistency", "立场/结论一致性", 30), ("style", "风格辨识度", 20), ("edge_honesty", "边缘诚实度", 20), ("source_transparency", "来源透明度", 15), ("structure", "结构完整度", 15))
TINY_TOKENS, REFERENCE_CHARS = 200, 20000


def token_saving(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """Per book: tokens of the whole, the chunks with a keyword, those and their neighbours, an index and the best chunk.

    Chunks (book, seq, title, text).  Best: most keywords, then fewest tokens, then first.  Books
    without a hit have no row; ``degenerate``: every hit is tiny, so that ratios would mislead.
    """
    hits = sum((F.coalesce(F.col("text").contains(k), F.lit(False)).cast("long") for k in keywords), F.lit(0).cast("long"))
    rows = chunks.select("book", "seq", "title", F.length(F.coalesce("text", F.lit(""))).alias("chars"), T.token_estimate(F.col("text")).alias("tokens"), hits.alias("hits"))
    order = Window.partitionBy("book").orderBy("seq")
    hit = F.col("hits") > 0
    beside = F.coalesce(F.lag("hits").over(order), F.lit(0)) + F.coalesce(F.lead("hits").over(order), F.lit(0)) > 0
    entry = F.format_string("%s  %s  (%sc, %s)", F.col("seq").cast("string"), F.coalesce("title", F.lit("")), F.col("chars").cast("string"), F.col("hits").cast("string"))
    rows = rows.withColumn("beside", ~hit & beside).withColumn("entry", entry).withColumn("cjk", F.regexp_count("entry", F.lit(f"[{T.CJK}]")))
    by = rows.groupBy("book").agg(
        F.count("*").alias("blocks"), F.sum(hit.cast("long")).alias("hit_blocks"), F.sum("tokens").alias("whole"), F.coalesce(F.sum(F.when(hit, F.col("tokens"))), F.lit(0)).alias("hit_only"),
        F.coalesce(F.sum(F.when(hit | F.col("beside"), F.col("tokens"))), F.lit(0)).alias("with_neighbours"), F.max(F.when(hit, F.col("tokens"))).alias("largest"),
        F.floor(F.sum("cjk") + (F.sum(F.length("entry")) + F.count("*") - 1 - F.sum("cjk")) * 0.35).alias("index_tokens"),
        F.max_by("tokens", F.when(hit, F.struct("hits", -F.col("tokens"), -F.col("seq")))).alias("best_tokens"),
    )
    return by.filter("hit_blocks > 0").select("book", "blocks", "hit_blocks", "whole", "hit_only", "with_neighbours", (F.col("index_tokens") + F.col("best_tokens")).alias("index_then_one"), (F.col("largest") < TINY_TOKENS).alias("degenerate"))


def cost_estimate(videos: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """(video, tokens_in, tokens_out, cost) of videos (video, mode, seconds); nulls without a duration."""
    d = F.greatest(F.col("seconds").cast("double"), F.lit(0.0))
    d = F.when(F.col("seconds").isNotNull(), d)
    slices, frames, minutes = F.ceil(d / SLICE_SECONDS), F.ceil(d / FRAME_SECONDS), F.ceil(d / 60)
    mode = F.col("mode")
    tokens_in = F.when(mode == "agent-slices", slices * SLICE_TOKENS[0]).when(mode == "keyframes", frames * FRAME_TOKENS[0]).otherwise(minutes * MINUTE_TOKENS_IN)
    tokens_out = F.when(mode == "agent-slices", slices * SLICE_TOKENS[1]).when(mode == "keyframes", frames * FRAME_TOKENS[1]).otherwise(slices * FULL_SLICE_TOKENS_OUT)
    return videos.select("video", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 4).alias("cost"))


def parsed_reports(reports: DataFrame, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """(name, one column per dimension, unparsed, declared, summed, mismatch) of reports (name, text).

    A dimension's points stand between its heading and the next one found.
    """
    text = F.coalesce("text", F.lit(""))
    rows = reports.select("name", text.alias("text"), *[F.instr(text, label).alias(f"at_{key}") for key, label, _ in dimensions])
    points = []
    for key, label, most in dimensions:
        start = F.col(f"at_{key}") + len(label)
        after = [F.when(F.col(f"at_{other}") > start, F.col(f"at_{other}")) for other, _, _ in dimensions if other != key]
        end = F.least(*after, F.length("text") + 1)
        own = F.substring("text", start, end - start)
        scored, said = F.regexp_extract(own, rf"(\d{{1,3}})\s*/\s*{most}", 1), F.regexp_extract(own, r"得分[:：]\s*(\d{1,3})", 1)
        points.append(F.when(F.col(f"at_{key}") > 0, F.coalesce(F.when(scored != "", scored), F.when(said != "", said))).cast("long").alias(key))
    declared = F.regexp_extract("text", r"\*?\*?总分\*?\*?[^\d\-]{0,8}(\d{1,3})", 1)
    keys = [key for key, _, _ in dimensions]
    out = rows.select("name", *points, F.when(declared != "", declared.cast("long")).alias("declared"))
    summed = sum((F.coalesce(F.col(k), F.lit(0)) for k in keys), F.lit(0)).cast("long")
    out = out.withColumn("unparsed", F.concat_ws(" ", *[F.when(F.col(k).isNull(), k) for k in keys])).withColumn("summed", summed)
    return out.withColumn("mismatch", F.coalesce(F.col("declared") != F.col("summed"), F.lit(False)))


def seeded_split(cases: DataFrame, seed: int = 42, ratio: float = 0.6) -> DataFrame:
    """(case_id, part): train or validation, in the order of a hash of seed and case_id, cut at ``ratio``.

    The order is by sha-256, so membership is the same everywhere.  Rows are counted by the hash's first
    three digits; only those of the digits that the cut falls into are ranked.
    """
    marked = cases.select("case_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("case_id").cast("string")), 256).alias("h")).withColumn("head", F.substring("h", 1, 3))
    counts = {r["head"]: r["count"] for r in marked.groupBy("head").count().collect()}  # at most 4096 rows
    left, edge = round(sum(counts.values()) * ratio), ""
    for edge in sorted(counts):
        if counts[edge] >= left:
            break
        left -= counts[edge]
    nth = F.row_number().over(Window.partitionBy("head").orderBy("h", "case_id"))
    apart = marked.filter(F.col("head") == edge).withColumn("first", nth <= left)
    rest = marked.filter(F.col("head") != edge).withColumn("first", F.col("head") < edge)
    return apart.union(rest).select("case_id", F.when(F.col("first"), "train").otherwise("validation").alias("part"))


def compiled_prompts(files: DataFrame, most: int = REFERENCE_CHARS) -> DataFrame:
    """(bundle, prompt, n_files): each bundle's entry, then its other files by path, each up to ``most`` characters."""
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(f"\n\n[cut at {most} of "), F.length(text).cast("string"), F.lit(" characters]"))).otherwise(text)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    piece: Column = F.when(F.col("entry"), bare(text)).otherwise(F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), bare(cut)))
    by = files.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct((~F.col("entry")).alias("later"), "path", piece.alias("piece")))).alias("p"))
    return by.select("bundle", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n---\n\n").alias("prompt"), F.size("p").cast("long").alias("n_files"))


def compiled_modes(files: DataFrame, mode: str = "inline", most: int = REFERENCE_CHARS) -> DataFrame:
    """(bundle, prompt, n_files): ``entry`` the entry alone, ``inline`` all files, ``cards`` the entry and files below ``cards/``."""
    if mode not in ("entry", "inline", "cards"):
        raise ValueError(f"unknown mode {mode}")
    kept = {"entry": F.col("entry"), "inline": F.lit(True), "cards": F.col("entry") | F.col("path").startswith("cards/")}[mode]
    return compiled_prompts(files.filter(kept), most)


def rendered_table(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a markdown table, for people; more than ``most`` rows are refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(x) for x in r) + " |" for r in found]) + "\n"


def timed(query: Callable[[], DataFrame], runs: int = 3) -> dict[str, float]:
    """Seconds of a query that is run to its end ``runs`` times: fewest, median, most."""
    took = []
    for _ in range(runs):
        began = time.monotonic()
        query().write.format("noop").mode("overwrite").save()
        took.append(time.monotonic() - began)
    return {"fewest": min(took), "median": median(took), "most": max(took)}
