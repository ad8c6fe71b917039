"""Spans of regular expressions, found with Spark's own functions.

Spark has no function that returns the places of all matches.  Splitting a text at a
pattern gives what lies between the matches, and extracting the pattern gives the
matches; running sums of both lengths are the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD as _WORD


@dataclass(frozen=True)
class Kind:
    """A kind of span: a Java pattern, a cheap pattern that every text with a match matches, and what matches stay."""

    name: str
    pattern: str
    hint: str
    #: Tells from a match (struct of text and part, the given group) whether it stays.
    keep: Callable[[Column], Column] | None = None
    group: int = 0


#: Matches whose places one inner fold sums up; keeps the fold over a text of n matches near n * sqrt(n) steps.
_CHUNK = 128


def kind_spans(df: DataFrame, text: str, kind: Kind, rank: int, out: str, reach: int = 0) -> DataFrame:
    """Adds ``out``: array<struct<start int, rank int, end int>> of the kind's kept matches in column ``text``.

    With ``reach``, the structs also hold ``text`` (the match), ``left`` and ``right``: what lies before
    and after it, up to the next match of the kind.  Of more than so many code points only the whole
    words nearest to the match within them are kept, if they are five at least.
    Working columns start with the output's name, which must be free.
    """
    whole, part, gaps, starts = f"{out}_m", f"{out}_p", f"{out}_g", f"{out}_s"
    pattern, hinted = F.lit(kind.pattern), F.col(text).rlike(kind.hint)
    none = F.array().cast("array<string>")
    df = df.withColumn(whole, F.when(hinted, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none))
    some = F.size(whole) > 0
    df = df.withColumn(part, F.when(some, F.regexp_extract_all(text, pattern, F.lit(kind.group))).otherwise(none) if kind.group else F.col(whole))
    df = df.withColumn(gaps, F.when(some, F.split(text, kind.pattern, -1)).otherwise(none))
    no_starts = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), no_starts.alias("starts"))
    begin = lambda s, i: s["at"] + F.length(F.get(gaps, i))
    step = lambda s, i: F.struct((begin(s, i) + F.length(F.get(whole, i))).alias("at"), F.concat(s["starts"], F.array(begin(s, i))).alias("starts"))

    def chunk(s: Column, c: Column) -> Column:
        own = F.struct(s["at"].alias("at"), no_starts.alias("starts"))
        return F.aggregate(F.sequence(c, F.least(c + _CHUNK, F.size(whole)) - 1), own, step, lambda t: F.struct(t["at"].alias("at"), F.concat(s["starts"], t["starts"]).alias("starts")))

    heads = F.when(some, F.sequence(F.lit(0), F.size(whole) - 1, F.lit(_CHUNK))).otherwise(no_starts)
    df = df.withColumn(starts, F.aggregate(heads, zero, chunk, lambda s: s["starts"]))

    def near(gap: Column, side: Callable[[Column, Column], Column], edge: str) -> Column:
        cut, torn = side(gap, F.lit(reach)), f"^{_WORD}" if edge == "^" else _WORD + edge
        return F.when(F.length(cut) < reach, cut).when(F.regexp_count(cut, F.lit(_WORD)) >= 6, F.regexp_replace(cut, torn, "")).otherwise(gap)

    def found(m: Column, i: Column) -> Column:
        fields = [F.get(starts, i).alias("start"), F.lit(rank).alias("rank"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("text"), F.get(part, i).alias("part")]
        if reach:
            fields += [near(F.get(gaps, i), F.right, "^").alias("left"), near(F.get(gaps, i + 1), F.left, r"\z").alias("right")]
        return F.struct(*fields)

    spans = F.transform(whole, found)
    if kind.keep:
        spans = F.filter(spans, kind.keep)
    names = ["start", "rank", "end", *(["text", "left", "right"] if reach else [])]
    df = df.withColumn(out, F.transform(spans, lambda x: F.struct(*[x[n].alias(n) for n in names])))
    return df.drop(whole, part, gaps, starts)


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
