"""Search over a positional index: words, phrases, prefixes and columns, combined with ``&``, ``|`` and ``-``.

A match is built from Python objects, so that no text of a user's is ever read as syntax::

    found = search(index, phrase("of the") & word("Été", field="title") | prefix("anti") - word("x"))

Tokens are runs of letters and digits without accents and letter case, CJK runs as bigrams; what is
asked for is cut by the same expression as the texts, and a word that comes apart is a phrase.

The index has one row for each (term, document, field), sorted by term and dealt out in ranges of
terms: a word or prefix reads the row groups of its range of terms, and a term that millions of
documents hold lies in as many files as it fills.  Ranges come from a bounded sample of documents,
which sets their balance only.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.inverted import inverted
from ..plans.scratch import written
from .retrieval import K1, LEAST_IDF, B


def _bases() -> dict[str, str]:
    """Lower-case Latin letters with marks, each with the letter that its canonical decomposition begins with."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and whole[0].isascii() and whole[0].isalpha():
            out[chr(code)] = whole[0].lower()
    return out


_BASES = _bases()
#: What a snippet passes over between the letters: blanks and the separators of the lexical tokeniser.
_BETWEEN = "[\\s" + re.escape(T.SEPARATORS.strip()) + "]+"


#: Documents and postings of the sample that ranges come from, postings of a range.
SAMPLE_DOCS, SAMPLE_ROWS, RANGE_ROWS = 2_000, 50_000, 2_000_000


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _unmarked(low: Column) -> Column:
    """A lower-case text without accents."""
    bare = F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), "".join(_BASES), "".join(_BASES.values()))
    return F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)


def _cut(own: Column) -> Column:
    return T.with_bigrams(own, r"[\p{L}\p{N}\p{Co}]+")


def search_tokens(text: Column) -> Column:
    """Tokens of a text in lower case and without accents."""
    return _cut(_unmarked(_low(text)))


def _positions(docs: DataFrame, fields: tuple[str, ...], bounds: list[str] | None = None) -> DataFrame:
    rows = docs.select("doc_id", *fields)
    for step in (_low, _unmarked, _cut):  # projections of their own, so that no step is made twice for the next one
        rows = rows.select("doc_id", *[step(F.col(f)).alias(f) for f in fields])
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(inverted(tuple(fields), bounds), f"term string, doc_id {kind}, field string, positions array<int>, length long" + ("" if bounds is None else ", range int"))


def positions(docs: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(term, doc_id, field, positions array<int>, length): the positional postings of documents with distinct ``doc_id``.

    Positions are counted inside each row; ``length`` is the document's number of tokens in all fields.
    A row with an empty term stands for each document, with tokens or not.
    """
    return _positions(docs, fields)


def _bounds(docs: DataFrame, fields: tuple[str, ...], range_rows: int) -> list[str]:
    """The terms at which ranges of about equal size begin; a frequent term as often as it fills ranges."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    places = 1 << 30
    some = written(_positions(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(places)) < int(places * share)), fields).select("term", F.xxhash64("term", "doc_id").alias("h")), "sample")
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(some.count() / share) // range_rows))
    terms = sorted(r["term"] for r in some.orderBy("h").limit(SAMPLE_ROWS).collect())
    return [terms[len(terms) * i // ranges] for i in range(1, ranges)] if terms else []


def write_index(docs: DataFrame, path: str, fields: tuple[str, ...] = ("text",), range_rows: int = RANGE_ROWS) -> None:
    bounds = _bounds(docs, fields, range_rows)
    rows = _positions(docs, fields, bounds).repartitionById(len(bounds) + 1, "range").drop("range")
    rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dictionary(index: DataFrame, start: str = "") -> DataFrame:
    """(term, docs, occurrences) of the terms that begin with ``start``."""
    rows = index.filter((F.col("term") != "") & F.col("term").startswith(start))
    return rows.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.sum(F.size("positions")).cast("long").alias("occurrences"))


@dataclass(frozen=True)
class Match:
    """A condition on documents: a phrase (``text``), or two conditions joined by ``how``: and, or, not."""

    text: str = ""
    open_end: bool = False
    field: str | None = None
    how: str | None = None
    sides: tuple[Match, ...] = ()

    def __and__(self, other: Match) -> Match:
        return Match(how="and", sides=(self, other))

    def __or__(self, other: Match) -> Match:
        return Match(how="or", sides=(self, other))

    def __sub__(self, other: Match) -> Match:
        return Match(how="not", sides=(self, other))

    def phrases(self) -> list[Match]:
        """The phrases in it, each once."""
        return list(dict.fromkeys([self] if self.how is None else [p for side in self.sides for p in side.phrases()]))

    def holds(self, found: dict[Match, Column]) -> Column:
        if self.how is None:
            return found[self]
        a, b = (side.holds(found) for side in self.sides)
        return a & b if self.how == "and" else a | b if self.how == "or" else a & ~b


def phrase(text: str, field: str | None = None) -> Match:
    """The tokens of ``text`` one after the other, in one field; without tokens nothing matches."""
    return Match(text, False, field)


word = phrase


def prefix(text: str, field: str | None = None) -> Match:
    """Like :func:`phrase`, but the last token may go on."""
    return Match(text, True, field)


def all_words(text: str, field: str | None = None) -> Match:
    """Every token between blanks, in any place."""
    parts = [phrase(x, field) for x in text.split()] or [phrase("", field)]
    return reduce(lambda a, b: a & b, parts)


def _frequency(tokens: list[str], open_end: bool, held: dict[tuple[str, bool], Column]) -> Column:
    """How often the tokens stand one after the other, from their positions in one field."""
    kinds = [(t, open_end and i == len(tokens) - 1) for i, t in enumerate(tokens)]
    moved = lambda places, back: F.transform(places, lambda x: x - back)
    at = held[kinds[0]]
    for i, kind in enumerate(kinds[1:], 1):
        at = F.array_intersect(at, moved(held[kind], i))
    return F.coalesce(F.size(at), F.lit(0))


def matches(index: DataFrame, match: Match) -> tuple[DataFrame, int]:
    """(doc_id, length, f0, f1, ...): how often each phrase of the match stands in each document that holds any of its tokens."""
    spark, asked = index.sparkSession, match.phrases()
    rows = spark.createDataFrame([(i, p.text) for i, p in enumerate(asked)], "i int, text string").select("i", search_tokens(F.col("text")).alias("t")).collect()  # as many as phrases
    tokens = [r["t"] for r in sorted(rows)]
    kinds = list(dict.fromkeys((t, p.open_end and i == len(ts) - 1) for p, ts in zip(asked, tokens, strict=True) for i, t in enumerate(ts)))
    is_kind = lambda kind: F.col("term").startswith(kind[0]) if kind[1] else F.col("term") == kind[0]
    rows = index.filter(reduce(or_, map(is_kind, kinds), F.lit(False))).repartition("doc_id")
    held = {kind: F.col(f"p{i}") for i, kind in enumerate(kinds)}
    # an open end gathers the positions of all terms that go on so in one field of one document; other terms have one row there
    per = rows.groupBy("doc_id", "field").agg(F.first("length").alias("length"), *[F.flatten(F.collect_list(F.when(is_kind(kind), F.col("positions")))).alias(f"p{i}") for i, kind in enumerate(kinds)])
    own = [F.lit(0) if not ts else _frequency(ts, p.open_end, held) if p.field is None else F.when(F.col("field") == p.field, _frequency(ts, p.open_end, held)).otherwise(0) for p, ts in zip(asked, tokens, strict=True)]
    return per.select("doc_id", "length", *[f.alias(f"f{i}") for i, f in enumerate(own)]).groupBy("doc_id").agg(F.first("length").alias("length"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(own))]), len(asked)


def search(index: DataFrame, match: Match) -> DataFrame:
    """(doc_id, score) of the documents that match, score (BM25 over the match's phrases) rising with relevance."""
    rows, n = matches(index, match)
    totals = index.filter("term = ''").agg(F.count("*").alias("N"), F.avg("length").alias("mean"))
    held = rows.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(n)])
    score = F.lit(0.0)
    for i in range(n):
        f, held_by = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("N") - held_by + 0.5) / (held_by + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    good = match.holds({p: F.col(f"f{i}") > 0 for i, p in enumerate(match.phrases())})
    return rows.filter(good).crossJoin(F.broadcast(totals.crossJoin(held))).select("doc_id", score.alias("score"))  # one row of totals


def snippet(text: Column, asked: str, width: int = 42) -> Column:
    """A stretch of the text around the first place of ``asked``, letter case, blanks and punctuation aside; else its beginning.

    The place is carried over from the bare text in proportion.
    """
    bare = lambda x: F.regexp_replace(F.lower(x), _BETWEEN, "")
    at, whole = F.instr(bare(text), bare(F.lit(asked))), F.length(bare(text))
    start = F.when((F.length(bare(F.lit(asked))) > 0) & (at > 0), F.greatest(F.lit(0), F.floor((at - 1) / F.greatest(whole, F.lit(1)) * F.length(text)) - width // 2)).otherwise(0).cast("int")
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.translate(F.substring(text, start + 1, F.lit(width)), "\n", " "), F.lit("…"))
    return F.when(F.length(text) > 0, cut).otherwise("")
