"""Quotations in cards: finding them, giving them to locators, and checking them against the cited places."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import tokens as T
from ..plans.folds import folded
from ..plans.scratch import written
from .occurrences import occurrences, occurrences_by_key
from .segments import lines

#: Quotation forms, words that mark a quotation as talk about quotations, forms of locators.
LINT_QUOTES = ("「([^」]{8,400})」", '"([^"\\n]{8,400})"')
ANCHOR_QUOTES = ('"([^"\\n]{4,600})"', "[「“]([^」”\\n]{4,600})[」”]")
META_TAGS = ("归属拆分", "**归属**", "归属：", "归属标注", "措辞修正", "口径统一", "更正记录")
AUTHOR_FRAME = ("语言信号", "用户会怎么说", "触发情境")
PATH_LIKE = r"://|[*?]|[/\\](?:[^/\\\s一-鿿]{40}|[^/\\\s一-鿿]{1,39}(?:[/\\\s]|$))"
CITE, SEGMENT, DITTO = r"(?:src-[A-Za-z0-9_.-]+\s*)?§\d+", r"第\s*\d+\s*[段条]", "同上"
ENTRY = r"【第(\d+)条"
STAMP = r"[\[【]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
STAMP_GAP = r"[\]】\s、,，/和及]*"
GAP_CHARS, GAP_FORM = 3, r"^[\s（）()：:，,、＋+—*]*$"
WINDOW_CHARS, PART_CHARS, RUN_CHARS = 120, 8, 18
LEAST_RATIO = 0.80


def _found(text: Column, forms: tuple[str, ...]) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(form), F.lit(1)) for form in forms])


def _any_tag(text: Column, tags: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for tag in tags:
        out = out | text.contains(tag)
    return F.coalesce(out, F.lit(False)).cast("int")


def lint_quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, line, quote, meta): quotations of 8 to 400 characters that are no paths.

    ``meta``: the line or one beside it speaks of attribution, or one from 7 before to 1 after
    frames examples of the author's.
    """
    near = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-1, 1)
    wide = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-7, 1)
    text = F.col("text")
    meta = (F.max(_any_tag(text, META_TAGS)).over(near) + F.max(_any_tag(text, AUTHOR_FRAME)).over(wide)) > 0
    rows = lines(docs).withColumn("meta", meta).filter(text.rlike("[\"「]"))
    quote = F.trim("quote")
    return rows.select("doc_id", "line", "meta", F.explode(_found(text, LINT_QUOTES)).alias("quote")).select("doc_id", F.col("line").cast("long").alias("line"), quote.alias("quote"), "meta").filter((F.length("quote") >= 8) & ~F.col("quote").rlike(PATH_LIKE))


def anchor_quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, line, quote, kind) of all candidates: quote, short (4 to 7 CJK characters, needs the corpus) or noise."""
    rows = lines(docs).filter(F.col("text").rlike("[\"「“]")).select("doc_id", F.col("line").cast("long").alias("line"), F.explode(_found(F.col("text"), ANCHOR_QUOTES)).alias("quote"))
    own, cjk = F.trim("quote"), F.regexp_count(F.col("quote"), F.lit(f"[{T.CJK}]"))
    enough = (cjk >= 8) & (cjk >= F.length(own) * 0.4) | own.rlike("^[A-Za-z0-9]") & own.rlike("[A-Za-z]{2}") & (F.length(own) >= 12)
    return rows.select("doc_id", "line", own.alias("quote"), F.when(enough, "quote").when(cjk.between(4, 7), "short").otherwise("noise").alias("kind"))


def owned_quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, line, quote) of quotations that a locator of their line owns.

    Between locator and quotation lie at most 3 characters of a few forms, or another quotation and
    one separator.  A line is cut into locators, quotations and single other characters; gaps are
    slices of that list.
    """
    token = f'{CITE}|{SEGMENT}|"[^"\\n]{{4,600}}"|[「“][^」”\\n]{{4,600}}[」”]|.'
    rows = lines(docs).filter(F.col("text").rlike(f"{CITE}|{SEGMENT}")).select("doc_id", "line", F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("t"))
    is_quote = lambda x: (F.length(x) > 2) & F.substring(x, 1, 1).isin('"', "「", "“")
    is_cite = lambda x: x.rlike("§")
    is_mark = lambda t, x, i: is_cite(x) | x.rlike(f"^{SEGMENT}$") & ~F.coalesce(F.get(t, i - 1), F.lit("")).rlike(f"[{T.CJK}]$") & F.array_join(F.slice(t, i + 2, 601), "").rlike(r'^\s*[「“"『]')
    marks = F.filter(F.transform("t", lambda x, i: F.when(is_mark(F.col("t"), x, i), i)), lambda x: x.isNotNull())
    rows = rows.withColumn("m", marks).filter(F.size("m") > 0)
    rows = rows.select("doc_id", "line", "t", "m", F.posexplode("t").alias("i", "x")).filter(is_quote(F.col("x")))
    before, after = F.array_max(F.filter("m", lambda j: j < F.col("i"))), F.array_min(F.filter("m", lambda j: j > F.col("i")))
    gap_before = F.when(before.isNotNull(), F.array_join(F.slice("t", before + 2, F.col("i") - before - 1), ""))
    gap_after = F.when(after.isNotNull(), F.array_join(F.slice("t", F.col("i") + 2, after - F.col("i") - 1), ""))
    fits = lambda gap: F.coalesce((F.length(F.trim(gap)) <= GAP_CHARS) & gap.rlike(GAP_FORM) | gap.rlike(r'^[^\n]{0,600}[」”"』]\s*[／/、,，]?\s*$'), F.lit(False))
    return rows.filter(fits(gap_before) | fits(gap_after)).select("doc_id", F.col("line").cast("long").alias("line"), F.expr("substring(x, 2, length(x) - 2)").alias("quote"))


def block_targets(docs: DataFrame) -> DataFrame:
    """(doc_id, line, target) of block lines with a segment: their own, that of the next attribution in the block, or the last one for "ditto".

    Blank lines inside a block are passed over; any other line ends it.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    number = F.regexp_extract("text", r"第(\d+)[段条]", 1)
    rows = lines(docs).withColumn("quoted", F.ltrim("text").startswith(">")).withColumn("number", F.when(F.col("quoted") & (number != ""), number.cast("long")))
    breaks = (~F.col("quoted") & (F.trim("text") != "")).cast("int")
    rows = rows.withColumn("block", F.sum(breaks).over(order)).withColumn("last", F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sign = F.coalesce("number", F.when(F.col("quoted") & F.col("text").contains(DITTO), F.col("last")))
    ahead = Window.partitionBy("doc_id", "block").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("sign", sign).withColumn("next", F.first("sign", ignorenulls=True).over(ahead))
    target = F.coalesce("number", "next", "sign")
    return rows.filter(F.col("quoted")).select("doc_id", F.col("line").cast("long").alias("line"), target.alias("target")).filter("target is not null")


def _asked(quote: Column, longest: int | None) -> Column:
    """What of a quotation is looked for: its bare form, whole or its first ``longest`` characters."""
    own = T.fragment(quote)
    return own if longest is None else F.substring(own, 1, longest)


def entry_references(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """(doc_id, pos, entry, quotes): each reference to an entry with the quotations of its window.

    A window is 120 characters from the reference and stops at the next one; a quotation that ends
    in it is taken whole, or its first ``longest`` characters.
    """
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"({ENTRY})", "\u0001$1"), "\u0001")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part")).filter("pos > 0")
    quotes = F.transform(F.regexp_extract_all(F.substring("part", 1, WINDOW_CHARS), F.lit("(?s)「(.+?)」"), F.lit(1)), lambda x: _asked(x, longest))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("part", ENTRY, 1).cast("long").alias("entry"), F.filter(quotes, lambda x: F.length(x) >= 8).alias("quotes"))


def checked_references(references: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, pos, entry, status): unquoted, orphaned (no such entry), verified or unverified; equi join on the entry."""
    both = references.join(entries.select("entry", T.fragment(F.col("text")).alias("body")), "entry", "left")
    hit = F.exists("quotes", lambda q: F.col("body").contains(q))
    status = F.when(F.size("quotes") == 0, "unquoted").when(F.col("body").isNull(), "orphaned").when(hit, "verified").otherwise("unverified")
    return both.select("doc_id", "pos", "entry", status.alias("status"))


def stamp_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, line, grp, stamp): time marks; those with nothing but separators between them share a group."""
    run = f"{STAMP}(?:{STAMP_GAP}{STAMP})*"
    rows = lines(docs).select("doc_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("grp", "run"))
    stamps = F.regexp_extract_all("run", F.lit(r"[\[【](\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)"), F.lit(1))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.col("grp").cast("long").alias("grp"), F.explode(stamps).alias("stamp")).withColumn("stamp", F.translate("stamp", ",", "."))


def _parts(fragment: Column) -> Column:
    return F.filter(F.transform(F.split(fragment, r"[,;:!?]|\.\s"), lambda x: F.trim(x)), lambda x: F.length(x) >= PART_CHARS)


def loose_match(fragment: Column, body: Column) -> Column:
    """The body holds the fragment, two of its parts, or a part of 18 characters."""
    hits = F.filter(_parts(fragment), lambda p: body.contains(p))
    return F.coalesce((F.length(fragment) > 0) & (body.contains(fragment) | (F.size(hits) >= 2) | F.exists(hits, lambda p: F.length(p) >= RUN_CHARS)), F.lit(False))


def _cut_off(fragment: Column, body: Column) -> Column:
    n = F.greatest(F.lit(12), F.floor(F.length(fragment) / 2).cast("int"))
    head, tail = F.substring(fragment, F.lit(1), n), F.substring(fragment, n + 1, F.length(fragment))
    return ~body.contains(fragment) & (F.length(tail) > 0) & body.contains(head) & ~body.contains(tail)


def checked_stamps(claims: DataFrame, cues: DataFrame, longest: int | None = None) -> DataFrame:
    """(claim_id, status, places): claims (claim_id, file, stamp, quote) against cues (file, stamp, text).

    Quotations are compared whole, or their first ``longest`` characters.  One cut off at its cue may
    go on in the next two.  One that is not at its stamp is misplaced if other cues of the file match
    (the first three are named), else unverified; orphaned without such a stamp.  Quotations and parts
    that are not at their stamp are sought in the cues of their file, each of which is read once, so
    claims meet only cues that hold something of theirs.
    """
    order = Window.partitionBy("file").orderBy("stamp")
    body = cues.select("file", "stamp", T.fragment(F.col("text")).alias("body"))
    wide = body.withColumn("more", F.concat_ws(" ", "body", F.lead("body", 1).over(order), F.lead("body", 2).over(order)))
    own = claims.select("claim_id", "file", "stamp", _asked(F.col("quote"), longest).alias("q"))
    both = own.join(wide, ["file", "stamp"], "left")
    ok = loose_match(F.col("q"), F.col("body")) | F.coalesce(_cut_off(F.col("q"), F.col("body")) & loose_match(F.col("q"), F.col("more")), F.lit(False))
    first = written(both.select("claim_id", "file", "q", F.when(F.col("body").isNull(), "orphaned").when(ok, "verified").otherwise("open").alias("status")), "claims")
    parts = _parts(F.col("q"))
    wanted = first.filter("status = 'open'").select("claim_id", "file", "q", parts.alias("parts"), F.explode(F.array_distinct(F.concat(F.array("q"), parts))).alias("string"))
    wanted = wanted.select("claim_id", "file", "string", (F.col("string") == F.col("q")).alias("whole"), F.size(F.filter("parts", lambda x: x == F.col("string"))).alias("times"))
    held = occurrences_by_key(wanted.select(F.col("file").alias("key"), "string"), body.select(F.col("file").alias("key"), F.col("stamp").alias("text_id"), F.col("body").alias("text")))
    held = held.select(F.col("key").alias("file"), F.col("text_id").alias("stamp"), "string")
    by = wanted.join(held, ["file", "string"]).groupBy("claim_id", "stamp").agg(F.max("whole").alias("whole"), F.sum("times").alias("times"), F.max(F.when(F.col("times") > 0, F.length("string"))).alias("longest"))
    found = by.filter(F.col("whole") | (F.col("times") >= 2) | (F.col("longest") >= RUN_CHARS)).select("claim_id", "stamp")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("claim_id").orderBy("stamp"))).filter("nth <= 3").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("stamp")), " ").alias("places"))
    out = first.join(found, "claim_id", "left")
    status = F.when(F.col("status") != "open", F.col("status")).when(F.col("places").isNotNull(), "misplaced").otherwise("unverified")
    return out.select("claim_id", status.alias("status"), F.coalesce("places", F.lit("")).alias("places"))


def resolved_claims(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim_id, src, seg, status): claims (claim_id, src, seg) against segments (src_no, src, seg).

    A written source means the source of that name, else the first in order whose name
    holds its tail; none means the first source.  Only distinct names meet distinct names.
    """
    names = segments.select("src_no", F.col("src").alias("name")).distinct()
    raw = F.lower(F.trim(F.coalesce("src", F.lit(""))))
    asked = claims.select(raw.alias("raw")).distinct().withColumn("tail", F.regexp_replace("raw", "^src-", ""))
    same = asked.join(names, F.col("raw") == F.col("name")).select("raw", F.lit(0).alias("rank"), "src_no", "name")
    held = occurrences(asked.select(F.col("tail").alias("string")), names.select(F.struct("src_no", "name").alias("text_id"), F.lower("name").alias("text")))
    held = asked.join(held, F.col("tail") == F.col("string")).select("raw", F.lit(1).alias("rank"), "text_id.src_no", "text_id.name")
    first = names.agg(F.min(F.struct("src_no", "name")).alias("n"))
    bare = asked.filter("tail = ''").crossJoin(F.broadcast(first)).select("raw", F.lit(1).alias("rank"), "n.src_no", "n.name")  # one row
    best = same.union(held).union(bare).groupBy("raw").agg(F.min(F.struct("rank", "src_no", "name")).alias("n")).select("raw", "n.name")
    own = claims.select("claim_id", "seg", raw.alias("raw")).join(best, "raw", "left")
    known = segments.select(F.col("src").alias("name"), "seg", F.lit(True).alias("known")).distinct()
    both = own.join(known, ["name", "seg"], "left")
    status = F.when(F.col("name").isNull(), "unknown_source").when(F.col("known"), "found").otherwise("unknown_segment")
    return both.select("claim_id", F.col("name").alias("src"), "seg", status.alias("status"))


#: Texts of a block of pairs on each side, partitions of blocks at most, slots that pairs of characters are hashed to.
BLOCK, PARTS, SLOTS = 250, 4000, 4096


def _slots(text: str) -> np.ndarray:
    """The slot of each pair of neighbouring characters."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (x[:-1] * 31 + x[1:]) % SLOTS


def _common(bits: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of n characters whose places are bits of a number for each character."""
    full = rest = (1 << n) - 1
    for c in text:
        hit = rest & bits.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return n - rest.bit_count()


def _alike(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(quote, sent_id, length, ratio) of a block's alike pairs; its quotations come first, then sentences, some at a time."""
    quotes: list[str] = []
    size, have, places = np.zeros(0), np.zeros((0, SLOTS), np.float32), []
    while part := list(itertools.islice(rows, BLOCK)):
        quotes += [own for _, is_sentence, _, own in part if not is_sentence]
        said = [(sid, own) for _, is_sentence, sid, own in part if is_sentence]
        if not said:
            continue
        if len(have) < len(quotes):  # all are known once a sentence comes
            size, have = np.array([len(q) for q in quotes]), np.zeros((len(quotes), SLOTS), np.float32)
            for i, q in enumerate(quotes):
                np.add.at(have[i], _slots(q), 1)
                bits: dict[str, int] = {}
                for k, c in enumerate(q):
                    bits[c] = bits.get(c, 0) | 1 << k
                places.append(bits)
        held = np.zeros((len(said), SLOTS), np.float32)
        for j, (_, own) in enumerate(said):
            held[j, _slots(own)] = 1
        shared = have @ held.T
        m = np.array([len(own) for _, own in said])
        both = size[:, None] + m[None, :]
        near = (np.minimum(size[:, None], m[None, :]) * 10 >= both * 4) & (shared * 5 + 5 >= both)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            q, (sid, own) = quotes[i], said[j]
            if _common(places[i], len(q), own) * 10 >= 4 * (len(q) + len(own)):
                ratio = difflib.SequenceMatcher(None, q, own).ratio()
                if ratio >= LEAST_RATIO:
                    yield q, sid, len(own), ratio


def best_sentences(quotes: DataFrame, sentences: DataFrame) -> DataFrame:
    """(quote_id, sent_id, ratio): the most alike sentence of each quotation (8 characters or more), if 0.80 alike and of about its length.

    Distinct texts meet in blocks.  M matching characters of n + m lie in runs with at most n + m - 2M
    others between, so at ratio 0.8 at least M/2 - 1 of the quotation's pairs are in the sentence, and 2M
    is at least 0.8 (n + m); they are a common subsequence as well, whose greatest length is counted before
    the ratio.  Nothing alike enough is left out; ties go to the smaller sent_id.
    """
    asked = written(quotes.filter(F.length("quote") >= 8).select("quote").distinct(), "quotes")
    said = written(sentences.filter("length(sentence) > 1").groupBy("sentence").agg(F.min("sent_id").alias("sent_id")), "sentences")
    parts = [max(1, -(-x.count() // BLOCK)) for x in (asked, said)]
    own = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.struct("a", "b").alias("block")
    sid = said.schema["sent_id"]
    rows = asked.withColumn("a", own("quote", parts[0])).withColumn("b", every(parts[1])).select(block, F.lit(False).alias("is_sentence"), F.lit(None).cast(sid.dataType).alias("sent_id"), F.col("quote").alias("own"))
    rows = rows.union(said.withColumn("b", own("sentence", parts[1])).withColumn("a", every(parts[0])).select(block, F.lit(True), "sent_id", "sentence"))
    near = folded(rows, "block", ["is_sentence"], _alike, StructType([asked.schema["quote"], sid, StructField("m", LongType()), StructField("ratio", DoubleType())]), min(parts[0] * parts[1], PARTS))
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("quote").orderBy(F.desc("ratio"), "sent_id"))).filter("nth = 1")
    n = F.length("quote")
    best = best.filter(F.abs(n - F.col("m")) <= F.greatest(F.lit(4), F.floor(n / 4))).select("quote", "sent_id", "ratio")
    return quotes.select("quote_id", "quote").join(best, "quote").select("quote_id", "sent_id", "ratio")


@F.pandas_udf(ArrayType(StringType()))
def _differing(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        pairs = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes():
            if tag != "equal":
                left, right = (x or "")[i:j], (y or "")[k:m]
                pairs += [f"{left[n : n + 1]}>{right[n : n + 1]}" for n in range(max(len(left), len(right)))]
        out.append(pairs[:8])
    return pd.Series(out)


def differing_characters(pairs: DataFrame) -> DataFrame:
    """(quote_id, sent_id, differs) of matched pairs (quote_id, sent_id, quote, sentence): up to 8 of ``a>b``, one side empty where the other has more."""
    return pairs.select("quote_id", "sent_id", _differing("quote", "sentence").alias("differs"))
