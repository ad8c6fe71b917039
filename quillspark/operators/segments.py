"""Structure of markdown: fences, headings, elements; and packing of elements into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folds import in_order, packed


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line", "text"))


def line_states(rows: DataFrame) -> DataFrame:
    """Adds in_code (between fences, fences included), level and title of headings outside code."""
    order = Window.partitionBy("doc_id").orderBy("line")
    fence = F.ltrim("text").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("in_code", fence | (F.col("fences") % 2 == 1))
    head = F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 1)
    level = F.when(~F.col("in_code") & (head != ""), F.length(head))
    return rows.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2)))).drop("fences")


def heading_paths(rows: DataFrame) -> DataFrame:
    """Adds path: the open headings above each line, joined by ' / '.

    A heading of level L is open until one of level L or less follows: per level the last
    heading, kept only if no smaller level came after it.
    """
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, 7):
        rows = rows.withColumn(f"_h{level}", F.last(F.when(F.col("level") == level, F.struct("line", "title")), ignorenulls=True).over(order))
    open_ = []
    for level in range(1, 7):
        smaller = [F.coalesce(F.col(f"_h{x}.line"), F.lit(-1)) for x in range(1, level)]
        newest = F.lit(-1) if not smaller else smaller[0] if len(smaller) == 1 else F.greatest(*smaller)
        open_.append(F.when(F.col(f"_h{level}.line") > newest, F.col(f"_h{level}.title")))
    return rows.withColumn("path", F.array_join(F.array_compact(F.array(*open_)), " / ")).drop(*[f"_h{x}" for x in range(1, 7)])


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, type, path, text): headings, list lines, code blocks with their fences, paragraphs of consecutive lines."""
    rows = heading_paths(line_states(lines(docs)))
    kind = F.when(F.col("in_code"), "code").when(F.col("level").isNotNull(), "heading").when(F.trim("text") == "", "blank").when(F.col("text").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list").otherwise("paragraph")
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("type", kind)
    starts = F.col("type").isin("heading", "list", "blank") | (F.col("type") != F.coalesce(F.lag("type").over(order), F.lit(""))) | (F.col("type") != "code") & (F.col("path") != F.coalesce(F.lag("path").over(order), F.col("path")))
    rows = rows.withColumn("grp", F.sum(starts.cast("int")).over(order)).filter("type <> 'blank'")
    grouped = rows.groupBy("doc_id", "grp").agg(F.first("type").alias("type"), F.first("path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return grouped.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("grp")) - 1).cast("long").alias("seq"), "type", "path", "text")


def pack_numbers(most: int, glue: int):
    """A vectorised function of (sizes, cuts): the number of the pack of each piece, filled in order up to ``most`` with ``glue`` between.

    A true cut starts a new pack.  What a pack holds depends on those before, so pieces of one text are
    gone through in order, once.
    """

    def number(sizes: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for own, starts in zip(sizes, cuts, strict=True):
            pack, held, numbers = -1, 0, []
            for size, cut in zip([] if own is None else own, [] if starts is None else starts, strict=True):
                if pack < 0 or cut or held + glue + size > most:
                    pack, held = pack + 1, size
                else:
                    held += glue + size
                numbers.append(pack)
            out.append(numbers)
        return pd.Series(out)

    return F.pandas_udf(number, "array<int>")


def packed_elements(parts: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, chunk, path, type, seq, text): elements (doc_id, seq, type, path, text) dealt to chunks in order.

    A chunk keeps one path and holds up to ``most`` characters, elements parted by a blank line;
    code stands alone.
    """
    order = ["seq", "type", "path", "text"]
    before = lambda c: F.lag(c).over(Window.partitionBy("doc_id").orderBy(*order))
    code = F.col("type") == "code"
    rows = in_order(parts.select("doc_id", *order), "doc_id", order)
    cut = code | (before("type") == "code") | ~F.col("path").eqNullSafe(before("path"))
    return packed(rows, "doc_id", F.length("text"), cut, most, 2).select("doc_id", F.col("pack").alias("chunk"), "path", "type", "seq", "text")


def chunk_texts(parts: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, chunk, path, text, n_elements, code) of :func:`packed_elements`; a chunk is gathered, so at most ``most`` characters or one element."""
    by = packed_elements(parts, most).groupBy("doc_id", "chunk").agg(F.first("path").alias("path"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("e"), F.max((F.col("type") == "code").cast("int")).alias("code"))
    return by.select("doc_id", "chunk", "path", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"), F.size("e").cast("long").alias("n_elements"), (F.col("code") == 1).alias("code"))


def chunks(parts: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, chunk, path, chars, n_elements) of :func:`packed_elements`; no text is gathered."""
    by = packed_elements(parts, most).groupBy("doc_id", "chunk").agg(F.first("path").alias("path"), F.sum(F.length("text")).alias("own"), F.count("*").alias("n_elements"))
    return by.select("doc_id", "chunk", "path", (F.col("own") + 2 * (F.col("n_elements") - 1)).cast("long").alias("chars"), "n_elements")


def index_totals(chunked: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, largest, chars) of chunks (doc_id, chunk, chars)."""
    return chunked.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("chars").alias("largest"), F.sum("chars").alias("chars"))


def _packed(rows: DataFrame, most: int, joint: str) -> DataFrame:
    """(doc_id, part, text) of rows (doc_id, p: array<struct<text, alone>>): pieces packed in order, size of the joint not counted."""
    cuts = F.transform("p", lambda x, i: x["alone"] | F.coalesce(F.get("p", i - 1)["alone"], F.lit(False)))
    rows = rows.withColumn("n", pack_numbers(most, 0)(F.transform("p", lambda x: F.length(x["text"])), cuts))
    out = rows.select("doc_id", F.posexplode(F.arrays_zip("p", "n")).alias("at", "z"))
    by = out.groupBy("doc_id", F.col("z.n").cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("z.p.text").alias("text")))).alias("e"))
    return by.select("doc_id", "part", F.array_join(F.transform("e", lambda x: x["text"]), joint).alias("text"))


#: Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[。！？；!?;])|(?<=\.\s)"


def split_long(docs: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, part, text): texts over ``most`` characters cut at ends of sentences, sentences over that cut hard; nothing is lost."""
    pieces = F.filter(F.split("text", SENTENCE_END), lambda x: x != "")
    hard = lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.length(x) / most).cast("int") - 1), lambda i: F.struct(F.substring(x, i * most + 1, F.lit(most)).alias("text"), F.lit(True).alias("alone")))
    parts = F.flatten(F.transform(pieces, lambda x: F.when(F.length(x) > most, hard(x)).otherwise(F.array(F.struct(x.alias("text"), F.lit(False).alias("alone"))))))
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("alone")))
    return _packed(docs.select("doc_id", F.when(F.length("text") > most, parts).otherwise(whole).alias("p")), most, "")


def structure_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, by, text): texts cut at their book marks, else at markdown headings, else at blank lines; numbered from 1.

    What is before the first heading is a block of its own; blocks without words go.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    some = lambda a: F.filter(F.transform(a, bare), lambda x: x != "")
    marked, headed = text.rlike(r"【第\d+[段条]】"), some(F.split(F.regexp_replace(text, r"(?m)^(#{1,6}\s)", "\u0001$1"), "\u0001"))
    by_mark = some(F.slice(F.split(text, r"【第\d+[段条]】"), 2, F.length(text) + 1))
    rows = docs.select("doc_id", text.alias("t"), marked.alias("marked"), F.when(marked, by_mark).alias("m"), headed.alias("h"))
    blocks = F.when(F.col("marked"), F.col("m")).when(F.size("h") > 1, F.col("h")).otherwise(some(F.split("t", r"\n\s*\n")))
    by = F.when(F.col("marked"), "marks").when(F.exists("h", lambda x: x.startswith("#")) & (F.size("h") > 1), "headings").otherwise("blank_lines")
    return rows.select("doc_id", by.alias("by"), F.posexplode(blocks).alias("block", "text")).select("doc_id", (F.col("block") + 1).cast("long").alias("block"), "by", "text")


def split_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """(doc_id, part, text): texts over ``most`` characters cut after sentences and at blank lines, pieces joined by line ends."""
    pieces = F.filter(F.split("text", r"(?<=[。！？；])|\n\s*\n"), lambda x: x != "")
    parts = F.transform(F.when(F.length("text") > most, pieces).otherwise(F.array("text")), lambda x: F.struct(x.alias("text"), F.lit(False).alias("alone")))
    out = _packed(blocks.select("doc_id", parts.alias("p")), most, "\n")
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", "")).filter("text <> ''")
