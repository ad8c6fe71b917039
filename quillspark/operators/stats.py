"""Text statistics, hygiene filters and secrets at line level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..plans.batches import lengths, pieces

#: Fixed value: assignments of quoted values of 8 or more characters to names of credentials.
SECRET = r"(?i)(api_?key|token|secret|password)\s*[:=]\s*[\"'][^\"']{8,}[\"']"


#: Fixed value: media of file endings.
MEDIA = {"md": "markdown", "markdown": "markdown", "txt": "txt", "pdf": "pdf", "html": "html", "epub": "epub", "srt": "subtitle", "vtt": "subtitle", "json": "txt"}


def described_files(files: DataFrame) -> DataFrame:
    """(path, media, title, family) of files (path, text): media by ending (null if unknown), the first ``# `` heading, up to 120 characters, or the name."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    media = F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), ending)
    text = F.coalesce("text", F.lit(""))
    heading = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#[ \t]+(.+?)[ \t]*$", 1))
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    head = F.substring(text, 1, 4000)
    family = F.when(F.regexp_count(head, F.lit(f"[{T.CJK}]")) * 20 > F.length(head), "zh").otherwise("en")
    return files.select("path", media.alias("media"), F.when(heading != "", F.substring(heading, 1, 120)).otherwise(name).alias("title"), family.alias("family"))


def document_stats(docs: DataFrame) -> DataFrame:
    """Per document: units, estimated tokens and language family."""
    head = F.substring("text", 1, 4000)
    cjk = F.regexp_count(head, F.lit(f"[{T.CJK}]"))
    return docs.select("doc_id", T.unit_count(F.col("text")).cast("long").alias("units"), T.token_estimate(F.col("text")).cast("long").alias("tokens"), F.when(cjk * 20 > F.length(head), "zh").otherwise("en").alias("family"))


def secret_documents(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(SECRET)).select("doc_id", F.regexp_count("text", F.lit(SECRET)).cast("long").alias("n_secrets"))


def expression_stats(docs: DataFrame) -> DataFrame:
    """Per language: texts, sentences and their lengths; too little text is a state of its own."""
    rows = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?。！？\n]+")).alias("s")).select("lang", F.length(F.trim("s")).cast("long").alias("n")).filter("n > 0")
    by = rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("n").alias("chars"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return by.withColumn("state", F.when(F.col("chars") >= 3000, "ok").otherwise("insufficient"))


def filler(text: Column, least: int = 8) -> Column:
    """Whether a text is filler: a bracketed reaction, thanks, or too few units."""
    return text.rlike(r"(?i)^\s*\((laughter|applause|music)\)|^\s*thank you") | (T.unit_count(text) < least)


def token_totals(docs: DataFrame) -> DataFrame:
    """One row per source: files, fewest, most and all estimated tokens."""
    own = docs.select("source", T.token_estimate(F.col("text")).cast("long").alias("t"))
    return own.groupBy("source").agg(F.count("*").alias("files"), F.min("t").alias("fewest"), F.max("t").alias("most"), F.sum("t").alias("tokens"))


def largest_files(docs: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, tokens): the ``top`` documents by estimated tokens, then by id."""
    return docs.select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(top)


def token_metrics(cards: DataFrame) -> DataFrame:
    """One row of cards (card, text): cards, fewest, median (cut to a whole number), most and all tokens, tokens of the front matter."""
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)\A---\n(.*?)\n---", 1)
    own = cards.select(T.token_estimate(F.col("text")).cast("long").alias("t"), T.token_estimate(head).cast("long").alias("h"))
    return own.agg(F.count("*").alias("cards"), F.min("t").alias("fewest"), F.percentile("t", F.lit(0.5)).cast("long").alias("median"), F.max("t").alias("most"), F.sum("t").alias("tokens"), F.sum("h").alias("discovery"))


#: Shell lines that do not do what they seem to.
HAZARDS = {
    # a variable without braces, and right after its name a letter beyond ASCII that a shell may take into it
    "name_meets_letter": r"\$[A-Za-z_][A-Za-z_0-9]*(?=[^\p{ASCII}])",
    # && or || behind a pipe that ends in head or tail, whose status it then tests
    "pipe_as_status": r"\|\s*(?:head|tail)\b[^&;|]*\|\s*(?:\|\||&&)",
    # a positional parameter that is not quoted
    "bare_argument": r"(?:^|[^\w$\"])\$[1-9](?:$|\W)",
}


def shell_hazards(scripts: DataFrame) -> DataFrame:
    """(path, line, hazard) of scripts (path, text), comments left out; lines count from 1."""
    rows = scripts.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n?|\n")).alias("line", "l"))
    code = F.get(F.split("l", "#", 2), 0)
    found = F.array_compact(F.array(*[F.when(code.rlike(p), F.lit(n)) for n, p in HAZARDS.items()]))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), F.explode(found).alias("hazard"))


#: Characters and words that no counted pair holds, words of four kinds, fewest characters of a sample.
STOP_CHARACTERS = "之乎者也矣焉哉其此彼是我你他吾爾予為與以於則而乃故蓋夫且若如所不無未有非勿毋豈何誰孰安焉曷胡得能可宜當須應將欲願敢"
STOP_WORDS = ("曰", "云", "先生", "愛", "問", "答", "一", "二", "三", "十", "又", "今", "時", "者", "也", "矣", "焉", "耳", "爾", "然", "後", "前", "中", "上", "下", "大", "小")
MARKERS = {
    "turn": ("然", "然而", "但", "顧", "雖然", "雖", "抑", "第", "但恐", "唯", "獨"),
    "certain": ("必", "定", "斷然", "決", "自然", "固是", "只是", "便是", "即是", "自是", "無疑", "決然", "斷斷", "本是", "原是"),
    "hedge": ("恐", "或", "庶幾", "未必", "恐未", "亦未", "竊", "姑", "且", "庶", "殆", "大抵", "大段", "約", "似"),
    "self": ("某", "吾", "我", "予", "僕", "愚"),
}
LEAST_SAMPLE = 3000


def sentence_lengths(texts: DataFrame, key: str, least: int = LEAST_SAMPLE) -> DataFrame:
    """(key, chars, state, sentences, mean_chars, stdev_chars, shortest, longest): how long sentences are, in characters that are no blanks.

    The deviation is that of the population.  Below ``least`` characters of text there are no figures.
    """
    text = F.coalesce("text", F.lit(""))
    bare = lambda c: F.length(F.regexp_replace(c, r"\s+", "")).cast("long")
    said = texts.select(key, F.explode(F.split(text, "[。！？；!?;]+")).alias("s")).select(key, bare(F.col("s")).alias("n"))
    # a blank piece is no sentence, but its key must not be lost
    by = said.groupBy(key).agg(F.sum("n").alias("chars"), F.count_if(F.col("n") > 0).alias("sentences"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("shortest"), F.max(F.when(F.col("n") > 0, F.col("n"))).alias("longest"))
    mean = F.col("chars") / F.col("sentences")
    deviation = F.sqrt(F.greatest(F.col("squares") / F.col("sentences") - mean * mean, F.lit(0.0)))
    ok = F.col("chars") >= least
    figures = {"mean_chars": F.round(mean, 1), "stdev_chars": F.round(deviation, 1), "shortest": F.col("shortest"), "longest": F.col("longest")}
    return by.select(key, "chars", F.when(ok, "ok").otherwise("insufficient").alias("state"), F.when(ok, F.col("sentences")).alias("sentences"), *[F.when(ok, c).alias(n) for n, c in figures.items()])


def marker_rates(texts: DataFrame, key: str, markers: dict[str, tuple[str, ...]] = MARKERS, least: int = LEAST_SAMPLE) -> DataFrame:
    """(key, chars, state, one rate for each kind of marker): occurrences in 1000 characters that are no blanks.

    Each word is counted without overlap of its own, so that a word inside a longer one counts in both.
    Below ``least`` characters there are no rates.
    """
    text = F.coalesce("text", F.lit(""))
    times = lambda w: (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    rows = texts.select(key, F.length(F.regexp_replace(text, r"\s", "")).cast("long").alias("chars"), *[sum((times(w) for w in words), F.lit(0.0)).alias(kind) for kind, words in markers.items()])
    by = rows.groupBy(key).agg(F.sum("chars").alias("chars"), *[F.sum(kind).alias(kind) for kind in markers])
    enough = F.col("chars") >= least
    return by.select(key, "chars", F.when(enough, "ok").otherwise("insufficient").alias("state"), *[F.when(enough, F.round(F.col(kind) * 1000 / F.col("chars"), 2)).alias(f"{kind}_rate") for kind in markers])


#: First CJK character, how many there are, what ends a sentence.
_FIRST, _MANY, _ENDS = 0x4E00, 0x5200, "。！？；!?;"


def _pair_counts(single: str):
    """(key, pair, n) of pieces of texts (key, text): pairs of CJK characters of a sentence, whatever else stands between them."""
    ends, stop = (np.array([ord(x) for x in own], np.uint32) for own in (_ENDS, single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ("text",)):
            sizes = lengths(batch.column("text"))
            own = batch.filter(pa.array(sizes > 0))
            if not own.num_rows:
                continue
            keys = own.column("key").dictionary_encode(null_encoding="encode")
            texts = own.column("text").to_pylist()
            x = np.frombuffer(_ENDS[0].join([*texts, ""]).encode("utf-32-le"), np.uint32)  # texts are parted as sentences are
            key = np.repeat(keys.indices.to_numpy().astype(np.int64), [len(t) + 1 for t in texts])
            cjk = (x >= _FIRST) & (x < _FIRST + _MANY)
            kept = cjk | np.isin(x, ends)
            x, key, good = x[kept].astype(np.int64) - _FIRST, key[kept], (cjk & ~np.isin(x, stop))[kept]
            both = np.flatnonzero(good[:-1] & good[1:])
            code, n = np.unique((key[both] * _MANY + x[both]) * _MANY + x[both + 1], return_counts=True)
            first, second = code // _MANY % _MANY + _FIRST, code % _MANY + _FIRST
            pairs = np.stack([first, second], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code // _MANY**2)), pa.array([pairs[i : i + 2] for i in range(0, len(pairs), 2)], pa.string()), pa.array(n)], ["key", "pair", "n"])

    return run


def top_bigrams(texts: DataFrame, key: str, top: int = 10, stop: tuple[str, ...] = (*STOP_CHARACTERS, *STOP_WORDS)) -> DataFrame:
    """(key, pair, n, rank): the most frequent pairs of CJK characters within a sentence, without stop characters; ties in code point order."""
    single = "".join(x for x in stop if len(x) == 1)  # no pair holds a stop word of two characters
    pairs = texts.select(F.col(key).alias("key"), "text").mapInArrow(_pair_counts(single), f"key {dict(texts.dtypes)[key]}, pair string, n long")
    by = pairs.groupBy(F.col("key").alias(key), "pair").agg(F.sum("n").alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pair"))).filter(F.col("rank") <= top)


def top_titles(texts: DataFrame, key: str, top: int = 8) -> DataFrame:
    """(key, title, n, rank): the titles most often named between 《 and 》, of up to 12 characters."""
    named = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit("《([^》]{1,12})》"), F.lit(1))).alias("title"))
    by = named.groupBy(key, "title").agg(F.count("*").alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "title"))).filter(F.col("rank") <= top)
