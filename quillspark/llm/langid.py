"""Operator 7: language identification with bit-sliced n-gram filters.

Texts are lower-cased, every run of other characters than letters becomes one blank, and
byte n-grams are taken.  From the labelled rows that may be learned, the n-grams that
make up at least a given share of a language's n-grams are put into that language's Bloom
filter.  The filters of all languages share their hash functions and are stored bit-sliced:
a slot holds one bit for each language, so that one lookup (the AND of a few slots) tells
all languages that contain an n-gram.  A text's n-grams are counted for each language;
filters also answer yes by chance, at a rate known from how full they are, and the
counts are corrected for it.  The language of the largest corrected count wins.

The learned shares bound the model: a language has at most 1 / SHARE n-grams.

Cases: a null text or one without a letter is ``und`` with score 0; a text whose n-grams
no filter holds, and any text when nothing could be learned, is given the language with
most learned text (``und`` if there is none) with score 0; equal counts go to the language
first in code point order; repeated rows are returned one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, is_training, keeps_names, materialize, restrict, ship_package, text_or_empty
from .shingles import _slices, mix64, stream64, string_bytes

#: Bytes of an n-gram; least share of a language's n-grams; slots (a power of two) and hashes of the filters.
SIZES, SHARE, SLOTS, HASHES = (3, 4), 1 / 20_000, 1 << 20, 2
#: Documents of each language, those of smallest hash, from which filters are learned.
LEARNED = 20_000
#: The pipeline's stage rejects texts with at least REJECT_GRAMS n-grams of which less than this share is known.
REJECT_BELOW, REJECT_GRAMS = 0.15, 50
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def gram_keys(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, n-gram keys of all rows in order, n-grams of each row) slice by slice."""
    data, offsets = string_bytes(column)
    for lo, hi in _slices(offsets):
        base, cuts = int(offsets[lo]), offsets[lo : hi + 1] - int(offsets[lo])
        raw = data[base : int(offsets[hi])]
        rows = hi - lo
        # a blank before and after each row
        at = np.arange(len(raw)) + 2 * np.repeat(np.arange(rows), np.diff(cuts)) + 1
        text = np.full(len(raw) + 2 * rows, 32, np.uint8)
        text[at] = _FOLD[raw]
        upper = np.flatnonzero(text[:-1] == 0xC3) + 1
        text[upper] |= np.where((text[upper] >= 0x80) & (text[upper] <= 0x9E) & (text[upper] != 0x97), 0x20, 0).astype(np.uint8)
        row = np.repeat(np.arange(rows), np.diff(cuts) + 2)
        solid = np.append(True, (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1]))
        text, row = text[solid].astype(np.uint32), row[solid]
        keys, owners = [], []
        for n in SIZES:
            if len(text) < n:
                continue
            own = np.zeros(len(text) - n + 1, np.uint32)
            for j in range(n):
                own |= text[j : len(text) - n + 1 + j] << np.uint32(8 * j)
            same = row[: len(own)] == row[n - 1 :]
            keys.append(own[same]), owners.append(row[: len(own)][same])
        if not keys:
            yield lo, np.zeros(0, np.uint32), np.zeros(rows, np.int64)
            continue
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield lo, np.concatenate(keys)[order], np.bincount(owner, minlength=rows)


@dataclass(frozen=True)
class LanguageFilters:
    """Bit-sliced Bloom filters; bit i of a slot belongs to ``languages[i]``."""

    languages: tuple[str, ...]
    slots: np.ndarray
    #: For each language, how often its filter says yes to an n-gram that is not in it.
    chance: np.ndarray
    default: str

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], default: str, size: int = SLOTS, hashes: int = HASHES) -> LanguageFilters:
        languages = tuple(sorted(grams))
        width = np.uint8 if len(languages) <= 8 else np.uint64
        slices = max(1, -(-len(languages) // 64))
        slots = np.zeros((slices, size), width if slices == 1 else np.uint64)
        chance = np.zeros(len(languages))
        for i, name in enumerate(languages):
            for at in cls.places(grams[name], size, hashes):
                slots[i // 64, at] |= slots.dtype.type(1 << (i % 64))
            full = ((slots[i // 64] >> slots.dtype.type(i % 64)) & slots.dtype.type(1)).mean()
            chance[i] = full**hashes
        return cls(languages, slots, chance, default)

    @staticmethod
    def places(keys: np.ndarray, size: int, hashes: int = HASHES) -> Iterator[np.ndarray]:
        h = mix64(keys.astype(np.uint64) + stream64(1, 71)[0])
        bits = np.uint64(size.bit_length() - 1)
        for k in range(hashes):
            yield ((h >> (np.uint64(k) * bits)) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each key the bits of all languages that contain it, one row for each slice of 64 languages."""
        out = None
        for at in self.places(keys, self.slots.shape[1]):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def counts(self, keys: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        """Corrected counts, rows by languages."""
        masks = self.masks(keys)
        row = np.repeat(np.arange(len(per_row)), per_row)
        out = np.zeros((len(per_row), len(self.languages)))
        for i, chance in enumerate(self.chance):
            one = masks.dtype.type(1)
            hits = np.bincount(row, weights=((masks[i // 64] >> masks.dtype.type(i % 64)) & one), minlength=len(per_row))
            out[:, i] = np.maximum(hits - per_row * chance, 0) / (1 - min(chance, 0.999))
        return out


def learn(docs: DataFrame, share: float = SHARE, learned: int = LEARNED) -> LanguageFilters:
    """Filters from text and non-null lang of the rows that may be learned, at most ``learned`` documents a language."""
    ship_package(docs.sparkSession)
    rows = docs.filter(is_training() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id").alias("h"))
    total = rows.groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in total.collect()}  # one row for each language
    if not sizes:
        return LanguageFilters.build({}, UNKNOWN)
    # a hash below the language's quota; the bound holds up to the spread of a binomial draw
    quota = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, learned / n))])
    drawn = rows.filter((F.col("h") / F.lit(float(2**64)) + 0.5) < F.element_at(quota, F.col("lang"))).select("doc_id")
    ids = materialize(drawn.distinct(), "learned")
    chosen = restrict(docs.filter(is_training() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", text_or_empty().alias("text")), ids, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs.tolist())):
                own = batch.column("text").filter(pa.array(langs == lang))
                found = [known[lang]] if lang in known else []
                for _, keys, _ in gram_keys(own):
                    found.append(np.unique(keys, return_counts=True))
                keys, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                known[lang] = (keys, np.bincount(where, weights=np.concatenate([x[1] for x in found])).astype(np.int64))
        for lang, (keys, n) in known.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    counts = materialize(arrow_map(chosen.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    whole = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    often = counts.join(F.broadcast(whole), "lang").filter(F.col("n") >= F.col("whole") * share).select("lang", "gram").toPandas()  # at most 1 / share for each language and n-gram size
    grams = {lang: own["gram"].to_numpy(np.uint32) for lang, own in often.groupby("lang")}
    return LanguageFilters.build({lang: grams.get(lang, np.zeros(0, np.uint32)) for lang in sizes}, max(sorted(sizes), key=sizes.get))


def predict_languages(docs: DataFrame, filters: LanguageFilters, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_grams, has_letter, and the string columns named in ``keep``."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS slots, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        names = np.array([*own.languages, own.default], dtype=object)
        for batch in batches:
            best, score, total = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if own.languages:
                for lo, keys, per_row in gram_keys(batch.column("text")):
                    counts = own.counts(keys, per_row)
                    top = counts.argmax(1)
                    most = counts[np.arange(len(top)), top]
                    to = slice(lo, lo + len(top))
                    best[to] = np.where(most > 0, top, len(own.languages))
                    score[to] = np.clip(most / np.maximum(per_row, 1), 0, 1)
                    total[to] = per_row
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score), "n_grams": pa.array(total), "has_letter": batch.column("has_letter"), **{c: batch.column(c) for c in keep}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *keep).withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    found = arrow_map(rows, run, ", ".join(["doc_id long, lang_pred string, score double, n_grams long, has_letter boolean", *[f"{c} string" for c in keep]]))
    return found.withColumns({"lang_pred": F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(F.col("has_letter"), F.col("score")).otherwise(F.lit(0.0))})


@keeps_names
def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that are in no learned language: no letter, or hardly a known n-gram.

    A text alone decides, so that rows of equal id or without one are judged each by its own text.
    """
    key = F.md5(text_or_empty().cast("binary"))
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), text_or_empty().alias("text"), key.alias("key"))
    found = predict_languages(texts, learn(docs), ["key"])
    gone = found.filter((F.col("lang_pred") == UNKNOWN) | ((F.col("n_grams") >= REJECT_GRAMS) & (F.col("score") < REJECT_BELOW)))
    gone = materialize(gone.select("key").distinct(), "gone")
    return restrict(docs.withColumn("_key", key), gone, "_key", "left_anti").select(*docs.columns)
