"""Token counts of whole texts, from the counts of distinct pre-tokens.

A tokenizer encodes pre-tokens one by one, so a text has as many tokens as its pre-tokens have
together.  The corpus repeats its pre-tokens without end: they are gathered distinct, the library
encodes each of them once, and every document sums the counts of its pre-tokens times their
frequency in it.  Nobody holds token ids.

Pre-tokens are cut as in :mod:`.bpe`, where every pre-tokenizer is sure to cut; texts with rare white
space or with the string of a special token are cut by the library's own pre-tokenizer.

The counts are joined in two ways, by frequency.  The most frequent pre-tokens, ``head`` at most,
go to every task; nearly all occurrences find theirs there.  What is left of a document, rare by
construction and so never a hot key, meets the other counts in a shuffle.  Neither way leaves
anything out.

Pre-tokens travel as 64-bit hashes.  Hashes that two pre-tokens share show up when the distinct ones
are gathered; a document with one of them is encoded whole.

Cases: null and empty texts have 0 bytes and 0 tokens.  Every row gives one row, with its doc_id as
it is: null, repeated or not.  No documents: no rows.  Only doc_id and text are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceEncoder, _piece_keys, encoder
from .common import arrow_map, materialize
from .shingles import _slices, string_bytes

#: Pre-tokens whose counts every task gets (16 bytes each).
HEAD = 1 << 20
#: Distinct pre-tokens that a task holds before it hands them on, and how many the library gets at once.
HELD, AT_ONCE = 200_000, 2_000
#: Tokens above which a document is over the limit.
LIMIT = 1024


class PreTokens:
    """Cuts Arrow string columns into pre-tokens of the tokenizer file at ``path``."""

    def __init__(self, path: str, key_bits: int = 64) -> None:
        self.encoder: PieceEncoder = encoder(path)
        tokenizer = self.encoder.tokenizer
        added = [x for x in tokenizer.get_added_tokens_decoder().values() if x.content]
        plain = all(x.special and not (x.lstrip or x.rstrip or x.single_word) for x in added)
        #: Whether the library's pre-tokenizer tells the cuts of a text as it stands.
        self.cuts = tokenizer.pre_tokenizer if tokenizer.normalizer is None and plain else None
        self.special = {x.content for x in added}
        self.around = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.mask = np.uint64((1 << key_bits) - 1)

    def _exactly(self, text: str) -> list[bytes]:
        if self.cuts is None:
            return [text.encode()]
        out = []
        for part in self.around.split(text) if self.around else [text]:
            out += [part.encode()] if part in self.special else [part[b:e].encode() for _, (b, e) in self.cuts.pre_tokenize_str(part)]
        return [x for x in out if x]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(first row, end row, bytes, begins, ends, rows, keys)``; rows count from the first one."""
        data, offsets = string_bytes(column)
        for lo, hi in _slices(offsets):
            base = int(offsets[lo])
            text, cuts = data[base : int(offsets[hi])], offsets[lo : hi + 1] - base
            if not len(text):
                continue
            slow = self.encoder._slow_rows(text, cuts)
            begin, end = self.encoder._pieces(text, cuts, slow)
            row = np.searchsorted(cuts, begin, "right") - 1
            if slow.any():
                keep = ~slow[row]
                own = [(i, x) for i in np.flatnonzero(slow) for x in self._exactly(text[cuts[i] : cuts[i + 1]].tobytes().decode())]
                sizes = np.fromiter((len(x) for _, x in own), np.int64, len(own))
                last = len(text) + np.cumsum(sizes)
                text = np.append(text, np.frombuffer(b"".join(x for _, x in own), np.uint8))
                begin, end, row = np.append(begin[keep], last - sizes), np.append(end[keep], last), np.append(row[keep], np.fromiter((i for i, _ in own), np.int64, len(own)))
            if len(begin):
                yield lo, hi, text, begin, end, row, _piece_keys(text, begin, end)

    def count(self, pieces: list[str]) -> list[int]:
        return [len(x.ids) for x in self.encoder.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def distinct_pieces(docs: DataFrame, path: str, key_bits: int = 64) -> DataFrame:
    """(key, piece binary, seen): the distinct pre-tokens of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path, key_bits)
        held: dict[tuple[int, bytes], int] = {}

        def handed_on() -> pa.RecordBatch:
            keys = np.fromiter((k for k, _ in held), np.uint64, len(held)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x for _, x in held], pa.binary()), pa.array(held.values(), pa.int64())], ["key", "piece", "seen"])
            held.clear()
            return out

        for batch in batches:
            for _, _, text, begin, end, _, keys in cutter.slices(batch.column("text")):
                distinct, at, times = np.unique(keys, return_index=True, return_counts=True)
                raw = text.tobytes()
                for k, b, e, n in zip((distinct & cutter.mask).tolist(), begin[at].tolist(), end[at].tolist(), times.tolist(), strict=True):
                    pair = (k, raw[b:e])
                    held[pair] = held.get(pair, 0) + n
                if len(held) > HELD:
                    yield handed_on()
        yield handed_on()

    rows = arrow_map(docs.select("text"), run, "key long, piece binary, seen long")
    return rows.groupBy("key", "piece").agg(F.sum("seen").alias("seen"))


def piece_counts(distinct: DataFrame, path: str, key_bits: int = 64) -> DataFrame:
    """(key, seen, tokens): each distinct pre-token encoded once; tokens is -1 for a key that several of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path, key_bits)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                tokens = cutter.count(part.column("piece").cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("seen"), pa.array(tokens, pa.int64())], ["key", "seen", "tokens"])

    rows = arrow_map(distinct, run, "key long, seen long, tokens long")
    return rows.groupBy("key").agg(F.sum("seen").alias("seen"), F.when(F.count("*") > 1, F.lit(-1)).otherwise(F.max("tokens")).cast("long").alias("tokens"))


def _least_seen(counts: DataFrame, head: int) -> int:
    """The smallest power of two such that at most ``head`` pre-tokens occur so often."""
    bits = F.length(F.bin("seen"))
    left, least = head, 1
    for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).orderBy(F.desc("bits")).collect():  # 63 rows at most
        left -= r["n"]
        if left < 0:
            return 1 << r["bits"]
    return least


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD, key_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), exactly as the library counts them."""
    counts = materialize(piece_counts(distinct_pieces(docs, path, key_bits), path, key_bits), "piece-counts")
    least = _least_seen(counts, head)
    known = (F.col("seen") >= least) | (F.col("tokens") < 0)
    top = counts.filter(known).select("key", "tokens").toArrow().sort_by("key")  # at most ``head`` rows, and the shared keys: about none
    shared: Any = docs.sparkSession.sparkContext.broadcast((top.column("key").to_numpy(), top.column("tokens").to_numpy().astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, (keys, tokens) = PreTokens(path, key_bits), shared.value
        place = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            column = batch.column("text")
            sums, rest_row, rest_key = np.zeros(len(column), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, _, _, _, row, own in cutter.slices(column):
                own = (own & cutter.mask).view(np.int64)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                found = np.where(hit, tokens[at] if len(keys) else 0, 0)
                sums[lo:hi] += np.bincount(row, np.maximum(found, 0), hi - lo).astype(np.int64)
                rest_row.append(row[~hit] + lo)
                rest_key.append(own[~hit])
                for i in np.unique(row[found < 0]):
                    sums[lo + i] = cutter.count([column[int(lo + i)].as_py()])[0] - (1 << 62)
            whole = sums < 0
            sums[whole] += 1 << 62
            rest_row, rest_key = np.concatenate(rest_row), np.concatenate(rest_key)
            order = np.argsort(rest_row, kind="stable")
            order = order[~whole[rest_row[order]]]
            rest_row, rest_key = rest_row[order], rest_key[order]
            ids = np.arange(place + 1, place + 1 + len(column))
            place += len(column)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest_row, np.arange(len(column) + 1)).astype(np.int32)), pa.array(rest_key))
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums), lists], ["row", "doc_id", "n_bytes", "known", "rest"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = arrow_map(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), run, f"row long, doc_id {kind}, n_bytes long, known long, rest array<long>")
    rows = materialize(rows, "documents-counted")
    rest = rows.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    rest = rest.join(counts.filter(~known).select("key", "tokens"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0))
    return rows.drop("rest").join(rest, "row", "left").select("doc_id", "n_bytes", total.cast("long").alias("n_tokens"), (total > limit).alias("over_limit"))
