"""Operator 1: token ids in binary shards, compressed by Re-Pair grammars.

Documents are encoded, closed with an end id and written in ascending order of
doc_id.  A shard is one row of a Parquet table and holds a run of consecutive
documents: the grammar's rules, the length that each nonterminal expands to, the
sequence that is left, and for each document where its part of the sequence begins
and how many ids it has.  Pairs never cross a document's end, so that a document is
decoded without touching the rest of its shard.

Re-Pair replaces the most frequent pair, again and again.  Here a round counts the pairs
of a shard in numpy and replaces each pair wherever it is more frequent than the pairs
that overlap it there, which leads to the same kind of grammar in some twenty rounds.
Only places whose pair may still be frequent are looked at again.  Rounds end when no
replacement pays for its rule: no pair has ``least_uses`` places apart from each other.

Cases: null text is empty, an empty document is its end id alone; documents of equal
id follow each other in order of a hash of their text; null ids come first; an empty table
gives no shards; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, with_end_ids
from .common import arrow_map, bucket_column, order_key, range_bounds, scratch_path, ship_package, shuffle_width, text_or_empty

#: Ids in a shard before its last document.
SHARD_IDS = 1 << 20
#: Uses with which a rule pays: each saves a symbol, the rule costs two and the length of what it expands to.
LEAST_USES = 3
#: Hash slots in which pairs are counted while there are more places than an exact count is fast for.
_SLOT_BITS, _EXACT = 21, 1 << 16
_MIX_LEFT, _MIX_RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)

SHARD_SCHEMA = "part int, shard int, first long, n_ids long, first_rule long, doc_ids binary, null_ids binary, doc_ids_n binary, doc_begin binary, rules binary, rule_lengths binary, sequence binary, width int"


def _grouped(pairs: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, the number of each place's pair among them, and their counts; symbols are below ``symbols``."""
    n = len(pairs)
    wide, own = np.uint64(int(symbols).bit_length()), np.uint64(int(n).bit_length())
    if not n or int(2 * wide + own) > 64:
        return np.unique(pairs, return_inverse=True, return_counts=True)
    # pair and place in one number, so that a plain sort does
    packed = np.sort(((((pairs >> _HALF) << wide) | (pairs & _LOW)) << own) | np.arange(n, dtype=np.uint64))
    key, place = packed >> own, (packed & ((np.uint64(1) << own) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(np.append(head, n))
    number = np.empty(n, np.int64)
    number[place] = np.repeat(np.arange(len(head)), counts)
    key = key[head]
    return ((key >> wide) << _HALF) | (key & ((np.uint64(1) << wide) - np.uint64(1))), number, counts


def build_grammar(ids: np.ndarray, last: np.ndarray, first_rule: int, least_uses: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compresses ``ids``; ``last`` marks the ids that end a document.

    Returns the sequence, its ``last`` marks and the rules as rows (left, right); rule i is
    the symbol ``first_rule + i`` and refers to smaller symbols only.
    """
    sequence, last = ids.astype(np.uint32), last.copy()
    rules = [np.zeros((0, 2), np.uint32)]
    top = first_rule
    # places whose pair may be frequent; a pair is either here with all its places or not at all
    alive, exact = np.flatnonzero(~last[:-1]), False
    while len(alive):
        exact = exact or len(alive) < _EXACT
        left, right = sequence[alive], sequence[alive + 1]
        if exact:
            slot = _grouped((left.astype(np.uint64) << _HALF) | right, top)[1]
            slots = int(slot.max()) + 1
        else:
            mixed = (left * _MIX_LEFT) ^ (right * _MIX_RIGHT)
            slot = (((mixed ^ (mixed >> np.uint32(15))) * _MIX_LEFT) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)
            slots = 1 << _SLOT_BITS
        uses = np.bincount(slot, minlength=slots)
        # in a run of one symbol each second pair overlaps the one before it
        twin = np.flatnonzero(left == right)
        opens = np.append(True, np.diff(alive[twin]) != 1)[: len(twin)]
        odd = twin[(np.arange(len(twin)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]) % 2 == 1] if len(twin) else twin
        np.subtract.at(uses, slot[odd], 1)
        uses = uses[slot]
        # only these may be chosen, now or later
        live = np.flatnonzero(uses >= least_uses)
        counted = np.ones(len(alive), bool)
        counted[odd] = False
        alive, left, right = alive[live], left[live], right[live]
        rank = ((uses[live] << 32) | slot[live]) * counted[live]
        beside = alive[1:] == alive[:-1] + 1
        after, before = np.zeros_like(rank), np.zeros_like(rank)
        after[:-1], before[1:] = rank[1:] * beside, rank[:-1] * beside
        best = np.flatnonzero((rank > before) & (rank >= after) & (rank > 0))
        chosen, number, times = _grouped((left[best].astype(np.uint64) << _HALF) | right[best], top)
        good = times >= least_uses
        if not good.any():
            if exact:
                break
            exact = True  # slots that several pairs share were in the way
            continue
        taken = good[number]
        at = alive[best[taken]]
        sequence[at] = (np.cumsum(good) - 1 + top)[number[taken]].astype(np.uint32)
        last[at] = last[at + 1]
        stays, look = np.ones(len(sequence), bool), np.zeros(len(sequence), bool)
        stays[at + 1] = False
        look[alive] = look[at] = True
        prior = at[at > 0] - 1
        look[prior - ~stays[prior]] = True
        sequence, last, look = sequence[stays], last[stays], look[stays] & ~last[stays]
        look[-1:] = False
        alive = np.flatnonzero(look)
        chosen = chosen[good]
        rules.append(np.stack([chosen >> _HALF, chosen & _LOW], 1).astype(np.uint32))
        top += len(chosen)
    return sequence, last, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The number of ids that each rule expands to."""
    out = np.zeros(len(rules), np.int64)
    level = _levels(rules, first_rule)
    for k in range(1, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        parts = rules[own].astype(np.int64) - first_rule
        out[own] = np.where(parts >= 0, out[np.maximum(parts, 0)], 1).sum(1)
    return out


def _levels(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """1 for a rule of two ids, else one more than the deeper of its parts."""
    level = np.zeros(len(rules), np.int64)
    parts = rules.astype(np.int64) - first_rule
    while True:
        deep = np.where(parts >= 0, level[np.maximum(parts, 0)], 0).max(1, initial=0) + 1 if len(rules) else level
        if np.array_equal(deep, level):
            return level
        level = deep


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges [begin, begin + length)."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> None:
        # where each symbol's ids lie in the pool, and how many they are; ids stand for themselves
        self.length = np.append(np.ones(first_rule, np.int64), lengths)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.zeros(int(self.length.sum()), np.uint32)
        self.pool[:first_rule] = np.arange(first_rule, dtype=np.uint32)
        level = _levels(rules, first_rule)
        for k in range(1, int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level == k)
            a, b = rules[own, 0], rules[own, 1]
            to = self.begin[first_rule + own]
            self.pool[_spread(to, self.length[a])] = self.expand(a)
            self.pool[_spread(to + self.length[a], self.length[b])] = self.expand(b)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[_spread(self.begin[symbols], self.length[symbols])]


def pack_shard(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None], first_rule: int, **effort: int) -> dict:
    """One shard as a row without its place (part, shard, first)."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    sequence, last, rules = build_grammar(ids, last, first_rule, **effort)
    ends = np.flatnonzero(last) + 1
    width = 2 if first_rule + len(rules) <= 1 << 16 else 4
    symbol = np.dtype("<u2" if width == 2 else "<u4")
    return {
        "n_ids": len(ids), "first_rule": first_rule, "width": width,
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "null_ids": np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        "doc_ids_n": counts.astype("<u4").tobytes(), "doc_begin": np.append(0, ends[:-1]).astype("<u4").tobytes(),
        "rules": rules.astype(symbol).tobytes(), "rule_lengths": rule_lengths(rules, first_rule).astype("<u4").tobytes(), "sequence": sequence.astype(symbol).tobytes(),
    }


class Shard:
    """Reads one shard row."""

    def __init__(self, row: dict) -> None:
        symbol = "<u2" if row["width"] == 2 else "<u4"
        self.doc_ids = [None if gone else x for x, gone in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["null_ids"], strict=True)]
        self.counts = np.frombuffer(row["doc_ids_n"], "<u4").astype(np.int64)
        self.begin = np.frombuffer(row["doc_begin"], "<u4").astype(np.int64)
        self.sequence = np.frombuffer(row["sequence"], symbol)
        self.grammar = Grammar(np.frombuffer(row["rules"], symbol).reshape(-1, 2).astype(np.uint32), np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), row["first_rule"])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, expanded in one go, and where each document's ids end."""
        ids = self.grammar.expand(self.sequence).astype("<u4", copy=False)
        return ids, np.cumsum(self.grammar.length[self.sequence])[np.append(self.begin[1:], len(self.sequence)) - 1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document, from its own symbols alone."""
        end = self.begin[i + 1] if i + 1 < len(self.begin) else len(self.sequence)
        return self.grammar.expand(self.sequence[self.begin[i] : end])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS, parts: int | None = None, **effort: int) -> None:
    """Encodes ``documents`` and writes them as shards in ascending order of doc_id.

    The texts move once, to ``parts`` ranges of ids.  ``first`` counts a shard's ids from the
    start of its range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = parts or shuffle_width(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), order_key().alias("k"))
    bounds = range_bounds(base.select("k"), "k", parts)
    base = base.withColumn("h", F.xxhash64("text"))
    dealt = base.withColumn("part", bucket_column(bounds, F.col("k"), F.col("h"))).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("k", "h", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SHARD_SCHEMA.split(", ")])
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, first, held
            row = pack_shard(np.concatenate(ids), np.concatenate(counts), names, encode.size, **effort) | {"part": part, "shard": shard, "first": first}
            shard, first, held = shard + 1, first + row["n_ids"], 0
            ids.clear(), counts.clear(), names.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            step = max(1, 2 * shard_ids // max(1, batch.nbytes // max(1, batch.num_rows)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                new, n = with_end_ids(*encode.encode(piece.column("text")), end_id)
                who, at, cut = piece.column("doc_id").to_pylist(), 0, 0
                ends = np.cumsum(n)
                while at < len(n):
                    stop = int(np.searchsorted(ends, cut + max(1, shard_ids - held))) + 1
                    stop = min(max(stop, at + 1), len(n))
                    ids.append(new[cut : ends[stop - 1]]), counts.append(n[at:stop]), names.extend(who[at:stop])
                    held += int(ends[stop - 1]) - cut
                    at, cut = stop, int(ends[stop - 1])
                    if held >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    arrow_map(dealt.select("doc_id", "text"), pack, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship_package(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                shard = Shard(row)
                ids, ends = shard.documents()
                crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                if not np.array_equal(np.diff(ends, prepend=0), shard.counts):
                    raise ValueError("a document does not expand to its stored length")
                starts = np.cumsum(shard.counts) - shard.counts
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(crc), pa.int32()), "doc_id": pa.array(shard.doc_ids, pa.int64()), "inner": pa.array(starts + row["first"], pa.int64()), "n_tokens": pa.array(shard.counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = arrow_map(shards, decode, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # one row for each range of ids, so this window and this broadcast are as small as the number of partitions
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the shards to a scratch folder and returns what :func:`read_shards` finds there."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(docs.sparkSession, path)
