"""Operator 8: packing documents into sequences along a space-filling curve.

A document's vector is the average, over its token ids, of fixed pseudo-random directions
(a hashed bag of ids projected to a few dimensions).  Coordinates are turned into ranks among
all documents, the grid cell's place on the Hilbert curve is the document's key, and documents
are range-sorted by key.  Each range is one stream of ids, cut every ``length`` ids, so
that neighbours along the curve share sequences; what is left at the end of a range is
cut into sequences whose lengths are powers of two, which need no padding.

Documents are encoded once, into a scratch table of ids and coordinates; the ranks and the
cuts of the ranges are quantiles over all of it, and the ids travel once, to their range.
Ranges are cut by key and hash of doc_id, so that copies of one text, which have one key,
can fill any number of ranges.

Cases: null text is empty; an empty document is its end id alone; repeated rows are packed
one by one; null ids sort first within equal keys; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, with_end_ids
from .common import arrow_map, materialize, ship_package, shuffle_width, text_or_empty
from .shingles import stream64

#: Dimensions and bits of each on the curve.
DIMS, BITS = 3, 7
LENGTH = 4096
#: Bytes of ids, and pieces, that are held before they are handed on.
FLUSH_BYTES, FLUSH_ROWS = 2 << 20, 2000


def directions(vocabulary: int) -> np.ndarray:
    """A fixed direction for each token id: DIMS numbers from -1 to 1."""
    raw = stream64(vocabulary * DIMS, 81) >> np.uint64(11)
    return (raw.astype(np.float64) / 2**52 - 1).reshape(vocabulary, DIMS).astype(np.float32)


def coordinates(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean direction of each document; every document has an id."""
    begin = np.cumsum(counts) - counts
    sums = np.stack([np.add.reduceat(table[:, d][ids].astype(np.float64), begin) for d in range(table.shape[1])], 1) if len(counts) else np.zeros((0, table.shape[1]))
    return sums / counts[:, None]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of coordinates below ``2**bits``), by Gray-code transposition."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _steps(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes."""
    step = max(1, most * batch.num_rows // max(1, batch.nbytes)) if batch.num_rows else 1
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def power_pieces(rest: int) -> list[int]:
    """A length as a sum of falling powers of two."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def curve_keys(ladders: np.ndarray) -> Callable[..., Column]:
    """Sort keys from coordinates: the Hilbert key of the grid cell in the high bits, 32 bits of a hash of the id below."""

    def place(*coords: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(np.stack([np.searchsorted(ladders[d], c.to_numpy()) for d, c in enumerate(coords)], 1)))

    on_curve = F.pandas_udf(place, "long")
    return lambda doc_id, *coords: F.shiftleft(on_curve(*coords), 32).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(0xFFFFFFFF)))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, parts: int | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_ids (of the sequence), ids (null if not asked for)."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = parts or shuffle_width(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    names = [f"c{d}" for d in range(DIMS)]

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        table = directions(encode.size)
        width = np.dtype("<u2" if encode.size <= 1 << 16 else "<u4")
        for batch in batches:
            for part in _steps(batch):
                own, counts = with_end_ids(*encode.encode(part.column("text")), end_id)
                at = coordinates(own, counts, table)
                ends = np.append(0, np.cumsum(counts)) * width.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(own.astype(width).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(counts), width.itemsize), pa.int32()), blobs, *[pa.array(at[:, d]) for d in range(DIMS)]], ["doc_id", "wide", "ids", *names])

    encoded = materialize(arrow_map(base, encode_rows, "doc_id long, wide int, ids binary, " + ", ".join(f"{n} double" for n in names)), "encoded")
    cells = 1 << BITS
    steps = encoded.approxQuantile(names, [i / cells for i in range(1, cells)], 1 / (4 * cells))
    ladders = np.array([x or [0.0] * (cells - 1) for x in steps])
    key = curve_keys(ladders)(F.col("doc_id"), *map(F.col, names)).alias("key")
    cuts = sorted(set(map(int, materialize(encoded.select(key), "keys").approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts))))) if parts > 1 else []
    keyed = encoded.select("doc_id", "wide", "ids", key)
    # the number of cuts below the key, by binary search: steps of falling powers of two
    steps_ = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    below = lambda at, step: F.when(F.get(F.lit(cuts).cast("array<bigint>"), at + step - 1) < F.col("key"), at + step).otherwise(at)
    part = F.aggregate(steps_, F.lit(0), below) if cuts else F.lit(0)
    dealt = keyed.repartitionById(parts, part).sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), "ids").select("doc_id", "wide", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_ids", "ids")])
        sequence, fill, waiting = 0, 0, 0
        open_: list[tuple] = []
        done: list[tuple] = []

        def close(n_ids: int) -> None:
            nonlocal sequence, fill
            for doc_id, start, own, total, offset in open_:
                raw = own.astype("<u4").tobytes()
                done.append((doc_id, start, len(own), zlib.crc32(raw), total, first + sequence, offset, n_ids, raw if with_ids else None))
            sequence, fill = sequence + 1, 0
            open_.clear()

        def place(doc_id: int | None, start: int, own: np.ndarray, total: int) -> None:
            nonlocal fill
            open_.append((doc_id, start, own, total, fill))
            fill += len(own)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for doc_id, wide, raw in zip(batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(raw.as_py(), "<u2" if wide == 2 else "<u4")  # a copy, so that no batch is held
                at = 0
                while at < len(own):
                    take = min(length - fill, len(own) - at)
                    place(doc_id, at, own[at : at + take], len(own))
                    at += take
                    if fill == length:
                        close(length)
                        waiting += 4 * length
                        if len(done) >= FLUSH_ROWS or with_ids and waiting >= FLUSH_BYTES:
                            yield flush()
                            waiting = 0
        if fill:
            # the rest, as sequences of falling powers of two
            queue, rest = [x[:4] for x in reversed(open_)], fill
            open_.clear()
            fill = 0
            for need in power_pieces(rest):
                size = need
                while need:
                    doc_id, start, own, total = queue.pop()
                    take = min(need, len(own))
                    place(doc_id, start, own[:take], total)
                    need -= take
                    if take < len(own):
                        queue.append((doc_id, start + take, own[take:], total))
                close(size)
        if done:
            yield flush()

    return arrow_map(dealt, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_ids long, ids binary")
