"""Substring search that leaves out files: for each file a Bloom filter of the byte triples of its texts.

A text that holds the needle holds all its triples, so a file whose filter lacks one of them is not
read.  Filters are kept as rows (file, word, bits) of 64 bits each, sorted by word: a needle of n
bytes asks for twice n words at most, whatever the number and size of the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.batches import pieces

#: Bits of a file's filter, and bits set for each triple.
BITS, HASHES = 1 << 20, 2
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _places(triples: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each triple: the upper half of its products with odd numbers."""
    wide = triples.astype(np.uint64)
    return np.concatenate([((wide * np.uint64(odd)) >> np.uint64(32)) % np.uint64(bits) for odd in _ODD[:HASHES]])


def _triples(data: bytes, cuts: np.ndarray) -> np.ndarray:
    """The distinct triples of bytes that lie within one text; ``cuts`` are the texts' ends in ``data``."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    whole = np.ones(len(x) - 2, bool)
    for back in (1, 2):  # a triple that begins one or two bytes before an end runs over it
        at = cuts - back
        whole[at[(at >= 0) & (at < len(whole))]] = False
    return np.unique((x[:-2] << 16 | x[1:-1] << 8 | x[2:])[whole])


def build(docs: DataFrame, columns: tuple[str, ...] = ("text", "source"), bits: int = BITS) -> DataFrame:
    """(file, word, bits) of a table that is read from files: the filters over the lower-cased columns, without empty words.

    Files without any triple have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = np.zeros(bits, bool), None

        def handed_on() -> Iterator[pa.RecordBatch]:
            words = np.packbits(held, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            if file is not None and len(at):
                yield pa.RecordBatch.from_arrays([pa.repeat(file, len(at)), pa.array(at), pa.array(words[at])], ["file", "word", "bits"])
            held[:] = False

        for batch in pieces(batches, columns):
            names = batch.column("file").to_pylist()
            ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for lo, hi in zip([0, *ends], [*ends, len(names)], strict=True):
                if lo == hi:
                    continue
                if names[lo] != file:
                    yield from handed_on()
                    file = names[lo]
                texts = [x.encode() for c in columns for x in batch.column(c).slice(lo, hi - lo).to_pylist() if x]
                held[_places(_triples(b"".join(texts), np.cumsum([len(x) for x in texts], dtype=np.int64)), bits).astype(np.int64)] = True
        yield from handed_on()

    rows = docs.select(F.input_file_name().alias("file"), *[F.lower(F.col(c)).alias(c) for c in columns])
    return rows.mapInArrow(run, "file string, word long, bits long").groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))


def write_index(docs: DataFrame, path: str, columns: tuple[str, ...] = ("text", "source"), bits: int = BITS) -> None:
    build(docs, columns, bits).withColumn("size", F.lit(bits)).repartitionByRange("word").sortWithinPartitions("word", "file").write.mode("overwrite").parquet(path)


def candidate_files(spark: SparkSession, index: str, needle: str, bits: int = BITS) -> DataFrame | None:
    """(file) of the files that may hold the needle in any letter case; None where it is too short to tell."""
    data = needle.lower().encode()
    triples = _triples(data, np.array([len(data)]))
    if not len(triples):
        return None
    masks: dict[int, int] = {}
    for place in _places(triples, bits).tolist():
        masks[place >> 6] = masks.get(place >> 6, 0) | 1 << (place & 63)
    asked = spark.createDataFrame([(w, m - (1 << 64) if m >> 63 else m) for w, m in masks.items()], "word long, mask long")
    rows = spark.read.parquet(index).filter(F.col("word").isin(list(masks)))
    rows = rows.join(F.broadcast(asked), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return rows.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(masks)).select("file")


def pruned(spark: SparkSession, docs: DataFrame, index: str, needle: str, bits: int = BITS) -> DataFrame:
    """``docs``, a table of Parquet files, without the files that cannot hold the needle."""
    found = candidate_files(spark, index, needle, bits)
    if found is None:
        return docs
    files = [r["file"] for r in found.collect()]  # names of files, as Spark lists them itself
    return spark.read.schema(docs.schema).parquet(*files) if files else docs.limit(0)
