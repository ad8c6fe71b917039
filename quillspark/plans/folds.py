"""Folds over the rows of a key in order, as a stream: a task reads its keys one after the other and keeps no more of them than the fold's state."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of a batch that a fold hands on.
ROWS = 1000


def in_order(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows of a key in one partition, of ``parts`` if given, sorted; windows over the same key and order move nothing more."""
    return (rows.repartition(key) if parts is None else rows.repartition(parts, key)).sortWithinPartitions(key, *order)


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType, parts: int | None = None) -> DataFrame:
    """What ``fold`` yields for the rows of each key; it gets them as tuples, one by one, in the order of the columns.

    Few bytes that take long to fold are given ``parts``, as Spark would put them into one partition.
    """
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        stream = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        out = itertools.chain.from_iterable(fold(own) for _, own in itertools.groupby(stream, itemgetter(at)))
        while part := list(itertools.islice(out, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return in_order(rows, key, order, parts).mapInArrow(run, schema)


def packed(rows: DataFrame, key: str, size: Column, cut: Column, most: int, glue: int) -> DataFrame:
    """``rows`` (of :func:`in_order`) with ``pack``, from 0: as many rows in a row as stay within ``most``, with ``glue`` between two.

    A row that ``cut`` holds for opens a pack; a larger one has a pack of its own.
    """
    schema = StructType([*rows.schema.fields, StructField("pack", LongType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, pack, held = None, False, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            opens = np.append(not begun or batch.column(key)[0].as_py() != last, codes[1:] != codes[:-1])
            numbers = []
            for new, own, apart in zip(opens.tolist(), batch.column("_size").to_pylist(), batch.column("_cut").to_pylist(), strict=True):
                if new:
                    pack, held = 0, own
                elif apart or held + glue + own > most:
                    pack, held = pack + 1, own
                else:
                    held += glue + own
                numbers.append(pack)
            last, begun = batch.column(key)[n - 1].as_py(), True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(numbers, pa.int64())], [*names, "pack"])

    marked = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("_cut", F.coalesce(cut, F.lit(False)))
    return marked.mapInArrow(run, schema)
