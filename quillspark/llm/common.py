"""Pieces that several operators of this subpackage share.

Scratch tables replace cached data: they are ordinary Parquet directories below
the shared folder named by ``spark.checkpoint.dir``, so that they cut lineage and
outlive any executor.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table of keys (a few dozen bytes each) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch, where the session has left that at its default.
BATCH_ROWS = 1000
#: Sorts before every document id; stands for a null id.
NULL_ID = -(2**63)
#: What separates words: the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_roots: dict[str, str] = {}
#: Scratch paths given out, in order.
_given: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a temporary one where none is set and everything runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    _given.append(f"{scratch_root(spark)}/quillspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    return _given[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a scratch table and returns a scan of it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Deletes the files of a table of :func:`materialize` that nothing will read any more."""
    spark = table.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """A list that has, at the end, the scratch paths that were given out meanwhile."""
    begin, out = len(_given), []
    yield out
    out.extend(_given[begin:])


def drop_paths(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Deletes scratch folders, but for those that ``reader`` still reads."""
    read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in reader.inputFiles()}
    for folder in paths:
        if folder.split(":", 1)[-1].lstrip("/") not in read:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the cluster delete the shuffle files of finished jobs now: it does so when the driver collects their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/quillspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that would not find it otherwise, and Arrow batches small."""
    top = str(Path(__file__).resolve().parents[2])
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # texts are long: by default a batch may be hundreds of MB
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = os.environ.get("PYTHONPATH", "").split(":") + str(context.environment.get("PYTHONPATH", "")).split(":")
    if top in known or getattr(context, "_quillspark_shipped", False):
        return
    if context.master == "local" or context.master.startswith("local["):
        context.environment["PYTHONPATH"] = ":".join(filter(None, [top, context.environment.get("PYTHONPATH", "")]))
    else:
        with tempfile.TemporaryDirectory() as folder:
            with zipfile.ZipFile(archive := f"{folder}/quillspark_package.zip", "w") as out:
                for source in Path(top, "quillspark").rglob("*.py"):
                    out.write(source, source.relative_to(top))
            context.addPyFile(archive)
    context._quillspark_shipped = True


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give memory back to the system after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def order_key(column: str = "doc_id") -> Column:
    """The id as a number to sort by; null ids come before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def is_training(column: str = "doc_id") -> Column:
    """Whether a document's label may be learned: crc32 of its id as text, modulo 3, is not 1 (null ids: never)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 != 1, F.lit(False))


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the rows whose ``key`` is in the one-column table ``ids``.

    ``ids`` must be cheap to count.  Up to ``limit`` ids are broadcast, so that ``df`` does not
    move; more than that are joined by a shuffle that hashes the ids and does not sort ``df``.
    """
    small = ids.count() <= limit
    name = free_name(df.columns, "_restrict_id")
    right = ids.select(F.col(ids.columns[0]).alias(name))
    right = F.broadcast(right) if small else right.hint("shuffle_hash")
    return df.join(right, F.col(key).eqNullSafe(F.col(name)) if how == "left_anti" else F.col(key) == F.col(name), how)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with so many underscores that no taken column has it (names differ by more than case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return their documents' columns: names that start with an underscore, as working columns do, are set aside meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
        if not any(c.startswith("_") for c in docs.columns):
            return operator(docs, *args, **kwargs)
        safe: list[str] = []
        for c in docs.columns:
            safe.append(free_name([*docs.columns, *safe], f"kept{c}") if c.startswith("_") else c)
        return operator(docs.toDF(*safe), *args, **kwargs).toDF(*docs.columns)

    return run


def fits(table: DataFrame, *texts: str, most: int = 64 << 20) -> bool:
    """Whether a scratch table may be broadcast: its rows at 64 bytes each and its text columns come to at most ``most`` bytes."""
    size = F.count("*") * 64 + sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts), F.lit(0))
    return table.agg(size).first()[0] <= most


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table that has one row per key: broadcast up to ``limit`` rows, else a sort-merge join that AQE can split."""
    return df.join(F.broadcast(table) if table.count() <= limit else table, on, how)


def row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a long that names a doc_id together with its text; null without an id.

    It is the id itself where one row bears that, else a hash of id and text, so that different
    texts of one id stay apart.  Hashes that meet each other or an id are drawn again.
    """
    own = F.col("doc_id").cast("long")
    ids = docs.select(own.alias("_twice"))
    total, distinct = ids.agg(F.count("_twice"), F.countDistinct("_twice")).first()
    if total == distinct:
        return docs.withColumn("_row", own)
    twice = materialize(ids.filter("_twice is not null").groupBy("_twice").agg(F.count("*").alias("n")).filter("n > 1").select("_twice"), "twice")
    marked = docs.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, own == F.col("_twice"), "left")
    text = F.md5(text_or_empty().cast("binary"))
    pairs = materialize(marked.filter("_twice is not null").select("_twice", text.alias("text")).distinct(), "texts")
    for seed in itertools.count():
        named = pairs.select(F.xxhash64(F.lit(seed), "_twice", "text").alias("_row"))
        n, apart = named.agg(F.count("*"), F.countDistinct("_row")).first()
        if n == apart and ids.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, F.col("_twice") == F.col("_row"), "left_semi").isEmpty():
            break
    return marked.withColumn("_row", F.when(F.col("_twice").isNotNull(), F.xxhash64(F.lit(seed), "_twice", text)).otherwise(own)).drop("_twice")


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """``parts - 1`` ascending cut points that deal the keys out evenly; a key that fills several parts is there as often."""
    if parts < 2:
        return []
    return [int(x) for x in df.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts))]


def bucket_column(bounds: list[int], key: Column, tie: Column) -> Column:
    """The part of a row, 0 up to len(bounds), ascending in (key, tie): keys that are cut points are dealt out by the long ``tie``."""
    cuts = np.array(bounds, np.int64)

    def place(values: pd.Series, ties: pd.Series) -> pd.Series:
        own = values.to_numpy(np.int64)
        low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
        share = ties.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5
        return pd.Series(np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32))

    return F.pandas_udf(place, T.IntegerType())(key, tie)


def connected_components(edges: DataFrame) -> DataFrame:
    """Labels each id of the edge table ``(a long, b long)`` with the smallest id it can reach: ``(id, component)``.

    Alternates the large-star and small-star steps until the edges are stars around their
    smallest member, however many rounds that takes.  No neighbour list is ever gathered: a step is one aggregate (combined
    before its shuffle) and one join against a table with one row per id.
    """

    def arranged(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    stars = materialize(arranged(edges), "edges")
    seen: tuple | None = None
    while True:
        both = stars.union(stars.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = arranged(lookup_join(both, least, ["a"], "inner").filter("b > a").select(F.col("m").alias("a"), "b"))
        large = materialize(large, "large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = lookup_join(down, least, ["u"], "inner")
        stars = materialize(arranged(joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))), "edges")
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        hubs_are_roots = stars.select("a").distinct().join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        if hubs_are_roots and stars.groupBy("b").count().filter("count > 1").isEmpty() or state == seen:
            break
        seen = state
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component")).union(stars.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def by_runs(df: DataFrame, keys: list[str], order: list, work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Applies ``work`` to the rows of each value of the long columns ``keys``, sorted by ``order``.

    Like a grouped map, but groups are read off sorted partitions, which costs next to nothing
    for very many small groups.  Groups must be bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = work(table)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            differs = np.zeros(table.num_rows - 1, bool)
            for key in keys:
                column = table.column(key).to_numpy()
                differs |= column[1:] != column[:-1]
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield from finished(table.slice(lo, hi - lo))
            held = table.slice(cuts[-1])
        if held is not None:
            yield from finished(held)

    return arrow_map(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)
