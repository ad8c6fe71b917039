"""Sinks: verified writes, content-addressed stages; versions and snapshots are in :mod:`.versions`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule that is null for a row counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def write_verified(rows: DataFrame, rules: dict[str, Column], key: str, path: str, form: str = "json") -> None:
    """Writes ``rows`` (json or parquet) if they break no rule; else raises, and nothing is at ``path`` that was not there.

    The rows are made once: they are written beside ``path``, checked as they lie there, and moved.
    """
    spark, staged = rows.sparkSession, f"{path}.staged-{uuid.uuid4().hex[:8]}"
    fs, at = _fs(spark, path)
    rows.write.format(form).save(staged)
    bad = violations(spark.read.schema(rows.schema).format(form).load(staged), rules, key).limit(3).collect()
    if bad:
        fs.delete(at(staged), True)
        raise ValueError(f"refused to write {path}: " + ", ".join(f"{r[key]}: {r['rule']}" for r in bad))
    fs.delete(at(path), True)
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"cannot move {staged}")


def write_markdown(pages: DataFrame, path: str) -> None:
    """Writes (path, text) rows as files of text, one folder for each path; a text is written in one piece, so that its lines keep their order."""
    pages.select("path", F.col("text").alias("value")).repartition("path").write.mode("overwrite").partitionBy("path").text(path)


def stage_key(stage: str, versions: tuple[str, ...], *inputs: Column) -> Column:
    """A stage's content address: the SHA-256 of its name, its versions and hashes of its inputs, one a line."""
    return F.sha2(F.concat_ws("\n", F.lit(stage), *[F.lit(v) for v in versions], *[F.sha2(F.coalesce(x.cast("string"), F.lit("")), 256) for x in inputs]), 256)


def cached_stage(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage with this content address: read where it is there whole, else made and written."""
    path = f"{folder}/{key}"
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
