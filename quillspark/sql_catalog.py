"""Queries written in Spark SQL over the registered functions; they answer as the DataFrame queries of the same twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .plans.derived import Derived

Query = Callable[[SparkSession, str], DataFrame]


def _query(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql.register(spark)
        return Derived("q", text).df(spark, sf_dir)

    return run


#: Name, SQL, and the query whose twin it shares.
WRITTEN = (("sql_document_stats", sql.DOCUMENT_STATS, "document_stats"), ("sql_containment", sql.CONTAINMENT, "overlap_containment"), ("sql_chunk_texts", sql.CHUNK_TEXTS, "chunk_texts"))


def queries(known: dict[str, tuple[Query, str | None]]) -> dict[str, tuple[Query, str | None]]:
    return {name: (_query(text), known[like][1]) for name, text, like in WRITTEN}
