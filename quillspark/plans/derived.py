"""Tables made from the given ones by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Derived:
    """``sql`` names given tables in braces, as in ``SELECT doc_id FROM {documents}``."""

    name: str
    sql: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.sql.format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))

    @property
    def cte(self) -> str:
        return f"{self.name} AS ({self.sql.format_map({t: t for t in TABLES})})"
