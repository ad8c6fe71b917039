"""Small literal tables that exist once and serve both Spark and SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Literal:
    name: str
    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def cte(self) -> str:
        columns = ", ".join(x.split()[0] for x in self.schema.split(", "))
        return f"{self.name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows) + ")"
