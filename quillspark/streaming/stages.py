"""A stage that reads only what is new: files that no run has seen, and of these only contents that no run has worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import versions
from ..sinks.store import stage_key


def incremental_stage(
    spark: SparkSession, folder: str, table: str, name: str, work: Callable[[DataFrame], DataFrame], code: tuple[str, ...] = (), form: str = "parquet", schema: str | None = None, content: str = "text", most_files: int = 1000
) -> int:
    """Brings ``table`` (of :mod:`..sinks.versions`) up to date with the files in ``folder``; its version is returned.

    The stream's checkpoint, below the table, remembers the files; each batch of up to ``most_files`` is
    one version, which a repeated batch does not write again.  Rows are addressed by the content column,
    the stage's name and its ``code`` versions: an address that the table has is not worked on again.
    ``work`` maps rows to rows and keeps the column ``address``; equal contents of a batch are one row.
    """
    kind = schema or spark.read.format(form).load(folder).schema
    rows = spark.readStream.format(form).schema(kind).option("maxFilesPerTrigger", most_files).load(folder)
    rows = rows.withColumn("address", stage_key(name, code, F.col(content)))

    def batch(fresh: DataFrame, number: int) -> None:
        fresh = fresh.dropDuplicates(["address"])
        if versions.versions(spark, table):
            fresh = fresh.join(versions.read(spark, table).select("address"), "address", "left_anti")
        versions.commit(work(fresh), table, "append", batch=(name, number))

    stream = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{table}/_stream-{name}").trigger(availableNow=True).start()
    stream.awaitTermination()
    known = versions.versions(spark, table)
    return known[-1] if known else 0
