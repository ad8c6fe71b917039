"""Versioned tables: immutable data files, numbered manifests, and a commit by exclusive create.

A table is a folder with ``data/`` and ``_log/``.  A write puts its files below ``data/`` where nobody
looks yet; it becomes version n by creating ``_log/n.json``, which only one writer can do.  A writer
that comes second finds what the first one committed and tries again with the next number, or gives
up if its own work rests on the version it had read.  Readers take the highest version and read just
the files of its manifest, so that they see one version whole, whatever is being written meanwhile.

A snapshot is a name for a version; going back to it is a new version with the old manifest.  Nothing
is copied, and the driver handles names of files only.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import _fs

#: Digits of a version's number in its file's name.
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer committed the version that this one wanted."""


def _read(spark: SparkSession, path: str) -> dict[str, Any]:
    fs, at = _fs(spark, path)
    stream = fs.open(at(path))
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    """Makes ``path`` appear whole, or raises :class:`Conflict` if it is there: a hard link on local file systems, else a rename that never overwrites."""
    fs, at = _fs(spark, path)
    folder, name = path.rsplit("/", 1)
    ready = f"{folder}/_{uuid.uuid4().hex}-{name}"
    out = fs.create(at(ready), False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":
            local = lambda x: jvm.java.io.File(at(x).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(path), local(ready))
        else:
            plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at(ready), at(path), plain)
    except Exception as error:
        if fs.exists(at(path)):
            raise Conflict(path) from error
        raise
    finally:
        fs.delete(at(ready), False)


def versions(spark: SparkSession, table: str) -> list[int]:
    """The committed versions, ascending."""
    fs, at = _fs(spark, table)
    if not fs.exists(at(f"{table}/_log")):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(at(f"{table}/_log")))
    return sorted(int(x[:-5]) for x in names if len(x) == DIGITS + 5 and x.endswith(".json"))


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict[str, Any]:
    """What a version (the latest one) consists of: version, parent, kind, schema, folders."""
    known = versions(spark, table)
    if version is None and not known:
        raise FileNotFoundError(table)
    return _read(spark, f"{table}/_log/{known[-1] if version is None else version:0{DIGITS}d}.json")


def _commit(spark: SparkSession, table: str, parent: int, kind: str, schema: str, folders: list[str], applied: dict[str, int]) -> int:
    number = parent + 1
    _create(spark, f"{table}/_log/{number:0{DIGITS}d}.json", {"version": number, "parent": parent, "kind": kind, "schema": schema, "folders": folders, "applied": applied})
    return number


def _applied(spark: SparkSession, table: str, batch: tuple[str, int]) -> int:
    """The table's version if it has this batch of the job, or a later one, else 0."""
    if not versions(spark, table):
        return 0
    last = manifest(spark, table)
    return last["version"] if last["applied"].get(batch[0], -1) >= batch[1] else 0


def commit(rows: DataFrame, table: str, kind: str = "replace", expected: int | None = None, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
    """Writes ``rows`` as the table's next version, whose number is returned.

    ``replace`` holds just the rows, ``append`` those of the version before as well.  With
    ``expected``, the version that the rows were made from, any other commit since is a
    :class:`Conflict`; without, the commit is tried again on top of it, and the rows are not written twice.
    ``batch``, a job's name and its running number, makes the commit idempotent: one that the table
    has already applied changes nothing.
    """
    spark = rows.sparkSession
    if kind not in ("replace", "append"):
        raise ValueError(f"unknown kind {kind}")
    if batch is not None and (number := _applied(spark, table, batch)):
        return number
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{folder}")
    for _ in range(tries):
        known = versions(spark, table)
        parent = known[-1] if known else 0
        if expected is not None and parent != expected:
            raise Conflict(f"{table} is at version {parent}, not {expected}")
        before = manifest(spark, table, parent) if parent else {"folders": [], "schema": rows.schema.json(), "applied": {}}
        if batch is not None and (number := _applied(spark, table, batch)):
            return number
        if kind == "append" and before["schema"] != rows.schema.json():
            raise ValueError(f"{table}: another schema")
        try:
            return _commit(spark, table, parent, kind, rows.schema.json(), [*(before["folders"] if kind == "append" else []), folder], before["applied"] | (dict([batch]) if batch else {}))
        except Conflict:
            if expected is not None:
                raise
    raise Conflict(f"{table}: {tries} tries")


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the latest one."""
    known = manifest(spark, table, version)
    return spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(*[f"{table}/{x}" for x in known["folders"]])


def history(spark: SparkSession, table: str) -> DataFrame:
    """(version, parent, kind, folders) of every version, from the log as Spark reads it."""
    rows = spark.read.schema("version long, parent long, kind string, folders array<string>").json(f"{table}/_log/" + "?" * DIGITS + ".json")
    return rows.select("version", "parent", "kind", F.size("folders").cast("long").alias("folders"))


def snapshot(spark: SparkSession, table: str, name: str, version: int | None = None) -> int:
    """Names a version (the latest one); a name is given once."""
    number = manifest(spark, table, version)["version"]
    _create(spark, f"{table}/_log/snapshots/{name}.json", {"version": number})
    return number


def snapshot_version(spark: SparkSession, table: str, name: str) -> int:
    return _read(spark, f"{table}/_log/snapshots/{name}.json")["version"]


def rollback(spark: SparkSession, table: str, to: int | str, tries: int = 20) -> int:
    """Makes a version or a snapshot the latest one again, as a new version; what was in between stays readable."""
    old = manifest(spark, table, snapshot_version(spark, table, to) if isinstance(to, str) else to)
    for _ in range(tries):
        try:
            last = manifest(spark, table)
            return _commit(spark, table, last["version"], "rollback", old["schema"], old["folders"], last["applied"])
        except Conflict:
            continue
    raise Conflict(f"{table}: {tries} tries")
