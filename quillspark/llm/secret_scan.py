"""Operator 5: secret scans with an incremental blob ledger.

Every version of a text is a blob, named by its SHA-256.  A ledger (a folder of Parquet
tables) records which document held which blob at each scan, which blobs were scanned under
which version of the rules, and what was found.  A scan reads only blobs whose pair with the
current rules is new, once each however many documents hold them, adds them to the ledger,
and joins the findings back to all documents; ``history`` joins them to the documents of
every earlier scan.  All of it is DataFrame functions.

The base rules are fixed by contract; the method adds private key blocks, bearer
credentials and JSON web tokens, as kinds of their own.

Cases: null text is the empty blob; an empty or very long text is a blob like any other;
repeated rows share their blob and are returned one by one; an empty table gives no rows
and an empty addition to the ledger; rows without an id are scanned and returned like any
other; other columns, whatever their names, are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import itertools

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fits, keeps_names, materialize, restrict, scratch_path, text_or_empty
from .spans import Kind, joined, kind_spans

#: The base rules, then the rules that the method adds.
BASE = [
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", lambda m: F.length(m["part"]) >= 8, 2),
    # what these two match in full is what their looser forms match and the length rule leaves
    Kind("access", r"AKIA[A-Z0-9]{12,}+", r"AKIA[A-Z0-9]{12}"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", r"[0-9a-f]{32}"),
]
ADDED = [
    Kind("key_block", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Kind("bearer", r"(?i)\bauthorization\x20*:\x20*bearer\x20+[A-Za-z0-9._~+/=-]{16,}+", r"(?i)\bauthorization\x20*:\x20*bearer\x20"),
    Kind("jwt", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + ADDED
RULE_VERSION = hashlib.sha256("\n".join(f"{k.name} {k.pattern}" for k in RULES).encode()).hexdigest()[:16]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_HINT = "|".join(f"(?:{k.hint})" for k in RULES)

_PATHS = "doc_id long, blob string, scan int"
_SCANNED = "blob string, rules string"
_FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base string, spans string, places array<struct<start:int,rank:int,end:int>>"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def scan(blobs: DataFrame) -> DataFrame:
    """Findings of a table (blob, text) of different texts: one row for each blob with a suspicious text."""
    out = blobs.filter(F.col("text").rlike(_HINT))
    names = [f"_found_{i}" for i in range(len(RULES))]
    for i, (kind, name) in enumerate(zip(RULES, names, strict=True)):
        out = kind_spans(out, "text", kind, i, name)
    base, all_ = F.concat(*names[: len(BASE)]), F.concat(*names)
    labels = [k.name for k in RULES]
    out = out.select("blob", *names)
    return out.select("blob", *[F.size(n).cast("long").alias(f"n_{k.name}") for k, n in zip(BASE, names, strict=False)], joined(base, labels).alias("base"), joined(all_, labels).alias("spans"), F.array_sort(all_).alias("places"))


def _claimed(spark: SparkSession, ledger: str, after: int) -> int:
    """The next number of a scan, which no other scan gets: a file of that name is created where none is."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(ledger).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number in itertools.count(after + 1):
        claim = make(f"{ledger}/claims/{number}")
        try:
            fs.create(claim, False).close()
            return number
        except Py4JJavaError:
            if not fs.exists(claim):
                raise


def update_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """Scans the blobs of ``docs`` that the ledger has not seen under these rules; returns (doc_id, blob) of all rows."""
    spark = docs.sparkSession
    text = text_or_empty()
    version = _claimed(spark, ledger, _read(spark, f"{ledger}/paths", _PATHS).agg(F.max("scan")).first()[0] or 0)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob")).write.parquet(f"{ledger}/paths/scan={version}")
    paths = spark.read.schema("doc_id long, blob string").parquet(f"{ledger}/paths/scan={version}")
    seen = _read(spark, f"{ledger}/scanned", _SCANNED).filter(F.col("rules") == RULE_VERSION).select("blob")
    first = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen.distinct(), "blob", "left_anti")
    unseen = materialize(first, "unseen")
    # the texts stay where they are read: of each new blob the document of smallest id is scanned
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    if unseen.filter("doc_id is null").isEmpty():
        blobs = restrict(base, unseen.select("doc_id"), "doc_id").filter(F.col("text").rlike(_HINT)).select(F.sha2("text", 256).alias("blob"), "text")
        blobs = restrict(blobs, unseen.select("blob"), "blob", "left_semi") if _ids_repeat(paths) else blobs
    else:
        blobs = restrict(base.filter(F.col("text").rlike(_HINT)).select(F.sha2("text", 256).alias("blob"), "text"), unseen.select("blob"), "blob")
    found = scan(blobs).dropDuplicates(["blob"])
    found.select("blob", F.lit(RULE_VERSION).alias("rules"), "n_assign", "n_access", "n_hex", "base", "spans", "places").write.parquet(f"{ledger}/findings/scan={version}")
    # last, so that a scan that broke off is made again; a finding written twice is one on reading
    unseen.select("blob", F.lit(RULE_VERSION).alias("rules")).write.parquet(f"{ledger}/scanned/scan={version}")
    return paths


def _findings(spark: SparkSession, ledger: str) -> DataFrame:
    found = _read(spark, f"{ledger}/findings", _FINDINGS).filter(F.col("rules") == RULE_VERSION).drop("rules")
    return materialize(found.filter("spans <> ''").dropDuplicates(["blob"]), "findings")


def history(spark: SparkSession, ledger: str) -> DataFrame:
    """Every document version that holds a finding: scan (1 for the first), doc_id, blob, spans."""
    found = _findings(spark, ledger).select("blob", "spans")
    paths = _read(spark, f"{ledger}/paths", _PATHS)
    return paths.join(F.broadcast(found) if fits(found, "blob", "spans") else found, "blob").select("scan", "doc_id", "blob", "spans")


def _ids_repeat(paths: DataFrame) -> bool:
    total, distinct = paths.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    return total != distinct


def secret_findings(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per row of documents: doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans, places.

    Without a ledger path a new one is begun in the scratch folder.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    paths = update_ledger(docs, ledger)
    found = _findings(spark, ledger)
    joined_ = paths.join(F.broadcast(found) if fits(found, "blob", "base", "spans") else found, "blob", "left")
    return joined_.select("doc_id", "blob", *[F.coalesce(f"n_{k.name}", F.lit(0).cast("long")).alias(f"n_{k.name}") for k in BASE], F.when(F.coalesce("base", F.lit("")) == "", F.lit(EMPTY_SHA)).otherwise(F.sha2("base", 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "places")


@keeps_names
def redacted(docs: DataFrame, ledger: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mask`` (overlapping spans by one); n_chars follows the text."""
    found = secret_findings(docs, ledger).filter("spans <> ''").select(F.col("blob").alias("_blob"), F.col("places").alias("_places")).dropDuplicates(["_blob"])
    found = materialize(found, "redactions")
    places = found.agg(F.coalesce(F.sum(F.size("_places")), F.lit(0))).first()[0]
    hit = docs.join(F.broadcast(found) if fits(found, "_blob") and places <= BROADCAST_ROWS else found, F.sha2(text_or_empty(), 256) == F.col("_blob"), "left")
    # pieces between the spans, then the mask between the pieces
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["keep"], F.array(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]))).alias("keep"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["keep"].alias("keep")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("keep"))
    clean = F.aggregate("_places", zero, step, lambda s: F.concat(F.array_join(s["keep"], mask), F.lit(mask), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    # a column of its own: beside an alias ``text``, the lambda's ``text`` would be taken for that
    hit = hit.withColumn("_new", F.when(F.col("_places").isNotNull(), clean).otherwise(F.col("text")))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_places").isNotNull(), F.length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return hit.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
