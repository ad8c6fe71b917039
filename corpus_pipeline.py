"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of their docs,
whatever other columns there are.

1. language_id: documents in none of the learned languages go.
2. near_duplicates: of each component of near duplicates the document of smallest id stays.
3. secrets: found secrets are masked in the texts.
4. mix: each document as many times as the mix takes it; those taken 0 times go.
5. pack: pieces of sequences, with their token ids.

Cases: 1 judges each row by its text alone, so that rows without an id or of equal id are judged one by
one; null texts and texts without a letter go.  2 keeps rows without an id and, of rows of equal id and
text, one; different texts of one id are documents of their own.  3 leaves null texts null.  4 takes
nothing of texts without words; a null source is a source.  5 takes null texts as empty.  Ties are
settled by the smallest id, then by hash; an empty table gives no rows in any stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, mixing, ngram_join, packing, secret_scan
from quillspark.llm.common import drop_paths, noted, scratch_path, ship_package

#: Scratch folders of the stage that ran last.
_before: list[str] = []


def _staged(spark: SparkSession, docs: DataFrame, work: Callable[[DataFrame], DataFrame], first: bool = False) -> DataFrame:
    """Runs a stage's operator; what the stage before has left behind is deleted, as its result has been written and is read as ``docs``."""
    ship_package(spark)
    if not first:
        drop_paths(spark, _before, docs)
    with noted() as made:
        out = work(docs)
    _before[:] = made
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staged(spark, docs, langid.identified, first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staged(spark, docs, ngram_join.one_of_each)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staged(spark, docs, secret_scan.redacted)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staged(spark, docs, mixing.mixed_documents)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staged(spark, docs, lambda own: packing.packed(own, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: Tokenising and learning have no SQL form; tests/llm/test_methods.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the scratch folder and read again, until the next one's is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_paths(spark, old, docs)
        old = [path]
    return docs
