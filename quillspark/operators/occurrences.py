"""Where many strings occur in many texts, found in one pass over the texts.

The strings make an Aho-Corasick automaton, which reads a text once however many strings there are.
Automatons take some fifty bytes a character, so strings go to the tasks in parts of a bounded
number of characters; each part is one pass over the texts.  No string meets a text that does not
hold it.  Where a string is sought in the texts of its own key only, strings and texts go to their
key, and each text is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.folds import folded
from ..plans.scratch import written

#: Characters of strings in one automaton, of texts that one task reads for a key, and strings for which no automaton is made.
PART_CHARS, TEXT_CHARS, FEW = 2_000_000, 50_000_000, 64

_built: dict[str, Any] = {}


def _made(strings: list[str]) -> Any:
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, x in enumerate(strings):
        made.add_word(x, (i, len(x)))
    made.make_automaton()
    return made


def _automaton(name: str, strings: list[str]) -> Any:
    """This worker's automaton of the named list of strings: one at a time, kept for the worker's next task."""
    if strings and name not in _built:
        _built.clear()
        _built[name] = _made(strings)
    return _built.get(name)


def _searched(shared: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, strings = shared.value
        automaton = _automaton(name, strings)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for place, text in enumerate(batch.column("text").to_pylist()):
                found: dict[int, list[int]] = {}
                for end, (i, n) in automaton.iter(text or "") if automaton else ():
                    if i in found:
                        found[i][1] += 1
                    else:
                        found[i] = [end - n + 2, 1]
                rows += [(place, i, first, n) for i, (first, n) in found.items()]
            place, which, first, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(place, pa.int64())), pa.array([strings[i] for i in which], pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["text_id", "string", "first", "n"])

    return run


def occurrences(strings: DataFrame, texts: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(text_id, string, first, n): every distinct ``string`` of ``strings`` in every text of ``texts`` (text_id, text) that holds it.

    ``first`` is the place of the first occurrence, from 1, and ``n`` how many there are, overlapping ones
    included, in code points.  Empty and null strings occur nowhere; texts are read whole.
    """
    spark = strings.sparkSession
    own = written(strings.select(F.col("string").cast("string").alias("string")).filter("string <> ''").distinct(), "strings")
    chars = own.agg(F.sum(F.length("string"))).first()[0] or 0
    parts = -(-chars // part_chars) or 1
    own = own.withColumn("part", F.pmod(F.xxhash64("string"), F.lit(parts)))
    kind = dict(texts.dtypes)["text_id"]
    found = []
    for part in range(parts):
        held = own.filter(F.col("part") == part).select("string").toArrow().column(0).to_pylist()  # about part_chars characters
        one = texts.select("text_id", "text").mapInArrow(_searched(spark.sparkContext.broadcast((uuid.uuid4().hex, held))), f"text_id {kind}, string string, first long, n long")
        found.append(one if parts == 1 else written(one, "occurrences"))
    return reduce(DataFrame.union, found)


def _held(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, text_id, string) of a block: its strings come first, then its texts, one by one."""
    strings: list[str] = []
    automaton = None
    for block, is_text, text_id, own in rows:
        if not is_text:
            strings.append(own)
        elif len(strings) <= FEW:
            yield from ((block["key"], text_id, x) for x in strings if x in own)
        else:
            automaton = automaton or _made(strings)
            yield from ((block["key"], text_id, strings[i]) for i in {i for _, (i, _) in automaton.iter(own)})


def occurrences_by_key(strings: DataFrame, texts: DataFrame, part_chars: int = PART_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """(key, text_id, string): every distinct ``string`` of a key (key, string) in every text of that key (key, text_id, text) that holds it.

    A key's strings and texts meet in one task; a large key is dealt out in blocks of some ``part_chars``
    characters of strings and ``text_chars`` of texts.  Empty and null strings occur nowhere.
    """
    own = strings.select("key", F.col("string").cast("string").alias("string")).filter("key is not null and string <> ''").distinct()
    read = texts.select("key", "text_id", "text").filter("key is not null and text <> ''")
    in_blocks = lambda of, most: F.ceil(F.sum(F.length(of)) / most).cast("int")
    blocks = own.groupBy("key").agg(in_blocks("string", part_chars).alias("parts")).join(read.groupBy("key").agg(in_blocks("text", text_chars).alias("cuts")), "key")
    block = F.struct("key", "part", "cut").alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    asked = own.join(blocks, "key").withColumn("part", of("string", "parts")).withColumn("cut", every("cuts"))
    there = read.join(blocks, "key").withColumn("cut", of("text_id", "cuts")).withColumn("part", every("parts"))
    kinds = {f.name: f for f in read.schema.fields}
    rows = asked.select(block, F.lit(False).alias("is_text"), F.lit(None).cast(kinds["text_id"].dataType).alias("text_id"), F.col("string").alias("own"))
    rows = rows.union(there.select(block, F.lit(True), "text_id", "text"))
    return folded(rows, "block", ["is_text"], _held, StructType([kinds["key"], kinds["text_id"], *own.select("string").schema.fields]))
