"""Batches in pieces of bounded size, and what is counted in them."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.functions.inverted import inverted
from quillspark.operators import gram_index, stats
from quillspark.plans import batches


def test_pieces_are_bounded_and_whole():
    texts = ["ab", None, "", "x" * 50, "é", "cd"] * 3
    batch = pa.RecordBatch.from_pydict({"t": texts, "u": [[1], None, [], [2, 3], [4], []] * 3}, schema=pa.schema([("t", pa.string()), ("u", pa.list_(pa.int32()))]))
    parts = list(batches.pieces(iter([batch, batch.slice(0, 0)]), ("t", "u"), 6))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts and len(parts) > 3
    assert all(sum(map(len, filter(None, p.column("t").to_pylist()[:-1]))) < 6 + 2 for p in parts)


@pytest.mark.parametrize("piece", [3, 500_000])
def test_postings_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(batches.pieces, "__defaults__", (piece,))
    tokens = [["a", "b", "a"], [], ["c"], ["a"] * 5]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": tokens}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.list_(pa.string()))]))
    made = list(inverted(("text",))(iter([batch])))
    found = {(r["term"], r["doc_id"]): (r["positions"], r["length"]) for b in made for r in b.to_pylist()}
    want = {(x, i): ([k for k, y in enumerate(t) if y == x], len(t)) for i, t in enumerate(tokens, 1) for x in t} | {("", i): ([], len(t)) for i, t in enumerate(tokens, 1)}
    assert found == want and (piece > 3 or max(b.num_rows for b in made) < 4)


def test_filters_do_not_depend_on_pieces(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i} " * 9, f"s{i}") for i in range(40)], "doc_id long, text string, source string").repartition(3).write.parquet(f"file://{tmp_path}/t")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    want = sorted(map(tuple, gram_index.build(docs).collect()))
    monkeypatch.setattr(gram_index, "pieces", lambda own, columns: batches.pieces(own, columns, 20))
    assert sorted(map(tuple, gram_index.build(docs).collect())) == want and want


def test_pairs_are_counted_in_their_task(spark):
    rows = [("a", "山x水。火木金"), ("a", "火木!火 木;山水"), ("b", "𠀀山𠀀水，火之木"), (None, "水火"), ("a", None), ("b", ""), ("c", "no pair 山")]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = collections.Counter()
    for lang, text in rows:
        for s in re.split("[。！？；!?;]+", text or ""):
            own = re.sub("[^一-鿿]", "", s)
            want.update((lang, own[i : i + 2]) for i in range(len(own) - 1) if "之" not in own[i : i + 2])
    found = stats.top_bigrams(texts, "lang", 10, ("之", "火火"))
    assert {(r.lang, r.pair): r.n for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_lengths_of_nulls():
    assert np.array_equal(batches.lengths(pa.array(["é", None, ""])), [2, 0, 0])
