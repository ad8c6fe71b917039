"""Sources, sinks, stored postings, streams and the edge cases that tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import anchoring, catalogue, measures, overlap, retrieval, scoring, segments, sessions
from quillspark.sinks import store
from quillspark.sources import files, markup
from quillspark.streaming.sessions import streaming_distinct_cues, streaming_sessions


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / ".td").mkdir()
    (tmp_path / "a" / "one.md").write_text("# One\ntext"), (tmp_path / "two.md").write_text("two"), (tmp_path / "no.txt").write_text("x"), (tmp_path / ".td" / "x.md").write_text("y")
    got = {r.path: r.text for r in files.directory(spark, f"file://{tmp_path}").collect()}
    assert got == {"a/one.md": "# One\ntext", "two.md": "two"}
    assert files.texts(spark, f"file://{tmp_path}/two.md").first().text == "two"
    (tmp_path / "o.json").write_text(json.dumps({"a": 1, "b": "x"}, indent=2)), (tmp_path / "bad.json").write_text("{")
    assert files.json_object(spark, f"file://{tmp_path}/o.json", "a int, b string").first().asDict() == {"a": 1, "b": "x"}
    with pytest.raises(Exception):  # noqa: B017
        files.json_object(spark, f"file://{tmp_path}/bad.json", "a int").collect()


def test_json_rows(spark):
    rows = [("w", '{\n "a": 1,\n "b": "}{"\n}\n'), ("l", '[{"a": 1}, {"a": 2}]'), ("n", '{"a": 1}\n\n{"a": 2} x\r\n{"a": 3}'), ("e", "")]
    got = sorted((r.file, r.line, r.row and r.row.a, r.bad) for r in files.json_rows(spark.createDataFrame(rows, "file string, text string"), "a int, b string").collect())
    assert got == [("l", 0, 1, False), ("l", 0, 2, False), ("n", 1, 1, False), ("n", 3, None, True), ("n", 4, 3, False), ("w", 0, 1, False)]


def test_corpora_of_three_systems(spark):
    rows = [("v", "一之一\nfirst\n 一之二 \nsecond 【第9段】 x"), ("b", "【第2段】a【第7条】b【第2段】later"), ("n", "no marks"), ("t", "[00:00:01] a\nnot [00:00:02] b\n[00:00:03.5] c"), ("0", None)]
    got = sorted(((r.src, r.seg_no, r.label, r.text and r.text.strip()) for r in markup.corpus_segments(spark.createDataFrame(rows, "src string, text string")).collect()), key=str)
    assert got == sorted([("v", 1_000_000, "一之一", "一之一\nfirst"), ("v", 1_000_001, "一之二", "一之二 \nsecond 【第9段】 x"), ("b", 2, None, "【第2段】later"), ("b", 7, None, "【第7条】b"), ("n", None, None, None), ("0", None, None, None), ("t", 0, None, "[00:00:01] a\nnot [00:00:02] b"), ("t", 1, None, "[00:00:03.5] c")], key=str)


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "pre【第4段】one【第9条】 two "), (2, "lead\n# A\na\n## B\nb"), (3, "one\n\n \ntwo\n"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.block, r.by, r.text) for r in segments.structure_blocks(docs).collect())
    assert got == [(1, 1, "marks", "one"), (1, 2, "marks", "two"), (2, 1, "headings", "lead"), (2, 2, "headings", "# A\na"), (2, 3, "headings", "## B\nb"), (3, 1, "blank_lines", "one"), (3, 2, "blank_lines", "two")]
    long = spark.createDataFrame([(1, "ab. " * 5 + "x" * 25 + "! end")], "doc_id long, text string")
    parts = [r.text for r in segments.split_long(long, 10).orderBy("part").collect()]
    assert "".join(parts) == long.first().text and max(map(len, parts)) <= 10


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    rules = {"text": F.col("t").isNotNull()}
    with pytest.raises(ValueError):
        store.write_verified(rows, rules, "id", f"{root}/v")
    assert not (tmp_path / "v").exists()
    store.write_verified(rows.filter("id = 1"), rules, "id", f"{root}/v")
    assert spark.read.json(f"{root}/v").count() == 1
    made = []
    make = lambda: made.append(1) or rows
    assert store.cached_stage(spark, f"{root}/c", "k", make).count() == store.cached_stage(spark, f"{root}/c", "k", make).count() == 2 and len(made) == 1
    store.write_markdown(spark.createDataFrame([("x", "one\ntwo")], "path string, text string"), f"{root}/m")
    assert sorted(r.value for r in spark.read.text(f"{root}/m").collect()) == ["one", "two"]
    assert measures.rendered_table(rows.orderBy("id"), "T") == "# T\n\n| id | t |\n| --- | --- |\n| 1 | a |\n| 2 |  |\n"


def test_stored_postings_rank_alike(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    retrieval.store_postings(docs, f"file://{tmp_path}/p")
    want = {r.doc_id: round(r.score, 9) for r in retrieval.bm25(docs, ["with", "from"]).collect()}
    assert {r.doc_id: round(r.score, 9) for r in retrieval.stored_bm25(spark, f"file://{tmp_path}/p", ["with", "from"]).collect()} == want and want


def test_short_quotes_need_corpus_and_locator(spark):
    quotes = spark.createDataFrame([(1, 0, "天行健君", "short"), (1, 1, "天行健君", "short"), (1, 0, "地勢坤乎", "short"), (1, 2, "long enough quote", "quote")], "doc_id long, line long, quote string, kind string")
    found = anchoring.promoted_quotes(quotes, spark.createDataFrame([(1, "書曰天行健君子")], "seg long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, line long")).collect()
    assert sorted((r.line, r.quote, r.kind) for r in found) == [(0, "地勢坤乎", "short"), (0, "天行健君", "promoted"), (1, "天行健君", "short"), (2, "long enough quote", "quote")]


def test_verdicts_of_short_and_empty_quotes(spark):
    quotes = spark.createDataFrame([(1, "one two", 5), (2, "one two three", 5), (3, "one two three", 6), (4, "nine ten eleven", 5), (5, "one two three", None), (6, "", 5)], "quote_id long, quote string, target long")
    segs = spark.createDataFrame([(5, "say one two three now"), (6, "one two"), (7, None)], "seg long, text string")
    got = {r.quote_id: (r.verdict, r.hit_at) for r in anchoring.anchor_verdicts(quotes, segs).collect()}
    assert got == {1: ("TOO_SHORT", None), 2: ("ANCHOR_HIT", 5), 3: ("SPAN_HIT", 5), 4: ("NOT_IN_CORPUS", None), 5: ("UNANCHORED", 5), 6: ("TOO_SHORT", None)}


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.overlap_report(docs, docs).first().verdict == "vacuous"
    assert overlap.coverage_audit(overlap.coverage(docs, docs)).first().state == "insufficient"
    assert catalogue.section_diff(docs, docs).count() == segments.structure_blocks(docs).count() == segments.split_long(docs).count() == 0
    none = spark.createDataFrame([], "quote_id long, target long, verdict string")
    assert anchoring.anchor_report(none).first().verdict == "PASS" and anchoring.anchor_report(none).first().balanced
    cases = spark.createDataFrame([], "case_id long, target string, paired boolean")
    assert scoring.trigger_report(scoring.case_results(cases, spark.createDataFrame([], "case_id long, selected string"))).first().verdict == "vacuous"
    cues = spark.createDataFrame([], "file string, idx long, start_ms long, end_ms long, text string")
    assert sessions.capped_sessions(cues).count() == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 02:00:00"), ("v", "2024-01-01 00:00:00"), ("u", "2024-01-03 00:00:00")], "user_id string, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("user_id string, ts timestamp").parquet(f"file://{tmp_path}/e")
    query = streaming_sessions(stream).writeStream.format("memory").queryName("got_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/k1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.user_id, r.n) for r in spark.table("got_sessions").collect()) == [("u", 1), ("u", 2), ("v", 1)]
    cues = [("a", 1, "hello there"), ("a", 2, "Hello there, friend"), ("a", 3, "Hello there"), ("a", 4, "something new"), ("a", 5, None), ("b", 1, "open")]
    spark.createDataFrame(cues, "file string, idx long, text string").write.parquet(f"file://{tmp_path}/c")
    stream = spark.readStream.schema("file string, idx long, text string").parquet(f"file://{tmp_path}/c")
    query = streaming_distinct_cues(stream).writeStream.format("memory").queryName("got_cues").outputMode("append").option("checkpointLocation", f"{tmp_path}/k2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.file, r.idx, r.text) for r in spark.table("got_cues").collect()) == [("a", 2, "Hello there, friend"), ("a", 4, "something new")]
