"""Order statistics, differences, wiki templates, verified sinks and streamed paragraphs against plain versions."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import diffs, ranks, sessions, stats
from quillspark.sinks import store
from quillspark.sources import markup
from quillspark.streaming.paragraphs import streaming_capped_sessions


@pytest.mark.parametrize("kind", ["spread", "ties", "alike", "few values"])
def test_ranks_equal_a_sort(spark, kind):
    rng = random.Random(6)
    values = {"spread": [rng.gauss(0, 1e6) for _ in range(5000)], "ties": [float(rng.choice([0, 0, 0, 1, 2, 1e300])) for _ in range(5000)], "alike": [7.5] * 3000, "few values": [3.0, 1.0]}[kind]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(6)
    ordered = sorted(values)
    for place in {0, 1, len(values) // 4, len(values) // 2, len(values) - 1}:
        assert ranks.nth(rows, "v", place, few=50) == ordered[place]
    assert ranks.nth(rows, "v", len(values), few=50) is None and ranks.nth(rows.limit(0), "v", 0) is None


def test_differences(spark):
    rng = random.Random(7)
    line = lambda: rng.choice("abcde")
    pairs = [("\n".join(line() for _ in range(n)), "\n".join(line() for _ in range(m))) for n, m in [(0, 3), (5, 5), (60, 70), (30, 1)]] + [(None, "x"), ("same", "same"), ("", None)]
    got = [r.d for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(diffs.unified_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm=""))[:40] for a, b in pairs]
    assert len(got[2]) == 40 and got[5] == []


def test_templates_at_any_depth(spark):
    rng = random.Random(9)
    texts = ["start " + "{{a|" * 14 + "x" + "}}" * 14 + " end", "{{" * 3000 + "}}" * 3000 + "z", "{{a {b} }} c", "{{{x}}}", "}}{{", "{{a}", None] + ["".join(rng.choice(["{", "}", "{{", "}}", "a", "b"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]

    def looped(text):
        while (less := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
            text = less
        return text

    assert [markup._untemplated(t or "") for t in texts] == [looped(t or "") for t in texts]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:1])], "page int, text string")
    assert markup.clean_wikitext(pages).first().text == "start  end"


def test_verified_sink_makes_rows_once(spark, tmp_path):
    seen, path = spark.sparkContext.accumulator(0), f"file://{tmp_path}/v"
    counted = F.udf(lambda x: (seen.add(1), x)[1], "int")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int").select(counted("id").alias("id"))
    store.write_verified(rows, {"low": F.col("id") < 9}, "id", path, "parquet")
    assert seen.value == 3 and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        store.write_verified(rows, {"low": F.col("id") < 3}, "id", path, "parquet")
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir() if p.name.startswith("v.")] == []
    store.write_markdown(spark.createDataFrame([("x", "one\n\ntwo\nthree")], "path string, text string"), f"file://{tmp_path}/m")
    assert [p.read_text() for p in (tmp_path / "m" / "path=x").glob("part*")] == ["one\n\ntwo\nthree\n"]


def test_sentence_lengths(spark):
    rows = [("a", "ab c。 de!?f g h;" * 600), ("a", "x"), ("b", "short."), ("c", None)]
    got = {r.key: r for r in stats.sentence_lengths(spark.createDataFrame(rows, "key string, text string"), "key").collect()}
    lens = [3, 2, 3] * 600 + [1]
    mean = sum(lens) / len(lens)
    assert (got["a"].sentences, got["a"].mean_chars, got["a"].stdev_chars, got["a"].shortest, got["a"].longest) == (1801, round(mean, 1), round((sum((x - mean) ** 2 for x in lens) / len(lens)) ** 0.5, 1), 1, 3)
    assert got["b"].state == got["c"].state == "insufficient" and got["b"].mean_chars is None


def test_streamed_paragraphs_equal_the_batch(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for f in ("a", "b", "c"):
        at = 0
        for i in range(60):
            at += rng.choice([10, 500, 2400, 2501, 9000])
            rows.append((f, i, at, at + 400, rng.choice(["[music]", "word " * rng.randint(1, 40), "(x)", "short"]).strip()))
            at += 400
    schema = "file string, idx long, start_ms long, end_ms long, text string"
    whole = spark.createDataFrame(rows, schema)
    mixed = rows + [(f, 60, None, None, None) for f in "abc"] + rows[:5]
    rng.shuffle(mixed)
    for i in range(0, len(mixed), 25):
        spark.createDataFrame(mixed[i : i + 25], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = streaming_capped_sessions(stream).writeStream.format("memory").queryName("paragraphs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    columns = ["file", "para", "start_ms", "end_ms", "chars", "cue_count", "text"]
    want = sorted(tuple(r) for r in sessions.capped_sessions(whole).select(columns).collect())
    assert sorted(tuple(r) for r in spark.table("paragraphs").select(columns).collect()) == want and len(want) > 20
