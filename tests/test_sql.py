"""SQL functions against the Column functions."""

import pytest
from pyspark.sql import functions as F

from quillspark import sql
from quillspark.catalog import QUERIES
from quillspark.functions import tokens as T

TEXTS = [None, "", "It's a-b, C++ and 50%!", "学习的方法 and 道", "“quoted” -- text… *bold* &amp; more...", "a\r\nb\n\nc. d! e", "Été " * 20, "x" * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    sql.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


@pytest.mark.parametrize(
    ("written", "column"),
    [
        ("text_words(t)", lambda: T.words(F.col("t"))), ("text_lexical_tokens(t)", lambda: T.lexical_tokens(F.col("t"))), ("token_shingles(text_words(t), 2)", lambda: T.shingles(T.words(F.col("t")), 2)), ("text_bare(t)", lambda: T.bare(F.col("t"))),
        ("char_grams(text_bare(t), 3)", lambda: T.char_grams(T.bare(F.col("t")))), ("text_fragment(t)", lambda: T.fragment(F.col("t"))), ("text_clean(t)", lambda: T.clean(F.col("t"))), ("unit_count(t)", lambda: T.unit_count(F.col("t"))), ("token_estimate(t)", lambda: T.token_estimate(F.col("t"))),
    ],
)
def test_scalar_functions(texts, written, column):
    got = [r.x for r in texts.selectExpr("id", f"{written} AS x").orderBy("id").collect()]
    assert got == [r.x for r in texts.select("id", column().alias("x")).orderBy("id").collect()]


def test_table_functions(spark, texts):
    texts.createOrReplaceTempView("some_texts")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT line, text FROM some_texts, LATERAL text_lines(t) WHERE id = 5 ORDER BY line") == [(0, "a"), (1, "b"), (2, ""), (3, "c. d! e")]
    assert [x for _, x in rows("SELECT nth, text FROM some_texts, LATERAL text_sentences(t) WHERE id = 5 ORDER BY nth")] == ["a", "b", "c", "d", "e"]
    assert rows("SELECT c.chunk, c.text, c.n_elements FROM some_texts, LATERAL text_chunks(t, 6) c WHERE id = 5 ORDER BY chunk") == [(0, "a\r\n\nb", 2), (1, "", 1), (2, "c. d! e", 1)]


def test_containment_moves_no_shingles(spark, sf001):
    plan = QUERIES["sql_containment"][0](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1  # texts are cut once, and their lists of shingles join nothing


def test_report_counts_shingles_behind_the_shuffle(spark, sf001):
    plan = QUERIES["overlap_report"][0](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
