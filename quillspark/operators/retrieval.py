"""Lexical retrieval: postings, BM25 ranking, neighbours, substring search, retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.inverted import inverted

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, length, tf) of documents with distinct ids; terms are counted inside each row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", T.lexical_tokens(F.col("text")).alias("text")).mapInArrow(inverted(("text",)), f"term string, doc_id {kind}, field string, positions array<int>, length long")
    return rows.filter("term <> ''").select("term", "doc_id", "length", F.size("positions").cast("long").alias("tf"))


def bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """(doc_id, score) of the documents that hold every term of the query, score rising with relevance.

    Terms are counted inside each row; the scores read again only the texts that hold them all.
    """
    rows = docs.select("doc_id", T.lexical_count(F.col("text")).alias("length"), *[T.lexical_count(F.col("text"), q).alias(f"tf{i}") for i, q in enumerate(query)])
    stats = rows.agg(F.count("*").alias("N"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(query))])
    score, held, every = F.lit(0.0), F.lit(True), F.lit(True)
    for i, q in enumerate(query):
        n, f = F.col(f"n{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("N") - n + 0.5) / (n + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        held, every = held & F.lower("text").contains(q), every & (f > 0)
    found = docs.filter(held).select("doc_id", T.lexical_count(F.col("text")).alias("length"), *[T.lexical_count(F.col("text"), q).alias(f"tf{i}") for i, q in enumerate(query)])
    return found.filter(every).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))  # one row of totals


def bm25_fields(chunks: DataFrame, query: list[str]) -> DataFrame:
    """:func:`bm25` over three columns: a chunk's path, its keywords (the path's tokens once more) and its text (chunk_id, path, text).

    A term may stand in any column; counts and lengths are sums over the columns.
    """
    twice = lambda term=None: 2 * T.lexical_count(F.col("path"), term) + T.lexical_count(F.col("text"), term)
    rows = chunks.select("chunk_id", twice().alias("length"), *[twice(q).alias(f"tf{i}") for i, q in enumerate(query)])
    stats = rows.agg(F.count("*").alias("N"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(query))])
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(query)):
        n, f = F.col(f"n{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("N") - n + 0.5) / (n + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        every = every & (f > 0)
    return rows.filter(every).crossJoin(F.broadcast(stats)).select("chunk_id", score.alias("score"))  # one row of totals


def top_k(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def neighbours(hits: DataFrame, docs: DataFrame, reach: int = 1) -> DataFrame:
    """(doc_id, near): the existing documents up to ``reach`` before and after each hit."""
    wanted = hits.select("doc_id", F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])).alias("d")).select("doc_id", (F.col("doc_id") + F.col("d")).alias("near"))
    return wanted.join(docs.select(F.col("doc_id").alias("near")), "near", "left_semi").select("doc_id", "near")


def grep(docs: DataFrame, needle: str) -> DataFrame:
    """Documents whose source holds the needle as it is, or whose text does in any letter case."""
    return docs.filter(F.col("source").contains(needle) | F.lower("text").contains(needle.lower())).select("doc_id").distinct()


def grep_chunks(chunks: DataFrame, needle: str, most: int = 20) -> DataFrame:
    """(chunk_id, path): the first ``most`` chunks, by id, whose path holds the needle as it is, or whose text does in any letter case."""
    hit = F.col("path").contains(needle) | F.lower("text").contains(needle.lower())
    return chunks.filter(F.coalesce(hit, F.lit(False))).select("chunk_id", "path").distinct().orderBy("chunk_id").limit(most)


def store_postings(docs: DataFrame, path: str) -> None:
    """Writes the postings below ``path``, in ranges of term and document, and their totals beside them; a frequent term fills as many files as it needs."""
    postings(docs).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    docs.select(T.lexical_count(F.col("text")).alias("length")).agg(F.count("*").alias("N"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")


def stored_bm25(spark: SparkSession, path: str, query: list[str]) -> DataFrame:
    """:func:`bm25` from stored postings: only row groups with a term of the query are read."""
    total = spark.read.parquet(f"{path}/totals").first()
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(query))
    held = rows.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((total["N"] - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    own = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / total["mean"]))
    by = rows.join(F.broadcast(held), "term").groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum(own).alias("score"))
    return by.filter(F.col("terms") == len(set(query))).select("doc_id", "score")


def quality_scores(counts: DataFrame) -> DataFrame:
    """(query, precision, recall, f1) of the counts of :func:`retrieval_quality`, and their macro averages as query ``macro``.

    A query that finds nothing has precision 0, one without relevant documents recall 0.
    """
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    rows = counts.select("query", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    macro = rows.agg(F.lit("macro").alias("query"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return rows.union(macro).select("query", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def retrieval_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives of found against relevant (query, doc_id) pairs."""
    both = found.select("query", "doc_id", F.lit(1).alias("f")).join(truth.select("query", "doc_id", F.lit(1).alias("t")), ["query", "doc_id"], "full")
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    return both.groupBy("query").agg(F.sum((f & t).cast("long")).alias("tp"), F.sum((f & ~t).cast("long")).alias("fp"), F.sum((~f & t).cast("long")).alias("fn"))
