"""How far the sources of each language diverge in their words: joint count histograms.

The divergence of two sources is a sum over all kept terms of a function of the two counts and of
nothing else.  So for each pair of sources the terms are tallied by their (count, count) cell, and
the function is evaluated once for each cell that occurs, times the terms in it.  Only cells of terms
that both sources hold are tallied from the terms; cells with a zero are implied by the histogram of
the counts of each source, less what the joint cells have taken of it.

Moves of data: words are counted inside the tasks that read the texts, so that one row for each
(language, source, term) of a task is shuffled, whatever the sizes of the sources; then the kept
terms once, with a list of their sources; then cells.  A term's list has at most one entry for each
source of its language, and the result itself has a row for each pair of these.

Cases: null text, lang and source are ''.  A text without terms counts for its group's occurrence
only.  A language that keeps no term has pairs of value 0 and no terms.  Equal rows are documents of
their own.  Ties in rank go by the item's UTF-8 bytes.  No documents: no rows.  Only the columns
text, lang and source are looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, lookup_join, materialize

#: Distinct (group, term) counts that a task holds before it hands them on.
HELD = 300_000
#: Entries of term lists tallied together, and pairs of entries made at once.
BLOCK, PAIRS = 1 << 16, 1 << 20
#: Scale of p, and what is added to each count.
SCALE, PRIOR = 1_000_000_000, 2

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, c occurrences, d documents); an empty term says that the group occurs."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in counts.items():
            n = len(c)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(source, n), pa.array(c.keys(), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64()), pa.array(map(d.__getitem__, c), pa.int64())], ["lang", "source", "term", "c", "d"])
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            if (lang, source) not in counts:
                counts[lang, source] = Counter({b"": 0}), Counter({b"": 0})
            c, d = counts[lang, source]
            words, before = text.as_py().translate(_TERMS).split(), len(c)
            c.update(words)
            d.update(set(words))
            held += len(c) - before
            if held > HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, term, entries array<struct<source, c>>) of the terms in ``least_docs`` documents of their language, sources ascending.

    Each language also has a row with an empty term, whose entries are all its sources, counts 0.
    """
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = arrow_map(clean, _counted, "lang string, source string, term string, c long, d long")
    rows = rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    every = F.sum("d").over(Window.partitionBy("lang", "term"))
    rows = rows.withColumn("every", every).filter((F.col("every") >= least_docs) | (F.col("term") == ""))
    return rows.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "c"))).alias("entries"))


def _tally(keys: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct combination of the keys (small numbers from 0), and its summed weight."""
    sizes = [int(k.max()) + 1 for k in keys]
    if np.prod(np.array(sizes, float)) < 2**62:
        packed = np.zeros(len(weights), np.int64)
        for key, size in zip(keys, sizes, strict=True):
            packed = packed * size + key
        order = np.argsort(packed, kind="stable")
        differs = np.diff(packed[order]) != 0
    else:
        order = np.lexsort(keys)
        differs = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    first = np.append(0, np.flatnonzero(differs) + 1)
    return order[first], np.add.reduceat(weights[order], first)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, s, t, cs, ct, n): how many terms both s and t hold so often, and, negative, what that takes from the cells with zeros."""
    held: list[pa.RecordBatch] = []

    def tallied() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("entries").combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        entries = pc.list_flatten(lists)
        source, lang = entries.field("source").dictionary_encode(), table.column("lang").combine_chunks().dictionary_encode()
        groups, group = np.unique(np.repeat(lang.indices.to_numpy(), lengths).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        values, value = np.unique(np.append(0, entries.field("c").to_numpy()), return_inverse=True)
        value = value[1:]  # 0 has the number 0
        later = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(group)) - 1  # entries of the same term after each
        upto = np.cumsum(later)
        lo = 0
        while lo < len(group):
            hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")), lo + 1)
            times = later[lo:hi]
            left = np.repeat(np.arange(lo, hi), times)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
            lo = hi
            if not len(left):
                continue
            keys = [group[left], group[right], value[left], value[right]]
            at, n = _tally(keys, np.ones(len(left), np.int64))
            s, t, cs, ct = (k[at] for k in keys)
            parts = [(s, t, cs, ct, n)]
            for zeros, sign in (((2,), -1), ((3,), -1), ((2, 3), 1)):
                keys = [np.zeros_like(x) if i in zeros else x for i, x in enumerate((s, t, cs, ct))]
                at, m = _tally(keys, n)
                parts.append((*(k[at] for k in keys), sign * m))
            s, t, cs, ct, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            names = [source.dictionary.take(pa.array(groups[x] % len(source.dictionary))) for x in (s, t)]
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(groups[s] // len(source.dictionary))), *names, pa.array(values[cs]), pa.array(values[ct]), pa.array(n)], ["lang", "s", "t", "cs", "ct", "n"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(pc.list_flatten(batch.column("entries")))
        if size >= BLOCK:
            yield from tallied()
            held.clear()
            size = 0
    if held:
        yield from tallied()


def _p(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * V)), exact; null where nothing is kept."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))) div nullif(cast({total} + {PRIOR} * V as decimal(20,0)), 0) as bigint)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"cast((({p} - {q}) * ({p} - {q})) div ({p} + {q}) as bigint)")


def histogram_cells(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, s, t, cs, ct, n): the joint histogram of each pair s < t, zeros included; the n of a pair sum up to V."""
    both = arrow_map(terms.select("lang", "entries"), _cells, "lang string, s string, t string, cs long, ct long, n long")
    single = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.c").alias("c")).agg(F.count("*").alias("n"))
    single, zero = materialize(single, "marginals"), F.lit(0).cast("long")
    of = lambda side: lookup_join(single.withColumnRenamed("source", side), pairs.select("lang", "s", "t"), ["lang", side], "inner")
    left = of("s").select("lang", "s", "t", F.col("c").alias("cs"), zero.alias("ct"), "n")
    right = of("t").select("lang", "s", "t", zero.alias("cs"), F.col("c").alias("ct"), "n")
    neither = pairs.select("lang", "s", "t", zero.alias("cs"), zero.alias("ct"), (F.col("V") - F.col("held_s") - F.col("held_t")).alias("n"))
    return both.union(left).union(right).union(neither).groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("n").alias("n")).filter("n > 0")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): of each (lang, source) the divergence of every other source of the
    language (part ``pair``), and the ``top`` terms that it has more of than its language as a whole (part ``term``).
    """
    kept = materialize(kept_terms(docs, least_docs), "kept-terms")
    terms = kept.filter("term <> ''").withColumn("cl", F.expr("aggregate(entries, 0L, (a, e) -> a + e.c)"))
    one = terms.select("lang", "term", "cl", F.explode("entries").alias("e")).select("lang", "term", "cl", "e.source", "e.c")
    sizes = one.groupBy("lang", "source").agg(F.sum("c").alias("N"), F.count("*").alias("held"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("V"), F.sum("cl").alias("NL"))
    groups = kept.filter("term = ''").select("lang", F.explode("entries.source").alias("source")).join(sizes, ["lang", "source"], "left").join(F.broadcast(langs), "lang", "left").na.fill(0, ["N", "held", "V", "NL"])
    groups = materialize(groups, "groups")

    s, t = (groups.select("lang", F.col("source").alias(x), F.col("N").alias(f"N_{x}"), F.col("held").alias(f"held_{x}"), *(["V"] if x == "s" else [])) for x in "st")
    pairs = materialize(s.join(t, "lang").filter("s < t"), "pairs")
    cells = lookup_join(histogram_cells(terms, pairs), pairs, ["lang", "s", "t"], "inner")
    cells = cells.withColumn("p", _p("cs", "N_s")).withColumn("q", _p("ct", "N_t"))
    sums = materialize(cells.groupBy("lang", "s", "t").agg(F.sum(_f("p", "q") * F.col("n")).alias("value")), "sums")
    ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("w")
    pair = lookup_join(pairs.select("lang", "s", "t"), sums, ["lang", "s", "t"]).select("lang", ways, F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pair = pair.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    more = lookup_join(one, groups, ["lang", "source"], "inner").withColumn("p", _p("c", "N")).withColumn("q", _p("cl", "NL")).filter("p > q")
    term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pair.select("*", rank).union(term.select("*", rank).filter(F.col("rank") <= top))
