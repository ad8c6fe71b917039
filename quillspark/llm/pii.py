"""Operator 9: personal data by bootstrapped contextual extraction.

Entities that the base rules find are the first seeds.  The two and the three words to the left of
an entity, those to its right, and the words on both sides are its lexical patterns.  Every other
token that could be an identifier (it holds a digit or an @) is a candidate with patterns of its own.
Candidates that no rule could mean (numbers that the base rules look at and reject, plain numbers and
times, hexadecimal strings) are negative instances: they are never discovered, and count against the
patterns that select them.

Patterns and instances form a graph that is worked in rounds.  A pattern with ``LEAST_SEEDS``
different seeds is scored by two shares: of its labelled instances those that are seeds (each as good
as its own score), and of the places where its words stand near an identifier-like token those that
adjoin one, which by chance would be one in a dozen.  Candidates without a label count neither for
nor against it.  An instance is as good as its patterns make it; those above the threshold become
seeds themselves, with their score, and induce patterns of the contexts that they have elsewhere.
Rounds end when one finds nothing new.  What was discovered is returned as kind ``context``.

All of it is DataFrame functions.  Seeds are counted as distinct instances and places as shares, so
that copies of a table change nothing; patterns that two instances do not share are left out early,
which leaves a table far smaller than the text.

Cases: null text is empty; texts without digits and @ have no spans; repeated rows are
returned one by one; an empty table gives no rows; other columns are ignored.  Words of a context
are taken whole, however long they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fits, lookup_join, materialize, text_or_empty
from .spans import Kind, joined, kind_spans

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: The least score of a discovered instance, the least different seeds and the least confidence of a pattern.
THRESHOLD, LEAST_SEEDS, LEAST_CONFIDENCE = 0.7, 2, 0.6
#: What a pattern's labelled instances are held against besides the negative ones.
DOUBT = 0.5
#: Words beside an identifier-like token among which patterns' words are counted.
NEAR_WORDS = 12


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    numbers = F.transform(F.sequence(F.length(digits), F.lit(1), F.lit(-1)), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(numbers, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(m: Column) -> Column:
    d = _digits(m["text"])
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)


def _ip(m: Column) -> Column:
    return F.forall(F.split(m["text"], r"\.", -1), lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")).between(1, 3) & (F.substring(F.regexp_replace(x, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))


#: The base rules.  \\G and the look-behind skip starts inside a run whose first start has failed already.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _ip),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m["text"])).between(9, 15)),
]
NAMES = [*[k.name for k in BASE], "context"]
#: A word that could be an identifier, and what to strip from its ends.
CANDIDATE = Kind("candidate", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", r"[0-9@]")
#: Ends that belong to the sentence, not to the word.
_EDGES = r"^[\p{P}\p{S}&&[^@+#]]+|[\p{P}\p{S}&&[^@+#]]+$"
#: What is no identifier for certain.
_NEGATIVE = r"[0-9.,:/%x*()-]{1,8}|[0-9][0-9 .:-]{10,}|[0-9]+(\.[0-9]+){3}|(0x)?[0-9a-f]{16,}"
#: Code points beside a span in which its context is looked for first; with too few words in them, all that lies beside it is taken.
_REACH = 160


def _words(text: Column) -> Column:
    bare = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, _EDGES, ""))
    return F.filter(bare, lambda w: w != "")


def _beside(gap: Column, at_end: bool) -> Column:
    """The words of a gap next to the span after it (``at_end``) or before it, without the rest of the word that the span is cut out of."""
    words = _words(F.regexp_replace(gap, WORD + r"\z" if at_end else "^" + WORD, ""))
    return F.slice(words, F.greatest(F.size(words) - NEAR_WORDS + 1, F.lit(1)), NEAR_WORDS) if at_end else F.slice(words, 1, NEAR_WORDS)


def _described(s: Column) -> Column:
    """A span as an instance with the words beside it, in lower case."""
    bare = F.regexp_replace(F.lower(s["text"]), _EDGES, "")
    lead = F.length(F.regexp_extract(s["text"], _EDGES.split("|")[0], 0))
    lead = F.when(bare == "", 0).otherwise(lead)
    return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(bare)).alias("end"), bare.alias("instance"), _beside(s["left"], True).alias("left"), _beside(s["right"], False).alias("right"))


def _runs(words: Column, n: int, sign: str) -> Column:
    """All runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(sign), F.array_join(F.slice(words, i, n), " ")))


def _own_patterns(left: Column, right: Column) -> Column:
    """The patterns of an instance between these words."""
    before = lambda n: F.concat(F.lit("<"), F.array_join(F.slice(left, -n, n), " "))
    after = lambda n: F.concat(F.lit(">"), F.array_join(F.slice(right, 1, n), " "))
    sides = [F.when(F.size(words) >= n, side(n)) for words, side in ((left, before), (right, after)) for n in (2, 3)]
    both = F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat(before(1), after(1)))
    return F.array_compact(F.array(*sides, both))


def _near_patterns(left: Column, right: Column) -> Column:
    """The patterns whose words stand among these, the words next to the instance included."""
    pairs = F.transform(F.when(F.size(left) >= 3, F.sequence(F.lit(1), F.size(left) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("<"), F.get(left, i - 1), F.lit(">"), F.get(left, i + 1)))
    both = F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.array(F.concat(F.lit("<"), F.element_at(left, -1), F.lit(">"), F.get(right, 0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[_runs(words, n, sign) for words, sign in ((left, "<"), (right, ">")) for n in (2, 3)], pairs, both)


def base_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, spans, seeds, marks) of the texts that hold a digit or an @; marks are the candidates, ``free`` of base spans or not."""
    out = docs.filter(F.col("text").rlike(r"[0-9@]"))
    names = [f"_found_{k.name}" for k in BASE]
    for i, (kind, name) in enumerate(zip(BASE, names, strict=True)):
        out = kind_spans(out, "text", kind, i, name, _REACH)
    out = kind_spans(out, "text", CANDIDATE, len(BASE), "_found_candidate", _REACH)
    out = out.select("doc_id", F.xxhash64("text").alias("text_key"), F.concat(*names).alias("_seeds"), "_found_candidate")
    plain = F.transform("_seeds", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    out = out.withColumn("spans", F.array_sort(plain))
    # a candidate is one whole word, a base span may cover several: it is not free if a span meets it
    free = lambda c: ~F.exists("spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    marks = F.transform("_found_candidate", lambda c: F.struct(_described(c).alias("m"), free(c).alias("free")))
    return out.select("doc_id", "text_key", "spans", F.transform("_seeds", _described).alias("seeds"), marks.alias("marks"))


def _kept(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return lookup_join(df, table, [on], "inner")


def bootstrapped(edges: DataFrame, near: DataFrame, threshold: float = THRESHOLD, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(instance, score) of the instances discovered from distinct edges (pattern, instance, seed, negative).

    ``near`` (own, near: arrays of patterns) are the patterns of each identifier-like token and those
    whose words stand near it.  Both are scratch tables.
    """
    shared = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("int")).alias("s")).filter("n > 1").select("pattern"), "shared")
    graph = materialize(_kept(edges, shared, "pattern"), "graph")
    found = edges.sparkSession.createDataFrame([], "instance string, score double")
    known = edges.sparkSession.createDataFrame([], "pattern string, focus double")
    while True:
        rated = lookup_join(graph, found, ["instance"]) if not found.isEmpty() else graph.withColumn("score", F.lit(None).cast("double"))
        weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        by = rated.groupBy("pattern").agg(F.sum(weight).alias("weight"), F.sum((weight > 0).cast("long")).alias("seeds"), F.sum(F.col("negative").cast("long")).alias("against"), F.count("*").alias("all"))
        by = by.filter((F.col("seeds") >= least_seeds) & (F.col("seeds") + F.col("against") < F.col("all"))).select("pattern", (F.col("weight") / (F.col("weight") + F.col("against") + DOUBT)).alias("purity"))
        able = materialize(by.filter(F.col("purity") >= least_confidence), "able")
        fresh = materialize(able.select("pattern").join(known, "pattern", "left_anti"), "fresh")
        if not fresh.isEmpty():
            at = lambda c: _kept(near.select(F.explode(c).alias("pattern")), fresh, "pattern").groupBy("pattern").count()
            known = materialize(known.union(at("own").join(at("near").withColumnRenamed("count", "places"), "pattern").select("pattern", (F.col("count") / F.col("places")).alias("focus"))), "focus")
        sure = able.join(known, "pattern").select("pattern", (F.col("purity") * F.col("focus")).alias("confidence")).filter(F.col("confidence") >= least_confidence)
        sure = materialize(sure, "sure")
        scores = _kept(graph.filter("not seed and not negative"), sure, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))).alias("score"))
        new = scores.filter(F.col("score") >= threshold).join(found.select("instance"), "instance", "left_anti")
        more = materialize(found.union(new), "promoted")
        if more.count() == found.count():
            return found
        found = more


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """Per row of documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # a filter on the spans before they are written would be pushed below the regular expressions and run them again
    found = materialize(base_spans(rows), "found")
    marks = found.select("doc_id", "text_key", F.explode("marks").alias("k")).select("doc_id", "text_key", "k.m.*", "k.free")

    def edges(one: DataFrame, seed: bool) -> DataFrame:
        one = one.select("instance", F.explode(_own_patterns(F.col("left"), F.col("right"))).alias("pattern"))
        return one.select("pattern", "instance", F.lit(seed).alias("seed"), (F.lit(not seed) & F.col("instance").rlike(f"^(?:{_NEGATIVE})?$")).alias("negative"))

    graph = edges(found.select(F.explode("seeds").alias("c")).select("c.*"), True).union(edges(marks.filter("free"), False)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("negative").alias("negative"))
    near = marks.select(_own_patterns(F.col("left"), F.col("right")).alias("own"), _near_patterns(F.col("left"), F.col("right")).alias("near"))
    chosen = bootstrapped(materialize(graph, "graph"), near, threshold, least_seeds).select("instance")
    base = found.filter(F.size("spans") > 0).select("doc_id", "text_key", "spans")
    if not chosen.isEmpty():
        places = marks.filter("free").select("doc_id", "text_key", "start", "end", "instance")
        more = lookup_join(places, chosen, ["instance"], "left_semi").select("doc_id", "text_key", F.struct("start", F.lit(len(BASE)).alias("rank"), "end").alias("s")).distinct()
        more = more.groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("added"))  # at most the candidates of one text
        both = base.dropDuplicates(["doc_id", "text_key"]).join(more, ["doc_id", "text_key"], "full")
        base = both.select("doc_id", "text_key", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("spans"), "added")
    else:
        base = base.dropDuplicates(["doc_id", "text_key"]).withColumn("added", F.lit(None).cast("array<struct<start:int,rank:int,end:int>>"))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{NAMES[i]}")
    all_ = F.concat("spans", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    final = base.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), *[of_kind(i) for i in range(len(BASE))], F.sha2(joined(F.col("spans"), NAMES), 256).alias("base_sha256"), joined(all_, NAMES).alias("spans"))
    final = materialize(final, "final")
    ids = rows.select("doc_id", F.xxhash64("text").alias("text_key"))
    final = F.broadcast(final) if fits(final, "spans", "base_sha256") else final
    out = ids.join(final, ids["doc_id"].eqNullSafe(F.col("_doc")) & (ids["text_key"] == F.col("_key")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[F.coalesce(f"n_{k.name}", zero).alias(f"n_{k.name}") for k in BASE], F.coalesce("base_sha256", F.lit(EMPTY_SHA)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
