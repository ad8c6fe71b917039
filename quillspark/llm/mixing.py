"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words.  A document's copies are its source's rate (target
over size) rounded up or down; which documents round up is drawn so that the words of
each source stay at the target.  Two fractional documents meet, word mass moves from
one to the other in a random direction until one of them is integral, and the other
goes on as the residual.  Rows meet in groups of bounded size, residuals of groups meet
in groups of the next level, and so on until one residual is left for each source:
a reduction tree whose levels are ordinary aggregates.

Everything is DataFrame functions.  The draws are hashes of document ids and the seed,
so reruns agree whatever the partitioning.

Cases: null text has size 0; null source is a source of its own, after all others; a
document of size 0 holds no words and takes 0; rows of equal id, or without one, count one by one; a
source or table without words takes none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, keeps_names, materialize, restrict, shuffle_width

#: Weights of the sources in code point order, repeating; total over all sizes; cap over a source's size.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Documents that meet in one group, on average.
FAN_IN = 32
#: Equal rows that are numbered in one go.
NUMBERED = 4096


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, n_docs and rank, its place in code point order, null last.

    Sources are dealt to ranges; the rank is the place in the range after the sources of the
    ranges before it, whose sizes (one number for each range) are all that one place sees.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    first = F.col("source").asc_nulls_last()
    dealt = materialize(by.repartitionByRange(shuffle_width(sizes.sparkSession), first).withColumn("part", F.spark_partition_id()), "dealt")
    before, n = [], 0
    for part, count in sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect()):
        before += [F.lit(part), F.lit(n)]
        n += count
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return dealt.withColumn("rank", start + F.row_number().over(Window.partitionBy("part").orderBy(first)) - 1).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source_size, n_docs, rank and target.

    Resharing what lies above the caps until none is above ends at a common level: a source
    gets its weight times the level, or its cap if that is less.  The level rises from that
    without caps; each round is one aggregate over the sources, and ends when no more are capped.
    """
    by = ranked_sources(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = materialize(by.withColumn("w", weight), "ranked")
    most = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while True:
        full = most <= F.col("w") * F.lit(level) if capped >= 0 else F.lit(False)
        row = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.count_if(full)).first()
        whole, held, open_, now = row
        if now == capped or not open_:
            break
        level, capped = (share * whole - cap * held) / open_, now
    target = F.least(most, F.col("w") * F.lit(level)) if open_ else most
    return by.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def _draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _item(doc_id: Column, size: Column, p: Column, place: Column) -> Column:
    """``place`` tells rows of equal id and size apart."""
    return F.struct(doc_id.alias("doc_id"), size.alias("size"), p.alias("p"), place.alias("place"))


def _settled(item: Column, up: int) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), F.lit(up).alias("up"))


def _meet(seed: int):
    """Folds an item into (carry, done): one of carry and item becomes integral, the other is carried on."""

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        mass_c, room_c = c["size"] * c["p"], c["size"] * (1.0 - c["p"])
        mass_x, room_x = x["size"] * x["p"], x["size"] * (1.0 - x["p"])
        gain, loss = F.least(room_c, mass_x), F.least(mass_c, room_x)
        rises = _draw(seed, c["doc_id"], c["place"], x["doc_id"], x["place"]) * (gain + loss) < loss
        fills, empties = room_c <= mass_x, mass_c <= room_x
        new_p = F.when(rises & fills, x["p"] - room_c / x["size"]).when(rises, c["p"] + mass_x / c["size"]).when(empties, x["p"] + mass_c / x["size"]).otherwise(c["p"] - room_x / c["size"])
        carries_x = F.when(rises, fills).otherwise(empties)
        carry = F.when(carries_x, _item(x["doc_id"], x["size"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), new_p)), x["place"])).otherwise(_item(c["doc_id"], c["size"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), new_p)), c["place"]))
        done = F.when(rises & fills, _settled(c, 1)).when(rises, _settled(x, 0)).when(empties, _settled(c, 0)).otherwise(_settled(x, 1))
        return F.struct(carry.alias("carry"), F.concat(state["done"], F.array(done)).alias("done"))

    return step


def _level(items: DataFrame, seed: int) -> DataFrame:
    """One row for each (rank, g): the residual as carry, the settled documents as done."""
    grouped = items.groupBy("rank", "g").agg(F.array_sort(F.collect_list("item")).alias("items"))
    first = F.element_at("items", 1)
    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>")
    folded = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), F.struct(first.alias("carry"), none.alias("done")), _meet(seed))
    return grouped.select("rank", "g", folded.alias("s")).select("rank", "g", "s.carry", "s.done")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 20, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    return mix_sizes(materialize(sized(docs), "sizes"), weights, share, cap, seed, fan_in)


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 20, fan_in: int = FAN_IN) -> DataFrame:
    """:func:`mix` of a scratch table of doc_id, source and size."""
    sources = materialize(source_targets(sizes, weights, share, cap), "sources")
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    right = sources.select(F.col("source").alias("_source"), "rank", "source_size", "n_docs", "target")
    rows = sizes.join(F.broadcast(right) if n_sources <= BROADCAST_ROWS else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    split = (F.col("size") > 0) & (F.col("p") > 1e-12)

    groups = F.ceil(F.col("n_docs") / fan_in)
    # rows without an id, or of one id, are numbered so that they do not all meet in one group
    equal = rows.filter(split).groupBy("rank", "doc_id", "size", "p", "n_docs").agg(F.count("*").alias("n"))
    equal = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / NUMBERED))))
    equal = equal.withColumn("place", F.explode(F.sequence(F.col("block") * NUMBERED, F.least(F.col("n"), (F.col("block") + 1) * NUMBERED) - 1)))
    items = equal.select("rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "place"), groups).alias("g"), _item(F.col("doc_id"), F.col("size"), F.col("p"), F.col("place")).alias("item"))
    wide, done = -(-int(most) // fan_in), []
    while True:
        level = materialize(_level(items, seed + len(done)), "level")
        done.append(level.select("rank", F.explode("done").alias("d")).select("rank", "d.doc_id", "d.size", "d.up"))
        if wide <= 1:
            break
        wide = -(-wide // fan_in)
        items = level.select("rank", F.floor(F.col("g") / fan_in).alias("g"), F.col("carry").alias("item"))
    last = level.select("rank", "carry.*").select("rank", "doc_id", "size", (_draw(seed, F.lit(-1), F.col("doc_id"), F.col("place")) < F.col("p")).cast("int").alias("up"))
    for x in done:
        last = last.union(x)
    whole = rows.filter(~split).select("rank", "doc_id", "size", F.lit(0).alias("up"))
    info = sources.select("rank", "source", "source_size", "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + 1e-12).alias("base"))
    out = last.union(whole)
    out = out.join(F.broadcast(info) if n_sources <= BROADCAST_ROWS else info, "rank")
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


@keeps_names
def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with the columns of ``docs``.

    Documents without words or without copies go.  Rows under one doc_id, or without an id, are
    documents of their own: where there are such, a row is named by a hash of its id, source and
    text, and by its rank among the rows of equal hash.
    """
    ids = docs.select("doc_id")
    total, distinct = ids.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if total == distinct:
        named = docs.withColumn("_mix_row", F.col("doc_id").cast("long"))
        plan = mix(docs, **settings)
    else:
        hashed = docs.withColumn("_mix_row", F.xxhash64("doc_id", "source", "text"))
        ranks = Window.partitionBy("_mix_row")

        def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
            place = F.row_number().over(ranks.orderBy(*order))
            return df.withColumn("_mix_row", F.when(place > 1, F.xxhash64("_mix_row", place)).otherwise(F.col("_mix_row")))

        sizes = materialize(sized(hashed.withColumn("doc_id", F.col("_mix_row"))), "hashed").withColumnRenamed("doc_id", "_mix_row")
        again = materialize(sizes.groupBy("_mix_row").agg(F.count("*").alias("n")).filter("n > 1").select("_mix_row"), "again")
        plan = mix_sizes(materialize(ranked(sizes, "source", "size").withColumnRenamed("_mix_row", "doc_id"), "sizes"), **settings)
        # only texts of rows that are there more than once move for their ranks
        named = restrict(hashed, again, "_mix_row", "left_anti").unionByName(ranked(restrict(hashed, again, "_mix_row"), F.xxhash64(F.to_json(F.struct(*docs.columns)))))
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias("_mix_id"), F.col("copies").alias("_mix_copies")).hint("shuffle_hash")
    joined = named.join(plan, F.col("_mix_row") == F.col("_mix_id"))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)
