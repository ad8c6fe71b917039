"""Operator 4: n-gram Jaccard join by grouped prefixes.

A document's shingles are put in one order for all documents: those in often-used
hash slots last, the rest by hash.  Two sets of similarity t share a shingle among
their first ``n - ceil(t n) + 1`` ones (their prefixes).  Documents of identical prefix
and size form one group; groups meet in the posting list of a prefix shingle, pairs
that fail the size or position bound are dropped, and the pairs left are expanded to
members of different sets, whose Jaccard similarity is then computed on their full sets.

Only components are asked for, so a long list is not paired with itself.  First one
of its groups, the one with the fewest rare shingles of its own, meets all others; when those links are components, a second pass pairs
what the list still holds in different components.  Every link between different sets
thus ends inside one component, and no list is squared unless its groups differ.

Cases: null and wordless texts have no shingles, link with nothing and are their own
component; repeated rows are copies of each other; documents without an id are returned
alone, with null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, BROADCAST_ROWS, by_runs, connected_components, keeps_names, lookup_join, materialize, restrict, row_keyed, ship_package, shuffle_width, text_or_empty
from .shingles import mix64, shingle_sets, stream64

#: Hash slots in which shingle uses are counted, for the order alone.
SLOT_BITS = 22
#: A list of up to so many groups is paired in full at once; blocks of a longer list in the second pass.
SMALL_LIST, BLOCK = 8, 256
#: Uses beyond which a shingle's postings are dealt to more than one task.
SPLIT_USES = 200_000
#: Bytes of postings that one task takes.
TASK_BYTES = 48 << 20
#: Member sets that meet one hub in a task.
HUB_ROWS = 64

_POSTING = np.dtype([("token", "<u8"), ("group", "<i8"), ("n", "<u4"), ("pos", "<u2")])


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (percent * n + 99) // 100 + 1


def slot_uses(base: DataFrame, k: int) -> Broadcast:
    """Hash slots used far more than the average, ascending, with their uses.

    Each task counts the documents of all its shingles in 2**SLOT_BITS slots and reports those
    well above its average; sums of reports are what the order goes by.  The table is at
    most 2**SLOT_BITS rows whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = shingle_sets(batch.column("text").slice(lo, 1024), k)
                own, times = np.unique((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int32), return_counts=True)
                total[own] += times.astype(np.int32)
        hot = np.flatnonzero(total >= max(4, 4 * total.mean()))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(hot, pa.int32()), "n": pa.array(total[hot].astype(np.int64), pa.int64())})

    told = arrow_map(base.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n >= 16").toPandas()
    told = told.sort_values("slot")
    return base.sparkSession.sparkContext.broadcast((told["slot"].to_numpy(np.int64), told["n"].to_numpy(np.int64)))


def _uses(hashes: np.ndarray, table: Broadcast) -> np.ndarray:
    slots, uses = table.value
    if not len(slots):
        return np.zeros(len(hashes), np.int64)
    own = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
    return np.where(slots[at] == own, uses[at], 0)


_KEY = stream64(8, 31)


def described(base: DataFrame, often: Broadcast, percent: int, k: int) -> DataFrame:
    """Per document: its set's size n, a 128-bit key of the set (k1, k2), its group and its prefix in order."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sizes, k1, k2, group, prefixes = [], [], [], [], []
                for own in shingle_sets(part.column("text"), k):
                    n = len(own)
                    p = prefix_length(n, percent) if n else 0
                    if n:
                        used = _uses(own, often)
                        rare = own[used == 0]
                        head = rare[:p] if len(rare) >= p else own[np.lexsort((own, used))][:p]
                        mixed = mix64(head * _KEY[0] + np.arange(p, dtype=np.uint64) * _KEY[1])
                        group.append(int(mix64(mixed.sum(keepdims=True) + np.full(1, n, np.uint64) * _KEY[2])[0].astype(np.int64)))
                        k1.append(int(mix64(own ^ _KEY[3]).sum().astype(np.int64)))
                        k2.append(int(mix64(own ^ _KEY[4]).sum().astype(np.int64)))
                        prefixes.append(head.astype("<u8").tobytes())
                    else:
                        group.append(0), k1.append(0), k2.append(0), prefixes.append(b"")
                    sizes.append(n)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(sizes, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "grp": pa.array(group, pa.int64()), "prefix": pa.array(prefixes, pa.binary())})

    return arrow_map(base.select("doc_id", "text"), describe, "doc_id long, n long, k1 long, k2 long, grp long, prefix binary")


def _possible(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Size and position bounds of two sets that share the prefix shingle at pa_ and pb."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-percent * (na + nb) // (100 + percent))
    return (100 * small >= percent * large) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def _pack(tables: list[np.ndarray]) -> bytes:
    return np.concatenate(tables).tobytes()


def posted(table: DataFrame, often: Broadcast, parts: int) -> DataFrame:
    """Prefix postings as packed blocks, one row for each task and part; a group posts once a task."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            split = 1 + _uses(rows["token"], often) // SPLIT_USES
            part_of = (rows["token"] >> np.uint64(32)).astype(np.int64) * parts >> 32
            part_of = (part_of + mix64(rows["group"].astype(np.uint64)).astype(np.int64) % split) % parts
            order = np.argsort(part_of, kind="stable")
            rows, part_of = rows[order], part_of[order]
            cut = np.searchsorted(part_of, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "block": pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())})

        for batch in batches:
            for group, n, prefix in zip(batch.column("grp").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                if not n or group in seen:
                    continue
                seen.add(group)
                tokens = np.frombuffer(prefix, "<u8")
                own = np.empty(len(tokens), _POSTING)
                own["token"], own["group"], own["n"], own["pos"] = tokens, group, n, np.minimum(np.arange(len(tokens)), 65535)
                held.append(own)
                size += len(own)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield flush()

    return arrow_map(table.select("grp", "n", "prefix"), post, "part int, block binary").repartitionById(parts, F.col("part"))


def paired(blocks: DataFrame, often: Broadcast, percent: int) -> DataFrame:
    """Group pairs (a, b) of short lists and of each long list's first group; long lists also whole, as packed rows."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(x, _POSTING) for batch in batches for x in batch.column("block").to_pylist()]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("list", pa.binary())])
        if not tables:
            return
        rows = np.concatenate(tables)
        del tables
        # the first of a list has the fewest shingles before this one, so it is the least edited of its kind
        order = np.lexsort((rows["group"], rows["pos"], rows["token"]))
        rows = rows[order]
        fresh = np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["group"][1:] != rows["group"][:-1]))
        rows = rows[fresh]
        heads = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
        sizes = np.diff(np.append(heads, len(rows)))
        # a shingle dealt to several tasks is a long list, whatever part of it is here
        long_ = np.flatnonzero((sizes > SMALL_LIST) | (_uses(rows["token"][heads], often) >= SPLIT_USES))
        group, n, pos = rows["group"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
        first, second = [], []
        for gap in range(1, SMALL_LIST):
            own = np.flatnonzero((sizes > gap) & (sizes <= SMALL_LIST))
            for at in range(SMALL_LIST - gap):
                i = heads[own[sizes[own] > gap + at]] + at
                first.append(i), second.append(i + gap)
        for x in long_[sizes[long_] > SMALL_LIST].tolist():
            first.append(np.full(sizes[x] - 1, heads[x])), second.append(np.arange(heads[x] + 1, heads[x] + sizes[x]))
        i, j = np.concatenate(first), np.concatenate(second)
        good = _possible(n[i], pos[i], n[j], pos[j], percent)
        x, y = group[i[good]], group[j[good]]
        pairs = np.unique(np.stack([x, y], 1), axis=0)
        none = len(pairs)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "token": pa.nulls(none, pa.int64()), "list": pa.nulls(none, pa.binary())}, schema)
        lo = 0
        while lo < len(long_):
            part = long_[lo : lo + 256]
            yield pa.RecordBatch.from_pydict({"a": pa.nulls(len(part), pa.int64()), "b": pa.nulls(len(part), pa.int64()), "token": pa.array(rows["token"][heads[part]].astype(np.int64), pa.int64()), "list": pa.array([rows[heads[x] : heads[x] + sizes[x]].tobytes() for x in part], pa.binary())}, schema)
            lo += 256

    return arrow_map(blocks.select("block"), pair, "a long, b long, token long, list binary")


def bit_signature(own: np.ndarray) -> bytes:
    """A bitmap of at least 4 bits for each hash: bit ``h mod m`` of a power of two m."""
    bits = 1 << max(6, int(4 * len(own) - 1).bit_length()) if len(own) else 64
    flags = np.zeros(bits, np.uint8)
    flags[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def most_common(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """An upper bound of two sets' intersection from their bitmaps (words of 64 bits).

    Each bit that only one of them has stands for an element that the other lacks.
    """
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def set_table(base: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The sets of the documents in ``ids``: (id, n, bits, hashes)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                own = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "n": pa.array([len(x) for x in own], pa.int64()), "bits": pa.array([bit_signature(x) for x in own], pa.binary()), "hashes": pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())})

    return arrow_map(restrict(base, ids, "doc_id").select("doc_id", "text"), sets, "id long, n long, bits binary, hashes binary")


def with_hubs(pairs: DataFrame, sets: DataFrame, column: str, linked: Callable[[int, Any, int, Any], bool], label: str, unpack: Callable[[bytes], Any] | None = None) -> DataFrame:
    """The pairs (a, b) for which ``linked`` holds of what ``column`` has for a and b (``unpack`` of it, if given).

    A hub's value travels once for each HUB_ROWS of its pairs, not with every pair.
    """
    hubs = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).alias("m")), f"{label}-hubs")
    seats = lookup_join(pairs, hubs, ["a"], "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).alias("seat"))
    centres = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("seat"))
    if pairs.count() <= BROADCAST_ROWS // 4:  # then the sets stay where they are until they go to their hub
        seats, centres = F.broadcast(seats), F.broadcast(centres)
    members = seats.join(sets.select(F.col("id").alias("b"), "n", column), "b").select("a", "seat", "b", "n", column)
    centres = centres.join(sets.select(F.col("id").alias("a"), "n", column), "a")
    rows = members.union(centres.select("a", "seat", F.lit(None).cast("long").alias("b"), "n", column))

    def check(table: pa.Table) -> pa.Table | None:
        names, n, own = table.column("b").to_pylist(), table.column("n").to_pylist(), table.column(column).to_pylist()
        made = unpack or (lambda x: x)
        hub = made(own[0])
        good = [x for x, size, raw in zip(names, n, own, strict=True) if x is not None and linked(n[0], hub, size, made(raw))]
        return pa.table({"a": pa.array([table.column("a")[0].as_py()] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return by_runs(rows, ["a", "seat"], [F.col("b").asc_nulls_first()], check, "a long, b long")


def verified_pairs(base: DataFrame, pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets reach the threshold.

    ``base`` has one row for each id that occurs.  Bitmaps of the sets rule out most pairs
    that do not link, and no others; the sets themselves are compared for those that are left.
    """
    ship_package(base.sparkSession)
    percent = round(100 * threshold)
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = materialize(set_table(base, ids, k), "sets")

    def enough(both: int, na: int, nb: int) -> bool:
        return both > 0 and 100 * both >= percent * (na + nb - both)

    def may(na: int, a: bytes, nb: int, b: bytes) -> bool:
        return enough(min(na, nb), na, nb) and enough(most_common(np.frombuffer(a, "<u8"), na, np.frombuffer(b, "<u8"), nb), na, nb)

    def does(na: int, a: bytes, nb: int, b: bytes) -> bool:
        small, large = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
        return enough(int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()), na, nb)

    possible = materialize(with_hubs(pairs, sets, "bits", may, "bits"), "possible")
    return with_hubs(possible, sets, "hashes", does, "sets")


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Group pairs as pairs of member documents, the smaller id first."""
    left, right = members.select(F.col("grp").alias("a"), F.col("rep").alias("x")), members.select(F.col("grp").alias("b"), F.col("rep").alias("y"))
    both = lookup_join(lookup_join(pairs, left, ["a"], "inner"), right, ["b"], "inner")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def jaccard_components(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= 100 * threshold * |union| of their sets.
    """
    spark = docs.sparkSession
    ship_package(spark)
    percent = round(100 * threshold)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    often = slot_uses(base, k)
    table = materialize(described(base, often, percent, k), "described")
    postings = table.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0))).first()[0]
    parts = max(shuffle_width(spark), int(postings * _POSTING.itemsize // TASK_BYTES) + 1)

    known = table.filter("n > 0 and doc_id is not null")
    members = materialize(known.groupBy("grp", "n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "members")
    met = materialize(paired(posted(known, often, parts), often, percent), "met")
    crowded = members.groupBy("grp").agg(F.count("*").alias("c"), F.min("rep").alias("least")).filter("c > 1").select("grp", "least")
    inner = materialize(members.join(crowded, "grp").filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")), "inner")
    wide = met.filter("list is null").select("a", "b").distinct()
    pairs = materialize(_expanded(wide, members).union(inner), "pairs")
    links = materialize(verified_pairs(base, pairs, threshold, k), "links")
    found = materialize(connected_components(links), "components")

    # second pass: what long lists and crowded groups hold in different components
    lists = met.filter("list is not null").select("token", "list")
    groups = members.select("grp", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("grp", "rep", F.coalesce("component", "rep").alias("component"))
    groups = materialize(groups, "groups")
    of_group = materialize(groups.groupBy("grp").agg(F.min("component").alias("c"), (F.min("component") != F.max("component")).alias("mixed")), "of_group")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, raw in zip(batch.column("token").to_pylist(), batch.column("list").to_pylist(), strict=True):
                rows = np.frombuffer(raw, _POSTING)
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.full(len(rows), token), pa.int64()), "grp": pa.array(rows["group"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "pos": pa.array(rows["pos"], pa.int64())})

    entries = lookup_join(arrow_map(lists, unpack, "token long, grp long, n long, pos long"), of_group, ["grp"], "inner")
    entries = materialize(entries, "entries")
    open_ = entries.groupBy("token").agg(F.count("*").alias("size"), (F.min("c") != F.max("c")).alias("several"), F.max("mixed").alias("mixed")).filter("several or mixed")
    open_ = materialize(open_.select("token", F.ceil(F.col("size") / BLOCK).alias("blocks")), "open")
    seated = lookup_join(entries, open_, ["token"], "inner").withColumn("row", F.pmod(F.xxhash64("grp"), F.col("blocks")))
    # block i meets block j >= i once: the row is sent to each (min, max) that it belongs to
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = seated.withColumn("other", other).select("token", F.least("row", "other").alias("i"), F.greatest("row", "other").alias("j"), "row", "grp", "n", "pos", "c", "mixed")

    def cross(part: pa.Table) -> pa.Table | None:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        row, group, n, pos, c, mixed = (part.column(x).to_numpy() for x in ("row", "grp", "n", "pos", "c", "mixed"))
        left, right = np.flatnonzero(row == i), np.flatnonzero(row == j)
        good = (c[left][:, None] != c[right]) | mixed[left][:, None] | mixed[right]
        if i == j:
            good &= left[:, None] < right
        x, y = np.nonzero(good)
        x, y = left[x], right[y]
        keep = _possible(n[x], pos[x], n[y], pos[y], percent)
        x, y = group[x[keep]], group[y[keep]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    crossing = by_runs(sent, ["token", "i", "j"], [], cross, "a long, b long").distinct()
    within = of_group.filter("mixed").select("grp").join(groups, "grp")
    within = within.alias("l").join(within.alias("r"), (F.col("l.grp") == F.col("r.grp")) & (F.col("l.component") != F.col("r.component")) & (F.col("l.rep") < F.col("r.rep"))).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    label = groups.select("rep", "component")
    left_over = _expanded(crossing, members).union(within).distinct()
    left_over = left_over.join(label.select(F.col("rep").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("rep").alias("b"), F.col("component").alias("cb")), "b").filter("ca <> cb").select("a", "b")
    left_over = materialize(left_over.join(pairs, ["a", "b"], "left_anti"), "left_over")
    if not left_over.isEmpty():
        more = materialize(verified_pairs(base, left_over, threshold, k), "links")
        # all links once more, so that each id has one label
        found = materialize(connected_components(links.union(more)), "components")
    final = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    final = materialize(final, "final")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    joined = table.select("doc_id", "n", "k1", "k2").join(final, ["k1", "k2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


@keeps_names
def one_of_each(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id.  Rows without an id stay.

    Different texts under one doc_id are documents of their own; of rows of equal id and text one stays.
    """
    keyed = row_keyed(docs)
    found = jaccard_components(keyed.withColumn("doc_id", F.col("_row")), threshold, k).filter("doc_id is not null").select("doc_id", "component_id")
    found = materialize(found, "found")
    ids = keyed.filter("_row is not null").select("_row", F.col("doc_id").cast("long").alias("id"))
    total, distinct, named = ids.agg(F.count("*"), F.countDistinct("_row"), F.countDistinct("id")).first()
    if total == named:
        gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    else:
        own = found.distinct().join(ids.distinct(), F.col("doc_id") == F.col("_row")).select("component_id", "_row", "id")
        own = materialize(own, "own")
        stays = own.groupBy("component_id").agg(F.min(F.struct("id", "_row")).alias("least"))
        gone = own.join(stays, "component_id").filter("_row <> least._row").select("_row")
    gone = materialize(gone, "gone")
    kept = restrict(keyed, gone, "_row", "left_anti", BROADCAST_ROWS)
    if total != distinct:
        kept = kept.filter("_row is not null").dropDuplicates(["_row"]).unionByName(kept.filter("_row is null"))
    return kept.select(*docs.columns)
