"""Operator 2: MinHash fingerprints of word shingles.

A fingerprint holds, for each of ``perms`` universal hash permutations
``x -> (a * x + b) mod 2**32`` (a odd), the smallest image of the text's shingle
hashes; the share of equal places estimates the Jaccard similarity.  All of it is
vectorised numpy over Arrow buffers.

Cases: null text is empty; a text without words has the fingerprint of the empty set,
which equals that of any other such text; texts of one to four words are one shingle;
documents of equal id are ordered by a hash of their text; null ids come last in descending order;
repeated rows are returned one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bucket_column, by_runs, connected_components, drop_table, lookup_join, materialize, order_key, range_bounds, release, restrict, ship_package, shuffle_width, text_or_empty
from .ngram_join import BLOCK, with_hubs
from .shingles import mix64, shingle_rows, shingle_sets, stream64

#: Permutations in a fingerprint; the standard error of an estimate J is sqrt(J (1 - J) / PERMS).
PERMS = 128
#: Bands of a fingerprint for candidate search, each of PERMS // BANDS places: of pairs at 0.8, 5 in 100,000 share none.
BANDS = 25
#: Bands of more classes than this are gone through where their texts meet, without making pairs.
CROWD = 32
#: Standard errors of an estimate by which a pair of the second pass may fall short.
SPREAD = 3.5
#: What :func:`banded_duplicates` tells of a row.
LABELS = ("component_id", "n_shared_bands")


def signatures(column: pa.Array, perms: int = PERMS, k: int = 5) -> np.ndarray:
    """One row of ``perms`` minima (uint32) for each text; texts without words get all ones."""
    a = (stream64(perms, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (stream64(perms, 12) >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(column), perms), 0xFFFFFFFF, np.uint32)
    for row, hashes, count in shingle_rows(column, k):
        some = np.flatnonzero(count)
        if not len(some):
            continue
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        begin = (np.cumsum(count) - count)[some]
        image = np.empty_like(x)
        for p in range(perms):
            np.multiply(x, a[p], out=image)
            np.add(image, b[p], out=image)
            out[row + some, p] = np.minimum.reduceat(image, begin)
    return out


def hex_rows(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u4").tobytes().hex()
    step = 8 * signature.shape[1]
    return [raw[i * step : (i + 1) * step] for i in range(len(signature))]


def edited_fingerprints(docs: DataFrame, labels: DataFrame | None = None, perms: int = PERMS, k: int = 5) -> DataFrame:
    """Fingerprints of each text and of its edited text, in descending order of doc_id.

    The edited text is the text with its last ``floor(n_chars / 3)`` code points replaced by
    the first as many of the next document (after the last: the first).  The texts move
    once, to ranges of ids; each range also gets a copy of the first document of the range
    after it, which its last document needs.  ``labels``, of :func:`banded_duplicates`, go to
    the same ranges in the same order, so that they need no join.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), order_key().alias("k"))
    bounds = range_bounds(base.select("k"), "k", shuffle_width(spark))
    placed = base.withColumn("h", F.xxhash64("text")).withColumn("b", bucket_column(bounds, F.col("k"), F.col("h")))
    heads = {r["b"]: r["k"] for r in placed.groupBy("b").agg(F.max(F.struct("k", "h")).alias("k")).collect()}  # one row for each range
    order = sorted(heads, reverse=True)
    guests = [(heads[b]["k"], heads[b]["h"], order[i - 1]) for i, b in enumerate(order)]  # the first range's head goes to the last range
    rooms = F.create_map(*[F.lit(x) for k, h, to in guests for x in (f"{k} {h}", to)]) if guests else F.lit(None).cast("map<string,int>")
    heads_k = sorted({g[0] for g in guests})
    room = F.when(F.col("k").isin(heads_k), F.element_at(rooms, F.concat_ws(" ", "k", "h"))) if guests else F.lit(None).cast("int")

    targets = F.when(F.col("g").isNotNull(), F.array("b", "g")).otherwise(F.array("b"))
    dealt = placed.withColumn("g", room).select("doc_id", "text", "k", "h", F.posexplode(targets).alias("guest", "to"), *[F.lit(None).cast("long").alias(c) for c in LABELS])
    if labels is not None:
        told = labels.select("doc_id", F.lit(None).cast("string").alias("text"), order_key().alias("k"), "h", F.lit(-1).alias("guest"), *LABELS)
        dealt = dealt.unionByName(told.withColumn("to", bucket_column(bounds, F.col("k"), F.col("h"))))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("to")).sortWithinPartitions("guest", F.col("k").desc(), F.col("h").desc(), "text").select("doc_id", "text", "guest", *LABELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        told: list[pa.RecordBatch] = []
        at = 0
        for batch in batches:
            own = pc.greater_equal(batch.column("guest"), 0)
            if told or not pc.all(own).as_py():
                told.append(batch.select(list(LABELS)).filter(pc.invert(own)))
                batch = batch.filter(own)
            for lo in range(0, batch.num_rows, 512):
                if lo == 0:
                    table = pa.Table.from_batches(told) if told else None
                part = batch.slice(lo, 512)
                signed = signatures(part.column("text"), perms, k)
                ids, texts, guest = part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("guest").to_pylist()
                if held:
                    ids, texts, guest, signed = [held[0], *ids], [held[1], *texts], [held[2], *guest], np.concatenate([held[3], signed])
                held = (ids[-1], texts[-1], guest[-1], signed[-1:])
                stop = guest.index(1) if 1 in guest else len(ids) - 1
                stop = min(stop, len(ids) - 1)
                if stop <= 0:
                    continue
                edited = []
                for i in range(stop):
                    cut = len(texts[i]) // 3
                    edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
                edited_signed = signatures(pa.array(edited, pa.large_string()), perms, k)
                own_labels = {c: table.column(c).slice(at, stop).combine_chunks() if table else pa.nulls(stop, pa.int64()) for c in LABELS}
                at += stop
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[:stop], pa.int64()), "n_chars": pa.array([len(x) for x in texts[:stop]], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited]),
                    "fingerprint": pa.array(hex_rows(signed[:stop])), "edited_fingerprint": pa.array(hex_rows(edited_signed)),
                    "near_edited": pa.array((signed[:stop] == edited_signed).mean(1)), "near_next": pa.array((signed[:stop] == signed[1 : stop + 1]).mean(1)), **own_labels,
                })

    return arrow_map(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, " + ", ".join(f"{c} long" for c in LABELS))


def banded_duplicates(docs: DataFrame, threshold: float = 0.8, perms: int = PERMS, bands: int = BANDS, k: int = 5, spread: float | None = SPREAD) -> DataFrame:
    """Near duplicates by banding: per row doc_id, h (a hash of its text), component_id (the smallest doc_id linked to it), n_shared_bands.

    Texts of equal fingerprint form a class.  Classes that agree in a band meet there and are
    linked if the true Jaccard similarity of their shingle sets reaches ``threshold``.  First
    each is compared with the band's smallest member; when those links are components, a second
    pass compares what the band still holds in different components, block by block: by estimates
    from the fingerprints, so that texts that only share a passage are not paired, then by their
    sets; in a crowded band the likeliest pair first, and none whose components have met.  With
    ``spread`` None no pair is passed over by its estimate, so that every pair that meets in a band and
    is still apart is compared by its sets.  A class goes by a hash of one of its rows.  ``n_shared_bands`` is the number of
    a class's bands that other classes have too.  Rows without an id, and texts without words, link with nothing.
    """
    ship_package(docs.sparkSession)
    rows = perms // bands
    turn = stream64(rows, 13) | np.uint64(1)
    salt = stream64(bands, 14)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = signatures(batch.column("text"), perms, k)
            empty = pa.array((signed == 0xFFFFFFFF).all(1))
            names = mix64((signed[:, : bands * rows].reshape(len(signed), bands, rows).astype(np.uint64) * turn).sum(2, dtype=np.uint64) + salt)
            cuts = pa.array(np.arange(len(signed) + 1, dtype=np.int32) * bands)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in signed]
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            low = (signed & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "h", "row")}, "sketch": pa.array([x.tobytes() for x in low], pa.binary()), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "empty": empty, "bands": pa.ListArray.from_arrays(cuts, pa.array(names.ravel().view(np.int64)))})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = materialize(arrow_map(base, sign, "doc_id long, h long, row long, sketch binary, k1 long, k2 long, empty boolean, bands array<long>"), "signed")
    classes = signed.filter("not empty and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    classes = materialize(classes.select("k1", "k2", F.col("r.row").alias("c"), F.col("r.doc_id").alias("least"), "bands", "sketch"), "classes")
    bands_of = classes.select("c", F.explode("bands").alias("band"))
    leaders = materialize(bands_of.groupBy("band").agg(F.min("c").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a"), "leaders")
    shared = materialize(lookup_join(bands_of, leaders, ["band"], "inner"), "shared")
    pairs = materialize(shared.filter("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct(), "pairs")
    links = materialize(_verified(base, pairs, threshold, k), "links")
    found = materialize(connected_components(links), "components")

    # second pass: what a band holds in different components; a pair goes on if the low bytes of its fingerprints agree
    # as often as those of a likeness at the threshold do, less ``spread`` standard errors
    plausible = 0.0 if spread is None else threshold - spread * (threshold * (1 - threshold) / perms) ** 0.5
    entries = lookup_join(shared.select("band", "c"), found.select(F.col("id").alias("c"), "component"), ["c"]).withColumn("component", F.coalesce("component", "c"))
    entries = materialize(entries, "entries")
    open_ = entries.groupBy("band").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks"), (F.min("component") != F.max("component")).alias("several")).filter("several")
    open_ = materialize(open_.select("band", "n", "blocks"), "open")
    seated = lookup_join(entries, open_, ["band"], "inner").withColumn("seat", F.pmod(F.xxhash64("c"), F.col("blocks"))).join(classes.select("c", "sketch"), "c")
    seated = materialize(seated, "seated")
    # block i meets block j >= i once: the row is sent to each (min, max) that it belongs to
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["band", F.least("seat", "other").alias("i"), F.greatest("seat", "other").alias("j"), "seat", "c", "component", "sketch"]
    few = seated.filter(F.col("n") <= CROWD).withColumn("other", other).select(*columns)
    crowd = seated.filter(F.col("n") > CROWD)

    def likely(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of different components that may be alike enough, the likeliest first."""
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        seat, component = part.column("seat").to_numpy(), part.column("component").to_numpy()
        left, right = np.flatnonzero(seat == i), np.flatnonzero(seat == j)
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, perms)
        found = [(left[:0], right[:0], np.zeros(0))]
        for lo in range(0, len(left), 64):
            some = left[lo : lo + 64]
            alike = (sketch[some][:, None] == sketch[right]).mean(2)
            good = (alike >= plausible) & (component[some][:, None] != component[right])
            if i == j:
                good &= some[:, None] < right
            x, y = np.nonzero(good)
            found.append((some[x], right[y], alike[x, y]))
        x, y, likeness = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.argsort(-likeness, kind="stable")
        return x[order], y[order]

    def cross(part: pa.Table) -> pa.Table | None:
        x, y = likely(part)
        c = part.column("c").to_numpy()
        return pa.table({"a": pa.array(np.minimum(c[x], c[y]), pa.int64()), "b": pa.array(np.maximum(c[x], c[y]), pa.int64())})

    def meet(part: pa.Table) -> pa.Table | None:
        """Links between components of a crowd, found where its texts meet; no pair of one component is compared again."""
        x, y = likely(part)
        c, raw = part.column("c").to_numpy(), part.column("packed")
        up = {v: v for v in part.column("component").to_pylist()}
        at = part.column("component").to_pylist()
        sets: dict[int, np.ndarray] = {}

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _unpacked(raw[i].as_py(), k)
            return sets[i]

        a, b = [], []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = root(at[i]), root(at[j])
            if p != q and _alike(own(i), own(j), percent):
                a.append(c[i]), b.append(c[j])
                up[p] = q
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    percent = round(100 * threshold)
    left_over = by_runs(few, ["band", "i", "j"], [], cross, "a long, b long").distinct()
    left_over = materialize(left_over.join(pairs, ["a", "b"], "left_anti"), "left_over")
    members = materialize(crowd.select("c").distinct(), "members")
    held = crowd.join(_packed_texts(base, members).select(F.col("id").alias("c"), "packed"), "c").withColumn("other", other).select(*columns, "packed")
    more = materialize(by_runs(held, ["band", "i", "j"], [], meet, "a long, b long").distinct(), "more")
    if not more.isEmpty():
        links = materialize(links.union(more), "links")
        found = materialize(connected_components(links), "components")
    if not left_over.isEmpty():
        more = materialize(_verified(base, left_over, threshold, k), "links")
        # all links once more, so that each id has one label
        found = materialize(connected_components(links.union(more)), "components")
    met = shared.groupBy("c").agg(F.count("*").alias("n_shared_bands"))
    grouped = classes.drop("bands", "sketch").join(found.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    grouped = materialize(grouped.join(met, "c", "left"), "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    told = materialize(grouped.join(least, "component").select("k1", "k2", "component_id", F.coalesce("n_shared_bands", F.lit(0).cast("long")).alias("n_shared_bands")), "told")
    out = lookup_join(signed.drop("bands", "sketch"), told, ["k1", "k2"])
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(~F.col("empty"), F.col("component_id")), F.col("doc_id")))
    alone = F.col("doc_id").isNull() | F.col("empty")
    labels = materialize(out.select("doc_id", "h", own.alias("component_id"), F.when(alone, 0).otherwise(F.col("n_shared_bands")).cast("long").alias("n_shared_bands")), "labels")
    for table in (signed, classes, leaders, shared, pairs, links, found, entries, open_, seated, left_over, more, grouped, told):
        drop_table(table)
    release(docs.sparkSession)
    return labels


def _packed_texts(base: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, n, packed): the compressed texts of the rows whose hashes are in the one-column table ``rows``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [squeeze.compress(x.encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("row"), "n": pa.array([0] * len(texts), pa.int64()), "packed": pa.array(texts, pa.binary())})

    return arrow_map(restrict(base, rows, "row").select("row", "text"), pack, "id long, n long, packed binary")


def _unpacked(raw: bytes, k: int) -> np.ndarray:
    """The shingle set of a compressed text."""
    return shingle_sets(pa.array([zstandard.ZstdDecompressor().decompress(raw).decode()], pa.large_string()), k)[0]


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _verified(base: DataFrame, pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) of row hashes whose texts reach the threshold; the texts travel compressed, their sets are made where they meet."""
    percent = round(100 * threshold)
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    return with_hubs(pairs, _packed_texts(base, ids), "packed", lambda _, a, __, b: _alike(a, b, percent), "texts", lambda raw: _unpacked(raw, k)).distinct()
