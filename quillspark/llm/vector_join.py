"""Operator 6: near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most ``r = sqrt(2 - 2 c)``.
Each label has pivots of its own, from a bounded sample; a vector's home is the cell of its
nearest pivot.  How much nearer x is to its home's pivot h than to p, taken as its distance
from the plane half way between them, ``(x h - x p) / |h - p|``, changes by at most the
distance from x to y when x becomes y (the triangle inequality), and is not above 0 for the
vectors of cell p.  So x has partners there only if it is at most r, and to those cells, of
higher number than its own, x is sent as a visitor.  Each cell then joins its own vectors
with each other and with its visitors, independently of all other cells.  Cells are cut
into blocks, so that no task sees more than two of them, and a task returns link counts
and the edges of a spanning forest, never all pairs.

How many pivots a label gets is measured: on the sample, cells and visitors are counted for
4, 16, 64 and more pivots, and the number is taken whose comparisons and copies cost least.

Pivots change the cost only: whatever they are, every pair is met exactly once, and its
cosine is computed in double precision.

Cases: vectors that are null, zero, of another length than their partner's, or hold null
or non-finite components link with nothing, as do rows with a null label; rows of one vec_id are
one vector, the usable one that sorts first; a row without a vec_id links with nothing and is
returned with a null component, not kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_runs, connected_components, lookup_join, materialize, ship_package

#: Vectors sampled for pivots (the number of pivots is below this, whatever the input), vectors in a block, rows compared at once.
SAMPLE, BLOCK, ROWS = 50_000, 4096, 512
#: Fewest pivots of a label, vectors of a label for each pivot, and what a copy of a vector costs in comparisons.
LEAST_PIVOTS, VECTORS_EACH, COPY = 4, 256, 500
#: Slack for rounding in bounds that only decide where a vector is sent.
_SLACK = 1e-6

def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, dims, unit): the double precision unit vectors, packed, of rows that can link."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims, out = [], [], [], []
            for vec_id, label, raw in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                values = raw.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not (top := np.abs(x).max()):
                    continue
                x = x / top
                ids.append(vec_id), labels.append(label), dims.append(len(x)), out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.string()), "dims": pa.array(dims, pa.int32()), "unit": pa.array(out, pa.binary())})

    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return arrow_map(rows, normalise, "vec_id long, label string, dims int, unit binary")


def routes(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each row of ``x``, and the visits (row, cell) that it makes."""
    dots = x @ pivots.T
    home = dots.argmax(1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-24))
    goes = (dots[np.arange(len(x)), home][:, None] - dots) / between[home] <= reach
    goes &= np.arange(len(pivots)) > home[:, None]
    return home, *np.nonzero(goes)


def far_points(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x``, each the farthest from those before it; fewer if all others are copies."""
    picked, gap = [0], np.full(len(x), np.inf)
    while len(picked) < count:
        gap = np.minimum(gap, 2 - 2 * x @ x[picked[-1]])
        if gap.max() <= 1e-12:
            break
        picked.append(int(gap.argmax()))
    return np.array(picked)


def cheapest(x: np.ndarray, total: int, reach: float) -> np.ndarray:
    """Pivots for a label of ``total`` vectors of which ``x`` is a sample."""
    most = max(1, min(len(x) // 4, total // VECTORS_EACH), min(LEAST_PIVOTS, len(x) // 8))
    order = far_points(x, most)
    best, least, size = order[:1], np.inf, LEAST_PIVOTS
    while True:
        pivots = order[:size]
        home, _, cell = routes(x, x[pivots], reach)
        own, guests = np.bincount(home, minlength=len(pivots)) / len(x), np.bincount(cell, minlength=len(pivots)) / len(x)
        cost = total**2 * float((own * own / 2 + own * guests).sum()) + COPY * total * (1 + float(guests.sum()))
        if cost < least:
            best, least = pivots, cost
        if size >= len(order):
            return x[best]
        size *= 4


def choose_pivots(units: DataFrame, reach: float, sample: int = SAMPLE) -> dict[tuple[str, int], np.ndarray]:
    """Pivots for each label and vector length of a sample of at most ``sample`` vectors (those of smallest hash)."""
    drawn = materialize(units.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select("label", "dims", "unit"), "drawn")
    counts = units.groupBy("label", "dims").count().join(F.broadcast(drawn.select("label", "dims").distinct()), ["label", "dims"]).collect()  # at most one row for each of the sample
    total = {(r["label"], r["dims"]): r["count"] for r in counts}
    out = {}
    for key, own in drawn.toPandas().groupby(["label", "dims"]):
        out[key[0], int(key[1])] = cheapest(np.stack([np.frombuffer(u) for u in own.sort_values("unit")["unit"]]), total[key], reach)
    return out


def range_links(vectors: DataFrame, cosine: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) of vectors with links, and edges (a, b) that connect what is linked."""
    ship_package(vectors.sparkSession)
    units = materialize(usable(vectors), "units")
    total, ids = units.agg(F.count("*"), F.countDistinct("vec_id")).first()
    if total != ids:
        units = materialize(units.groupBy("vec_id").agg(F.min(F.struct("label", "dims", "unit")).alias("v")).select("vec_id", "v.*"), "units")
    reach = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    pivots = vectors.sparkSession.sparkContext.broadcast(choose_pivots(units, reach))  # at most SAMPLE vectors

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist(), strict=True))
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            raw = batch.column("unit").to_pylist()
            rows, cells, guests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, at in places.items():
                own = np.array(at)
                home, i, cell = np.zeros(len(own), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if key in pivots.value:
                    home, i, cell = routes(np.stack([np.frombuffer(raw[j]) for j in at]), pivots.value[key], reach)
                rows += [own, own[i]]
                cells += [home, cell]
                guests += [np.zeros(len(own), np.int64), np.ones(len(i), np.int64)]
            taken = np.concatenate(rows)
            for lo in range(0, len(taken), 4096):
                part = slice(lo, lo + 4096)
                out = batch.take(pa.array(taken[part]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells)[part], pa.int32()), pa.array(np.concatenate(guests)[part], pa.int32())], [*out.schema.names, "cell", "guest"])

    sent = materialize(arrow_map(units, send, "vec_id long, label string, dims int, unit binary, cell int, guest int"), "sent")
    room = F.xxhash64("label", "dims", "cell").alias("room")
    sent = sent.withColumn("room", room)
    blocks = sent.groupBy("room", "guest").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    shape = blocks.groupBy("room").agg(F.max(F.when(F.col("guest") == 0, F.col("m"))).alias("own"), F.coalesce(F.max(F.when(F.col("guest") == 1, F.col("m"))), F.lit(0)).alias("guests")).filter("own is not null")
    seated = lookup_join(sent, materialize(shape, "shape"), ["room"], "inner")
    own_block = F.pmod(F.xxhash64("vec_id"), F.when(F.col("guest") == 0, F.col("own")).otherwise(F.col("guests"))).cast("int")
    seated = seated.withColumn("block", own_block)
    # tables of a task: home block i with home block j >= i (table -1 - i * own - j), or with guest block g (table i * guests + g)
    homes_ = F.sequence(F.lit(0), (F.col("own") - 1).cast("int"))
    among = F.transform(homes_, lambda j: (-1 - F.least(F.col("block"), j) * F.col("own") - F.greatest(F.col("block"), j)).cast("long"))
    hosting = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), (F.greatest("guests", F.lit(1)) - 1).cast("int")), lambda g: (F.col("block") * F.col("guests") + g).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    visiting = F.transform(homes_, lambda i: (i * F.col("guests") + F.col("block")).cast("long"))
    tasks = seated.withColumn("task", F.explode(F.when(F.col("guest") == 0, F.concat(among, hosting)).otherwise(visiting)))
    tasks = tasks.withColumn("side", F.when(F.col("guest") == 1, F.lit(-1)).otherwise(F.col("block"))).select("room", "task", "side", "own", "vec_id", "unit")

    def meet(table: pa.Table) -> pa.Table | None:
        who = table.column("vec_id").to_numpy()
        x = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
        side = table.column("side").to_numpy()
        if (side == -1).any() or table.column("task")[0].as_py() >= 0:
            left, right, same = np.flatnonzero(side != -1), np.flatnonzero(side == -1), False
        else:
            blocks_ = np.unique(side)
            left, right, same = np.flatnonzero(side == blocks_[0]), np.flatnonzero(side == blocks_[-1]), len(blocks_) == 1
            if same:
                # a pair of different blocks of which one is empty here: those meet in a task of their own
                pair = -1 - table.column("task")[0].as_py()
                if pair != blocks_[0] * table.column("own")[0].as_py() + blocks_[0]:
                    return None
        if not len(left) or not len(right):
            return None
        links = np.zeros(len(who), np.int64)
        found = []
        for lo in range(0, len(left), ROWS):
            some = left[lo : lo + ROWS]
            i, j = np.nonzero(x[some] @ x[right].T >= cosine)
            i, j = some[i], right[j]
            if same:
                i, j = i[i != j], j[i != j]
            links += np.bincount(i, minlength=len(who))
            if not same:
                links += np.bincount(j, minlength=len(who))
            found.append(np.stack(_forest(len(who), i, j)))
        i, j = np.concatenate(found, 1)
        a, b = _forest(len(who), i, j)
        some = np.flatnonzero(links)
        pad = pa.nulls(len(some), pa.int64())
        return pa.table({"vec_id": pa.array(np.concatenate([who[some], who[a]]), pa.int64()), "n": pa.chunked_array([pa.array(links[some], pa.int64()), pa.nulls(len(a), pa.int64())]), "other": pa.chunked_array([pad, pa.array(who[b], pa.int64())])})

    met = materialize(by_runs(tasks, ["room", "task"], [], meet, "vec_id long, n long, other long"), "met")
    return met.filter("n is not null").groupBy("vec_id").agg(F.sum("n").alias("n_links")), met.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")).distinct()


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` points that is linked, an edge to the smallest point of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = np.flatnonzero(label != np.arange(n))
    return label[off], off


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    counts, edges = range_links(vectors, cosine)
    labels = materialize(connected_components(materialize(edges, "edges")), "labels").withColumnRenamed("id", "vec_id")
    found = materialize(labels.join(counts, "vec_id"), "found")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    ids = ids.filter("vec_id is not null").distinct().union(ids.filter("vec_id is null"))
    out = lookup_join(ids, found, ["vec_id"])
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
