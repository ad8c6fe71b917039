"""Token lists turned into postings inside each row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.batches import pieces


def inverted(fields: tuple[str, ...], bounds: list[str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, doc_id, field, positions, length) from token lists; an empty term stands for the document itself.

    With ``bounds``, terms in order, also the ``range`` of each row, from 0; rows of a term that is a bound are spread over the ranges it may lie in.
    """

    def ranges(terms: pa.Array, which: np.ndarray, row: np.ndarray) -> list[pa.Array]:
        if bounds is None:
            return []
        own, at = np.array(terms.to_pylist(), object), np.array(bounds, object)
        low, high = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
        return [pa.array((low[which] + row % (high - low + 1)[which]).astype(np.int32))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "doc_id", "field", "positions", "length"] + (["range"] if bounds is not None else [])
        for batch in pieces(batches, fields):
            n, ids, none = batch.num_rows, batch.column("doc_id"), np.zeros(0, np.int32)
            counts = {f: pc.list_value_length(batch.column(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields}
            length = sum(counts.values(), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.repeat("", n), ids, pa.repeat("", n), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array(none)), pa.array(length), *ranges(pa.array([""]), np.zeros(n, np.int64), np.arange(n))], names)
            for field in fields:
                terms = pc.list_flatten(batch.column(field)).dictionary_encode()
                if not len(terms):
                    continue
                row = np.repeat(np.arange(n), counts[field])
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts[field]) - counts[field], counts[field])
                code = terms.indices.to_numpy().astype(np.int64)
                key = row * len(terms.dictionary) + code
                order = np.argsort(key, kind="stable")
                first = np.append(0, np.flatnonzero(np.diff(key[order])) + 1)
                at, offsets = order[first], np.append(first, len(order)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[at])), ids.take(pa.array(row[at])), pa.repeat(field, len(at)), lists, pa.array(length[row[at]]), *ranges(terms.dictionary, code[at], row[at])], names)

    return run
