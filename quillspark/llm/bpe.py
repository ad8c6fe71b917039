"""Batch encoding with a public tokenizer file, remembering the ids of pieces already seen.

A text is cut where every pre-tokenizer used here is sure to cut too: before white
space that follows something else, and between a Latin letter and an ASCII character
that is no letter.  Pieces are hashed in numpy; ids of known pieces come from a table,
unknown ones are encoded by the tokenizers library.  Texts with rarer white space or
with the string of a special token go to the library whole.  The result is exactly
that of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .shingles import _SPACE, _STEP, _slices, mix64, stream64, string_bytes

#: Pieces remembered in a worker before the table starts afresh.
PIECES = 1_000_000
_JOIN = 20_000

_RAW = stream64(256, 3)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER_ASCII = np.zeros(256, bool)
_OTHER_ASCII[:128] = ~_LETTER[:128]
_ODD_CONTROL = np.zeros(256, bool)
_ODD_CONTROL[0x1C:0x20] = True
#: Bytes of pieces hashed in one go, whatever the length of a text.
_HASHED = 1 << 20
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PROBES = [" a", "b", " hello", "Tokens", " Zebra", "xqzjv", " internationalisation", " \u00e9t\u00e9", "\u00dcber\u00df\u00ff"]
#: How byte-level models write bytes: those that Latin-1 prints as themselves, the others, in order, from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


def _as_bytes(text: str) -> str:
    return text.encode().decode("latin-1").translate(_WRITTEN)


def _as_lower_bytes(text: str) -> str:
    return _as_bytes(text.replace(" ", "").lower())


def _all_letters(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which pieces are Latin letters (of ASCII, or U+00C0 to U+00FF without the two signs), after at most one blank."""
    good = _LETTER[text]
    lead = np.flatnonzero(text[:-1] == 0xC3)
    lead = lead[(text[lead + 1] != 0x97) & (text[lead + 1] != 0xB7)]
    good[lead] = good[lead + 1] = True
    other = np.append(0, np.cumsum(~good))
    begin = begin + (text[begin] == 32)
    return (begin < end) & (other[end] == other[begin])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = _powers(_STEP, _HASHED), _powers(_BACK, _HASHED)


def _piece_keys(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each piece: differences of running sums of bytes times powers, moved to power 0."""
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        first = int(begin[lo])
        hi = max(int(np.searchsorted(end, first + _HASHED, "right")), lo + 1)
        last = int(end[hi - 1])
        up, down = _POWERS if last - first <= _HASHED else (_powers(_STEP, last - first), _powers(_BACK, last - first))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_RAW[text[first:last]] * up[: last - first], out=sums[1:])
        b, e = begin[lo:hi] - first, end[lo:hi] - first
        out[lo:hi] = mix64((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _STEP)
        lo = hi
    out[out == 0] = 1
    return out


class PieceTable:
    """Open-addressing hash table from 64-bit piece hashes to runs of token ids."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.size = 1 << int(np.ceil(np.log2(max(most, 8) * 2)))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.size, np.uint64)
        self.entry = np.zeros(self.size, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where a key is unknown."""
        mask = np.uint64(self.size - 1)
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys & mask).astype(np.int64)
        own = keys
        while len(left):
            there = self.keys[slot]
            hit = there == own
            out[left[hit]] = self.entry[slot[hit]]
            go = np.flatnonzero(~hit & (there != 0))
            left, own, slot = left[go], own[go], (slot[go] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct unknown keys; ``ids`` holds their runs one after the other."""
        while self.n + len(keys) > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.begin[number] = self.used + np.cumsum(lengths) - lengths
        self.length[number] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        slot, left = (keys & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == 0
            tried = np.flatnonzero(free)
            _, first = np.unique(slot[tried], return_index=True)
            won = tried[first]
            self.keys[slot[won]] = keys[left[won]]
            self.entry[slot[won]] = number[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], slot[lost]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + 1) & (self.size - 1), slot)


class PieceEncoder:
    """Encodes Arrow string columns with the tokenizer file at ``path``."""

    def __init__(self, path: str, pieces: int = PIECES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [x for _, x in sorted(self.tokenizer.get_added_tokens_decoder().items()) if x.content]
        self.special = [x.content.encode() for x in special]
        separators = [x for x in special if x.special and not x.lstrip and not x.rstrip and not x.single_word]
        self.separator = separators[-1].content if separators else None
        self.separator_id = self.tokenizer.token_to_id(self.separator) if separators else -1
        #: White space belongs to the piece after it, or is dropped by the tokenizer.
        self.spaces_matter = self.tokenizer.normalizer is None
        self.size = self.tokenizer.get_vocab_size(True)
        self.table = PieceTable(pieces)
        self.plain = next((f for f in (_as_bytes, _as_lower_bytes) if self._agrees(f)), None)

    def _agrees(self, written: Callable[[str], str]) -> bool:
        """Whether the library's model, given pieces of letters so written, answers as the whole tokenizer does."""
        whole = self.tokenizer.encode_batch_fast(_PROBES, add_special_tokens=False)
        return all([t.id for t in self.tokenizer.model.tokenize(written(x))] == y.ids for x, y in zip(_PROBES, whole, strict=True))

    def _slow_rows(self, text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Rows that go to the library whole."""
        slow = np.zeros(len(cuts) - 1, bool)
        where = [np.flatnonzero(_ODD_CONTROL[text])]
        high = np.flatnonzero((text >= 0xC2) & (text <= 0xE3))
        if len(high):
            padded = np.append(text, np.zeros(2, np.uint8))
            a, b, c = text[high], padded[high + 1], padded[high + 2]
            odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            where.append(high[odd])
        raw = text.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                where.append(np.array([at]))
                at = raw.find(token, at + 1)
        at = np.concatenate(where)
        if len(at):
            slow[np.searchsorted(cuts, at, "right") - 1] = True
        return slow

    def _pieces(self, text: np.ndarray, cuts: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece."""
        n = len(text)
        space = _SPACE[text]
        letter = _LETTER[text]
        tail = np.flatnonzero(text[:-1] == 0xC3) + 1
        letter[tail[(text[tail] != 0x97) & (text[tail] != 0xB7)]] = True
        begins = np.zeros(n, bool)
        begins[1:] = letter[:-1] & _OTHER_ASCII[text[1:]]
        if self.spaces_matter:
            begins[1:] |= space[1:] & ~space[:-1]
        else:
            begins[1:] |= space[:-1]
            begins &= ~space
        heads = cuts[:-1][cuts[:-1] < cuts[1:]]
        for row in np.flatnonzero(slow):
            begins[cuts[row] : cuts[row + 1]] = False
        if self.spaces_matter:
            begins[heads] = True
            start = np.flatnonzero(begins)
            return start, np.append(start[1:], n)
        begins[heads] |= ~space[heads]
        whole = cuts[:-1][slow]
        begins[whole] = True
        start = np.flatnonzero(begins)
        stops = np.zeros(n + 1, bool)
        stops[:-1] = begins
        stops[1:-1] |= space[1:] & ~space[:-1]
        stops[cuts] = True
        for row in np.flatnonzero(slow):
            stops[cuts[row] + 1 : cuts[row + 1]] = False
        stop = np.flatnonzero(stops)
        return start, stop[np.searchsorted(stop, start, "right")]

    def _learn(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, alone: np.ndarray) -> None:
        """Encodes pieces by the library: letters by its model alone, others joined by a special token, the rest one by one."""
        raw = text.tobytes()
        cuts = list(zip(begin.tolist(), end.tolist(), strict=True))
        runs: list[list[int]] = [[]] * len(keys)
        plain = _all_letters(text, begin, end) & ~alone if self.plain is not None else np.zeros(len(keys), bool)
        letters, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        if letters:
            tokenize = self.tokenizer.model.tokenize
            for i, written in zip(letters, self.plain("~".join([raw[b:e].decode() for b, e in map(cuts.__getitem__, letters)])).split("~"), strict=True):
                runs[i] = [t.id for t in tokenize(written)]
        texts = {i: raw[cuts[i][0] : cuts[i][1]].decode("utf-8") for i in rest}
        joined = [i for i in rest if self.separator and not alone[i]]
        for lo in range(0, len(joined), _JOIN):
            part = joined[lo : lo + _JOIN]
            ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join([texts[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator_id)
            if len(cut) != len(part) - 1:
                raise ValueError("the tokenizer does not keep its special token apart")
            for i, b, e in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                runs[i] = ids[b:e].tolist()
        single = [i for i in rest if not self.separator or alone[i]]
        for i, x in zip(single, self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
            runs[i] = x.ids
        self.table.add(keys, np.fromiter(map(len, runs), np.int64, len(runs)), np.fromiter(itertools.chain.from_iterable(runs), np.uint32))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other (uint32), and the number of ids of each row; nulls are empty."""
        data, offsets = string_bytes(column)
        all_ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in _slices(offsets):
            base = int(offsets[lo])
            text, cuts = data[base : int(offsets[hi])], offsets[lo : hi + 1] - base
            if not len(text):
                counts.append(np.zeros(hi - lo, np.int64))
                continue
            slow = self._slow_rows(text, cuts)
            begin, end = self._pieces(text, cuts, slow)
            if not len(begin):
                counts.append(np.zeros(hi - lo, np.int64))
                continue
            keys = _piece_keys(text, begin, end)
            entry = self.table.find(keys)
            if (entry < 0).any():
                fresh, first = np.unique(keys[entry < 0], return_index=True)
                if self.table.n + len(fresh) > self.table.most and self.table.n:
                    self.table.clear()
                    fresh, first = np.unique(keys, return_index=True)
                    at = first
                else:
                    at = np.flatnonzero(entry < 0)[first]
                alone = slow[np.searchsorted(cuts, begin[at], "right") - 1]
                if len(fresh) > self.table.most:
                    self.table = PieceTable(len(fresh))
                self._learn(fresh, begin[at], end[at], text, alone)
                entry = self.table.find(keys)
            runs = self.table.length[entry].astype(np.int64)
            ends = np.cumsum(runs)
            source = np.repeat(self.table.begin[entry] - (ends - runs), runs) + np.arange(int(ends[-1]))
            all_ids.append(self.table.ids[source])
            total = np.append(0, ends)
            counts.append(np.diff(total[np.searchsorted(begin, cuts)]))
        return np.concatenate(all_ids), np.concatenate(counts)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file: one at a time, kept for the worker's next task, as it knows most pieces by then."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_end_ids(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each row's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
