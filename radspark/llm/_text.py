"""Vectorised access to words of Arrow string columns: positions and 64-bit hashes without Python strings.

A word is ``[^\\x20\\x09-\\x0D]+``.  A span's hash chains its eight-byte pieces through an avalanche step (long spans: xxhash64),
so two different words that weren't made for it share one with a probability of about 2^-64.  No key is secret: who knows
the code can search for collisions; where a result must hold all the same, ``same_spans`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_ODD, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x1D8E4E27C47D124F)
#: Spans of more bytes are hashed one by one.
LONG = 256
#: Bytes handled at once; a longer document makes a slice of its own.
SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end) as a number."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _cut(eight: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` bytes of each number, left > 0."""
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    eight, size = _eights(data), end - start
    out = mix(size.astype(np.uint64) * _ODD + _SEED)
    rows, at, left = np.flatnonzero((size > 0) & (size <= LONG)), 0, size
    while len(rows):
        left = size[rows] - at
        out[rows] = mix((out[rows] ^ _cut(eight[start[rows] + at], left)) * _ODD)
        rows, at = rows[left > 8], at + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether the bytes of each pair of spans are equal."""
    eight, size = _eights(data), end - start
    out = size == end2 - start2
    rows, at = np.flatnonzero(out & (size > 0) & (size <= LONG)), 0
    while len(rows):
        left = size[rows] - at
        equal = _cut(eight[start[rows] + at], left) == _cut(eight[start2[rows] + at], left)
        out[rows[~equal]] = False
        rows, at = rows[equal & (left > 8)], at + 8
    for k in np.flatnonzero(out & (size > LONG)).tolist():
        out[k] = np.array_equal(data[start[k] : end[k]], data[start2[k] : end2[k]])
    return out


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """Words of a slice: ``doc`` (row in the slice), ``start``, ``end`` (byte offsets) in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = (FOLD[data] if fold else data), offsets
        n = len(data)
        inside = ~SPACE[data]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[: n - 1] = inside[:-1], inside[1:]
        before[first] = False
        after[first[first > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        return span_hashes(self.data, start, end)

    def hashes(self) -> np.ndarray:
        return self.span(self.start, self.end)


def grams(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of ``n`` words within one row."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _ODD + codes[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mix(out[at]), at


def distinct_by_doc(doc: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs, sorted by row and code."""
    if not len(doc):
        return doc, codes
    # one number holds the row and the code's leading bits; where codes differ in the others alone, the order needs both
    bits = np.uint64(max(1, int(doc.max()).bit_length()))
    key = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (codes >> bits)
    order = np.argsort(key)
    key, sorted_codes = key[order], codes[order]
    same = key[1:] == key[:-1]
    if (same & (sorted_codes[1:] != sorted_codes[:-1])).any():
        order = np.lexsort((codes, doc))
        sorted_codes, rows = codes[order], doc[order]
        same = (rows[1:] == rows[:-1]) & (sorted_codes[1:] == sorted_codes[:-1])
    keep = np.concatenate(([True], ~same))
    return doc[order][keep], sorted_codes[keep]
